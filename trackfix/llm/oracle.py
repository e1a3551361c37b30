"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op2_url_reputation"] = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
l AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
      WHERE doc_id IS NOT NULL AND (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY doc_id),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS s FROM p),
named AS (
  SELECT host, s, array_to_string(s[-2:], '.') AS last2, array_to_string(s[-3:], '.') AS last3,
    array_to_string(s[-2:], '.') IN ('ac.uk','co.in','co.jp','co.nz','co.uk','co.za','com.au','com.br','com.cn','com.mx','gov.uk','net.au','org.au','org.uk') AS two FROM parts),
hosts AS (
  SELECT p.host, CASE WHEN any_value(two) THEN any_value(last3) ELSE any_value(last2) END AS domain,
    CASE WHEN any_value(two) AND any_value(last2) <> p.host THEN any_value(last2) ELSE any_value(s[-1]) END AS suffix,
    coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad
  FROM p JOIN named USING (host) LEFT JOIN l ON l.doc_id = p.page_id GROUP BY p.host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
strengths AS (SELECT unnest([2e0, 8e0, 32e0, 128e0, 512e0, 2048e0]) AS m),
overall AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS mean FROM suffixes),
sp AS (SELECT suffix, n, bad, least(greatest(mean, 1e-9), 1 - 1e-9) AS pr FROM suffixes, overall),
s_e AS (SELECT suffix, pr, n, bad, m, lgamma(m * pr + bad) - lgamma(m * pr) + lgamma(m * (1 - pr) + n - bad) - lgamma(m * (1 - pr)) - lgamma(m + n) + lgamma(m) AS ev FROM sp, strengths),
s_t AS (SELECT m, coalesce(sum(ev) FILTER (n > 0), 0) AS t FROM s_e GROUP BY m),
s_l AS (SELECT m, exp(t - max(t) OVER ()) AS v FROM s_t),
s_w AS (SELECT m, ln(0.9 * v / sum(v) OVER () + 0.1 / 6) AS lw FROM s_l),
s_o AS (SELECT *, exp(ev + lw - max(ev + lw) OVER (PARTITION BY suffix)) AS share, (m * pr + bad) / (m + n) AS q FROM s_e JOIN s_w USING (m)),
s_r AS (SELECT suffix, sum(share * q) / sum(share) AS rate, sum(share * (q * q + q * (1 - q) / (m + n + 1))) / sum(share) AS square FROM s_o GROUP BY suffix),
dp AS (SELECT domain, n, bad, least(greatest(rate, 1e-9), 1 - 1e-9) AS pr FROM domains JOIN s_r USING (suffix)),
d_e AS (SELECT domain, pr, n, bad, m, lgamma(m * pr + bad) - lgamma(m * pr) + lgamma(m * (1 - pr) + n - bad) - lgamma(m * (1 - pr)) - lgamma(m + n) + lgamma(m) AS ev FROM dp, strengths),
d_t AS (SELECT m, coalesce(sum(ev) FILTER (n > 0), 0) AS t FROM d_e GROUP BY m),
d_l AS (SELECT m, exp(t - max(t) OVER ()) AS v FROM d_t),
d_w AS (SELECT m, ln(0.9 * v / sum(v) OVER () + 0.1 / 6) AS lw FROM d_l),
d_o AS (SELECT *, exp(ev + lw - max(ev + lw) OVER (PARTITION BY domain)) AS share, (m * pr + bad) / (m + n) AS q FROM d_e JOIN d_w USING (m)),
d_r AS (SELECT domain, sum(share * q) / sum(share) AS rate, sum(share * (q * q + q * (1 - q) / (m + n + 1))) / sum(share) AS square FROM d_o GROUP BY domain),
hp AS (SELECT host, hosts.n, hosts.bad, least(greatest(rate, 1e-9), 1 - 1e-9) AS pr FROM hosts JOIN d_r USING (domain)),
h_e AS (SELECT host, pr, n, bad, m, lgamma(m * pr + bad) - lgamma(m * pr) + lgamma(m * (1 - pr) + n - bad) - lgamma(m * (1 - pr)) - lgamma(m + n) + lgamma(m) AS ev FROM hp, strengths),
h_t AS (SELECT m, coalesce(sum(ev) FILTER (n > 0), 0) AS t FROM h_e GROUP BY m),
h_l AS (SELECT m, exp(t - max(t) OVER ()) AS v FROM h_t),
h_w AS (SELECT m, ln(0.9 * v / sum(v) OVER () + 0.1 / 6) AS lw FROM h_l),
h_o AS (SELECT *, exp(ev + lw - max(ev + lw) OVER (PARTITION BY host)) AS share, (m * pr + bad) / (m + n) AS q FROM h_e JOIN h_w USING (m)),
h_r AS (SELECT host, sum(share * q) / sum(share) AS rate, sum(share * (q * q + q * (1 - q) / (m + n + 1))) / sum(share) AS square FROM h_o GROUP BY host),
h3 AS (SELECT host, rate - 1.645 * sqrt(greatest(square - rate * rate, 0)) AS lower FROM h_r),
rules AS (SELECT * FROM (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'),
    ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')) r(rhost, rpath, rule, verdict)),
hit AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, hit.rule, coalesce(hit.verdict, CASE WHEN h3.lower > greatest(0.25, mean + 0.1 * (1 - mean)) THEN 'block' ELSE 'allow' END) AS verdict, round(h3.lower, 6) + 0e0 AS bad_lower
FROM overall, p LEFT JOIN hit ON hit.page_id = p.page_id AND hit.host = p.host AND hit.path = p.path JOIN h3 ON h3.host = p.host
"""

ORACLE["op6_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, max(lev) OVER () * weight) AS target FROM lv),
b AS (SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS epochs, round(target)::BIGINT % greatest(source_size, 1) AS rest FROM t),
c AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
  FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM c
"""

ORACLE["op1_chat_perspectives"] = r"""
WITH t AS (SELECT conv_id, coalesce(floor(turn / 512e0), 4503599627370496)::BIGINT AS piece, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, role AS speaker,
    replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
s AS (SELECT conv_id, piece, turn, role, text, perspective, role = perspective AS mine,
    CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10)
      ELSE '<|user|>' || replace(replace(role, '<|', '< |'), chr(10), ' ') || chr(10) END AS head, text || '<|end|>' AS body
  FROM t JOIN p USING (conv_id)),
w AS (SELECT *, length(head) AS lh, length(body) AS lb, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, piece ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
    - length(body) - 1 AS b0, row_number() OVER (PARTITION BY conv_id, perspective, piece ORDER BY turn, role, text) AS rn FROM s)
SELECT conv_id, perspective, piece, 0::BIGINT AS part, (sum(sum(lh + lb + 1)) OVER (PARTITION BY conv_id, perspective ORDER BY piece) - sum(lh + lb + 1))::BIGINT AS start,
  count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY rn) AS text,
  coalesce(string_agg(b0::BIGINT::VARCHAR || ':' || (b0 + lb)::BIGINT::VARCHAR, ',' ORDER BY rn) FILTER (mine), '') AS mask,
  coalesce(sum(lb) FILTER (mine), 0)::BIGINT AS n_trained
FROM w GROUP BY conv_id, perspective, piece
"""

ORACLE["op3_license_scan"] = r"""
WITH tm AS (SELECT * FROM (VALUES
  ('Apache-2.0', 'licensed under the apache license version 2 0'),
  ('Apache-2.0', 'licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license'),
  ('BSD', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  ('CC-BY-4.0', 'this work is licensed under a creative commons attribution 4 0 international license'),
  ('CC-BY-NC-4.0', 'licensed under cc by nc 4 0'),
  ('CC-BY-SA-4.0', 'this work is licensed under a creative commons attribution sharealike 4 0 international license'),
  ('GPL-3.0', 'this work is licensed under the gnu general public license version 3'),
  ('GPL-3.0', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version'),
  ('MIT', 'released under the mit license'), ('MIT', 'this project is licensed under the mit license'), ('reserved', 'all rights reserved')) v(license, t)),
tb AS (SELECT row_number() OVER (ORDER BY license, t) AS k, license, list_distinct(list_transform(range(1, len(string_split(t, ' '))), lambda i: string_split(t, ' ')[i] || ' ' || string_split(t, ' ')[i + 1])) AS b FROM tm),
seg AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(lower(text), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, regexp_extract_all(s, '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM seg),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS passage, w FROM w WHERE len(w) > 0),
g AS (SELECT doc_id, passage, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM n WHERE len(w) > 1 AND len(w) < 80),
d AS (SELECT doc_id, passage, license, 2 * len(list_intersect(g.b, tb.b)) / (len(g.b) + len(tb.b))::DOUBLE AS dice FROM g JOIN tb ON len(tb.b) >= len(g.b) * 0.6 AND len(tb.b) <= len(g.b) * 1.6),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, passage ORDER BY dice DESC, license) AS rn FROM d WHERE dice >= 0.8)
SELECT doc_id, passage, license, dice FROM r WHERE rn = 1
"""

ORACLE["op11_filter_audit"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS part, coalesce(text, '') AS t, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic FROM documents),
f AS (SELECT part, good, toxic, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS mask FROM d),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, i::INTEGER AS step, bits[i] AS bit, coalesce(list_sum(bits[:i - 1]), 0)::INTEGER AS before FROM o, range(1, 6) r(i)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
