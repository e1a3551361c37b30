"""DuckDB SQL of the trajectory queries, put together from named parts."""

from __future__ import annotations

import math
import re

from trackfix.plans.fixtures import FIXTURE_CTES, LARGE_POINTS, resized

_W = "PARTITION BY seq_id, query ORDER BY frame"
_KERNEL = [math.exp(-0.5 * (j / 2.0) ** 2) for j in range(-8, 9)]
_KERNEL_ROWS = ", ".join(f"({j}, {w / sum(_KERNEL)!r}::DOUBLE)" for j, w in zip(range(-8, 9), _KERNEL, strict=True))


def r6(*names: str) -> str:
    return ", ".join(f"ROUND({n}, 6) + 0e0 AS {n.rpartition('.')[2]}" for n in names)


def _descriptor(steps: str, key: str) -> str:
    """Unit directions of moving steps at ranks 0, (n-1)/2 and n-1."""
    return f"""SELECT seq_id, {key}, frame, dx / n AS dx, dy / n AS dy, dz / n AS dz FROM (
      SELECT *, row_number() OVER (PARTITION BY seq_id, {key} ORDER BY frame) - 1 AS rn, count(*) OVER (PARTITION BY seq_id, {key}) AS c
      FROM (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS n FROM {steps}) WHERE n > 1e-2)
    WHERE c >= 3 AND (c <= 3 OR rn IN (0, (c - 1) // 2, c - 1))"""


def _reach(edges: str, *part: str) -> str:
    """Recursive reachability over undirected edges (part..., a, b)."""
    p = "".join(f"{c}, " for c in part)
    same = "".join(f" AND e.{c} = r.{c}" for c in part)
    return f"""SELECT DISTINCT {p}a AS n, a AS root FROM (SELECT {p}a FROM {edges} UNION SELECT {p}b FROM {edges})
      UNION SELECT {"".join(f"r.{c}, " for c in part)}e.b, r.root FROM r_{edges} r JOIN (SELECT {p}a, b FROM {edges} UNION SELECT {p}b, a FROM {edges}) e ON e.a = r.n{same}"""


def _nn(source: str, part: str, k: int) -> str:
    on = " AND ".join(f"a.{c} = b.{c}" for c in part.split(", "))
    keys = ", ".join(f"a.{c}" for c in part.split(", "))
    d2 = "(a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz)"
    return f"""SELECT * FROM (SELECT {keys}, a.query AS a, b.query AS b, {d2} AS d2,
      CAST(row_number() OVER (PARTITION BY {keys}, a.query ORDER BY {d2}, b.query) AS INT) AS rank
      FROM {source} a JOIN {source} b ON {on} AND a.query <> b.query) WHERE rank <= {k}"""


def _norm(of: str, origin: str) -> str:
    return "sqrt(" + " + ".join(f"({of}{c}-{origin}{c})*({of}{c}-{origin}{c})" for c in "xyz") + ")"


def _budget(score: str, frac: str, limit: str) -> str:
    return f"""SELECT s.seq_id, s.group_id, CAST({limit} AS INT) AS k FROM stats s LEFT JOIN (
      SELECT seq_id, group_id, base, count(*) FILTER (rank <= extra AND ok) AS more FROM (
        SELECT *, row_number() OVER (PARTITION BY seq_id, ok ORDER BY f - (base + slot) DESC, group_id) AS rank FROM (
          SELECT *, slot, base + slot + 1 <= size AND f - (base + slot) > -1 AS ok, cap - sum(base) OVER (PARTITION BY seq_id, slot) AS extra FROM (
            SELECT *, least(floor(f), size)::BIGINT AS base FROM (
              SELECT *, cap * score / sum(score) OVER (PARTITION BY seq_id) AS f FROM (
                SELECT stats.*, least(floor({frac} * nq), sum(size) OVER (PARTITION BY seq_id)) AS cap, {score} AS score
                FROM stats JOIN (SELECT seq_id, count(DISTINCT query) AS nq FROM pts GROUP BY seq_id) USING (seq_id)
                WHERE group_type <> 'independent_dynamic'))), (VALUES (0), (1)) v(slot)))
      GROUP BY seq_id, group_id, base) b USING (seq_id, group_id)"""


def _medians(prefix_out: str, *names: str) -> str:
    return ", ".join(f"median({n}) AS {prefix_out}{n}" for n in names)


PARTS = FIXTURE_CTES | {
    "obs": "SELECT seq_id, frame, query, gx, gy, gz FROM pts WHERE measured",
    "cams": "SELECT DISTINCT seq_id, frame, cx, cy, cz FROM pts",
    "grp": "SELECT seq_id, query, o AS group_id, CASE WHEN o = 0 THEN 'world_fixed' ELSE 'co_moving' END AS group_type FROM pts WHERE frame = 0",
    "frag": "SELECT seq_id, query, CAST(group_id * 3 + query % 3 AS INT) AS group_id, group_type FROM grp",
    "pos": "SELECT seq_id, query, " + ", ".join(f"coalesce(median({c}) FILTER (visible), arg_min({c}, frame)) AS p{c}" for c in "xyz") + " FROM pts GROUP BY seq_id, query",
    "wf": "SELECT seq_id, query, count(*) AS n_visible, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS spread FROM pts WHERE visible GROUP BY seq_id, query HAVING count(*) >= 5 AND sqrt(var_pop(x) + var_pop(y) + var_pop(z)) < 5e-2",
    "nxt": "SELECT *, " + ", ".join(f"lead({c}) OVER ({_W}) AS n{c}" for c in ("frame", "visible", "x", "y", "z")) + " FROM pts",
    "steps2": "SELECT * FROM nxt WHERE visible AND nvisible AND nframe = frame + 1",
    "vel": "SELECT seq_id, query, frame, nx - x AS dx, ny - y AS dy, nz - z AS dz FROM steps2",
    "descr": _descriptor("vel", "query"),
    "moving": "SELECT * FROM descr WHERE (seq_id, query) NOT IN (SELECT (seq_id, query) FROM wf)",
    "gsteps": "SELECT seq_id, group_id, frame, median(nx) - median(x) AS dx, median(ny) - median(y) AS dy, median(nz) - median(z) AS dz FROM steps2 JOIN grp USING (seq_id, query) GROUP BY ALL HAVING count(*) >= 2",
    "gdescr": _descriptor("gsteps", "group_id"),
    "fsteps": "SELECT seq_id, group_id, frame, median(nx) - median(x) AS dx, median(ny) - median(y) AS dy, median(nz) - median(z) AS dz FROM steps2 JOIN frag USING (seq_id, query) WHERE group_type = 'co_moving' GROUP BY ALL HAVING count(*) >= 2",
    "fdescr": _descriptor("fsteps", "group_id"),
    "ray0": "SELECT seq_id, query, frame, x - cx AS ax, y - cy AS ay, z - cz AS az FROM pts WHERE visible",
    "ray": "SELECT seq_id, query, frame, ax / n AS rx, ay / n AS ry, az / n AS rz FROM (SELECT *, sqrt(ax*ax + ay*ay + az*az) AS n FROM ray0) WHERE n > 1e-9",
    "par": """SELECT seq_id, query, coalesce(acos(greatest(-1e0, least(1e0, m))), 0e0) AS parallax FROM (SELECT DISTINCT seq_id, query FROM pts)
      LEFT JOIN (SELECT a.seq_id, a.query, min(a.rx*b.rx + a.ry*b.ry + a.rz*b.rz) AS m FROM ray a JOIN ray b ON a.seq_id = b.seq_id AND a.query = b.query AND a.frame < b.frame GROUP BY ALL) USING (seq_id, query)""",
    "gpar": "SELECT seq_id, group_id, group_type, median(parallax) AS parallax FROM grp JOIN par USING (seq_id, query) GROUP BY ALL",
    "mpos": "SELECT pos.* FROM pos JOIN (SELECT DISTINCT seq_id, query FROM moving) USING (seq_id, query)",
    "nn50": _nn("mpos", "seq_id", 50),
    "pair50": "SELECT seq_id, a, b FROM nn50 WHERE a < b",
    "edge": """SELECT p.seq_id, p.a, p.b, greatest(-1e0, least(1e0, avg(u.dx*v.dx + u.dy*v.dy + u.dz*v.dz))) AS similarity FROM pair50 p
      JOIN moving u ON u.seq_id = p.seq_id AND u.query = p.a JOIN moving v ON v.seq_id = p.seq_id AND v.query = p.b AND v.frame = u.frame
      GROUP BY p.seq_id, p.a, p.b HAVING count(*) >= 3 AND avg(u.dx*v.dx + u.dy*v.dy + u.dz*v.dz) >= 9e-1""",
    "r_edge": _reach("edge", "seq_id"),
    "comp": "SELECT seq_id, query, coalesce(c, query) AS c FROM (SELECT DISTINCT seq_id, query FROM moving) LEFT JOIN (SELECT seq_id, n AS query, min(root) AS c FROM r_edge GROUP BY ALL) USING (seq_id, query)",
    "clu0": """SELECT seq_id, query, 'world_fixed' AS group_type, -1 AS o FROM wf UNION ALL
      SELECT seq_id, query, CASE WHEN count(*) OVER (PARTITION BY seq_id, c) >= 3 THEN 'co_moving' ELSE 'independent_dynamic' END, c FROM comp""",
    "clu": "SELECT seq_id, CAST(dense_rank() OVER (PARTITION BY seq_id ORDER BY o) - 1 AS INT) AS group_id, group_type, query FROM clu0",
    "nn2": _nn("pos", "seq_id", 2),
    "r_nn2": _reach("nn2", "seq_id"),
    "gpos": "SELECT grp.seq_id, grp.query, group_id, group_type, px, py, pz FROM grp JOIN pos USING (seq_id, query)",
    "fpos": "SELECT frag.seq_id, frag.query, group_id, group_type, px, py, pz FROM frag JOIN pos USING (seq_id, query)",
    "gnn3": _nn("gpos", "seq_id, group_id", 3),
    "cpos": "SELECT * FROM gpos WHERE group_type = 'co_moving' AND (seq_id, group_id) IN (SELECT (seq_id, group_id) FROM grp GROUP BY seq_id, group_id HAVING count(*) > 3)",
    "cnn2": _nn("cpos", "seq_id, group_id", 2),
    "r_cnn2": _reach("cnn2", "seq_id", "group_id"),
    "split0": """SELECT grp.*, coalesce(p, -1) AS part, count(*) OVER (PARTITION BY grp.seq_id, grp.group_id, coalesce(p, -1)) AS n FROM grp
      LEFT JOIN (SELECT seq_id, group_id, n AS query, min(root) AS p FROM r_cnn2 GROUP BY ALL) USING (seq_id, group_id, query)""",
    "gnn1": _nn("gpos", "seq_id, group_id", 1),
    "fnn1": _nn("fpos", "seq_id, group_id", 1),
    "gscale": "SELECT seq_id, group_id, coalesce(scale, 1e0) AS scale FROM (SELECT DISTINCT seq_id, group_id FROM grp) LEFT JOIN (SELECT seq_id, group_id, median(sqrt(d2)) AS scale FROM gnn1 WHERE d2 > 0 GROUP BY ALL) USING (seq_id, group_id)",
    "fscale": "SELECT seq_id, group_id, coalesce(scale, 1e0) AS scale FROM (SELECT DISTINCT seq_id, group_id FROM frag) LEFT JOIN (SELECT seq_id, group_id, median(sqrt(d2)) AS scale FROM fnn1 WHERE d2 > 0 GROUP BY ALL) USING (seq_id, group_id)",
    "gcen": "SELECT seq_id, group_id, group_type, median(px) AS px, median(py) AS py, median(pz) AS pz, count(*) AS size FROM gpos GROUP BY ALL",
    "fcen": "SELECT seq_id, group_id, group_type, median(px) AS px, median(py) AS py, median(pz) AS pz, count(*) AS size FROM fpos GROUP BY ALL",
    "fcd": "SELECT a.seq_id, a.group_id AS a, b.group_id AS b, (a.px-b.px)*(a.px-b.px) + (a.py-b.py)*(a.py-b.py) + (a.pz-b.pz)*(a.pz-b.pz) AS d2 FROM fcen a JOIN fcen b ON a.seq_id = b.seq_id AND a.group_id <> b.group_id",
    "fable": "SELECT DISTINCT seq_id, group_id FROM fcen JOIN fdescr USING (seq_id, group_id) WHERE group_type = 'co_moving' AND size >= 5",
    "fedge": """SELECT d.seq_id, d.a, d.b FROM fcd d JOIN fscale s ON s.seq_id = d.seq_id AND s.group_id = d.a
      JOIN fable f ON f.seq_id = d.seq_id AND f.group_id = d.a JOIN fable g ON g.seq_id = d.seq_id AND g.group_id = d.b
      JOIN fdescr u ON u.seq_id = d.seq_id AND u.group_id = d.a JOIN fdescr v ON v.seq_id = d.seq_id AND v.group_id = d.b AND v.frame = u.frame
      WHERE d.a < d.b AND d.d2 <= (3 * greatest(s.scale, 1e-6)) * (3 * greatest(s.scale, 1e-6))
      GROUP BY d.seq_id, d.a, d.b HAVING count(*) >= 3 AND avg(u.dx*v.dx + u.dy*v.dy + u.dz*v.dz) >= 85e-2""",
    "r_fedge": _reach("fedge", "seq_id"),
    "merge0": """SELECT frag.seq_id, frag.query, frag.group_type, CASE WHEN fable.group_id IS NULL THEN 1 ELSE 0 END AS first, coalesce(c, frag.group_id) AS second
      FROM frag LEFT JOIN fable USING (seq_id, group_id) LEFT JOIN (SELECT seq_id, n AS group_id, min(root) AS c FROM r_fedge GROUP BY ALL) USING (seq_id, group_id)""",
    "obs2": "SELECT seq_id, frame, query, gx, gy, gz FROM pts WHERE measured OR (query % 2 = 0 AND frame % 4 < 2)",
    "cell2": "SELECT p.seq_id, p.query, p.frame, p.x, p.y, p.z FROM pts p JOIN obs2 USING (seq_id, frame, query) WHERE p.visible",
    "step2": f"SELECT seq_id, query, CASE WHEN lead(frame) OVER ({_W}) = frame + 1 THEN sqrt((lead(x) OVER ({_W}) - x)*(lead(x) OVER ({_W}) - x) + (lead(y) OVER ({_W}) - y)*(lead(y) OVER ({_W}) - y) + (lead(z) OVER ({_W}) - z)*(lead(z) OVER ({_W}) - z)) END AS d FROM cell2",
    "stats": """SELECT seq_id, group_id, group_type, count(steps) AS size, coalesce(sum(total) / nullif(sum(steps), 0), 0e0) AS motion FROM grp
      LEFT JOIN (SELECT seq_id, query, sum(d) AS total, count(d) AS steps FROM step2 GROUP BY ALL) USING (seq_id, query) GROUP BY ALL""",
    "bud": _budget("size * (1 + motion / CASE WHEN max(motion) OVER (PARTITION BY seq_id) > 0 THEN max(motion) OVER (PARTITION BY seq_id) ELSE 1 END)", "5e-2", "coalesce(base, 0) + coalesce(more, 0)"),
    "budp": _budget("size * 1e0", "5e-1", "least(coalesce(base, 0) + coalesce(more, 0), 30)"),
    "ccell": "SELECT p.seq_id, g.group_id, b.k, p.query, p.frame FROM pts p JOIN grp g USING (seq_id, query) JOIN bud b USING (seq_id, group_id) WHERE p.visible AND p.measured AND b.k > 0",
    "cq": "SELECT * FROM (SELECT seq_id, group_id, k, query, arg_min(frame, md5(concat_ws('|', '7', seq_id, group_id, query, frame))) AS own, count(*) OVER (PARTITION BY seq_id, group_id) AS n FROM ccell GROUP BY seq_id, group_id, k, query) WHERE n >= k",
    "cf": "SELECT seq_id, group_id, arg_min(frame, md5(concat_ws('|', '7', seq_id, group_id, frame))) AS common FROM (SELECT seq_id, group_id, k, frame FROM ccell GROUP BY ALL HAVING count(DISTINCT query) >= k) GROUP BY ALL",
    "pool": """SELECT c.seq_id, c.group_id, c.k, c.query, c.frame FROM ccell c JOIN cf ON cf.seq_id = c.seq_id AND cf.group_id = c.group_id AND cf.common = c.frame
      UNION ALL SELECT seq_id, group_id, k, query, own FROM cq WHERE (seq_id, group_id) NOT IN (SELECT (seq_id, group_id) FROM cf)""",
    "anc": "SELECT * EXCLUDE (k) FROM (SELECT seq_id, group_id, CAST(row_number() OVER (PARTITION BY seq_id, group_id ORDER BY md5(concat_ws('|', '7', seq_id, group_id, query)), query) - 1 AS INT) AS ord, query, frame, k FROM pool) WHERE ord < k",
    "ancd": "SELECT * EXCLUDE (k) FROM (SELECT seq_id, group_id, CAST(row_number() OVER (PARTITION BY seq_id, group_id ORDER BY md5(concat_ws('|', '7', seq_id, group_id, query)), query) - 1 AS INT) AS ord, query, own AS frame, k FROM cq) WHERE ord < k",
    "ap": "SELECT a.*, p.x, p.y, p.z, p.gx, p.gy, p.gz FROM anc a JOIN pts p USING (seq_id, frame, query)",
    "c0": "SELECT a.seq_id, a.group_id, c.cx AS c0x, c.cy AS c0y, c.cz AS c0z FROM anc a JOIN cams c USING (seq_id, frame) WHERE a.ord = 0",
    "cs": f"SELECT seq_id, group_id, c0x, c0y, c0z, median(CASE WHEN {_norm('', 'c0')} > 1e-3 AND {_norm('g', 'c0')} > 0 THEN {_norm('g', 'c0')} / {_norm('', 'c0')} END) AS alpha FROM ap JOIN c0 USING (seq_id, group_id) GROUP BY ALL",
    "pf": f"""SELECT seq_id, group_id, frame, median({_norm("g", "c")} / {_norm("", "c")}) AS alpha FROM pts JOIN (SELECT DISTINCT seq_id, group_id, query FROM anc) USING (seq_id, query)
      WHERE visible AND measured AND {_norm("", "c")} > 1e-3 AND {_norm("g", "c")} > 0 GROUP BY ALL""",
    "pfg": "SELECT g.seq_id, g.group_id, f.t AS frame, pf.alpha FROM (SELECT DISTINCT seq_id, group_id FROM pf) g CROSS JOIN frames f LEFT JOIN pf ON pf.seq_id = g.seq_id AND pf.group_id = g.group_id AND pf.frame = f.t",
    "pfi": """SELECT seq_id, group_id, frame, alpha, coalesce(alpha, pa + (frame - pt) * ((qa - pa) / (qt - pt)), pa, qa) AS filled FROM (SELECT *,
      last_value(alpha IGNORE NULLS) OVER w AS pa, last_value(CASE WHEN alpha IS NOT NULL THEN frame END IGNORE NULLS) OVER w AS pt,
      first_value(alpha IGNORE NULLS) OVER v AS qa, first_value(CASE WHEN alpha IS NOT NULL THEN frame END IGNORE NULLS) OVER v AS qt FROM pfg
      WINDOW w AS (PARTITION BY seq_id, group_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY seq_id, group_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "kern": f"SELECT * FROM (VALUES {_KERNEL_ROWS}) v(j, w)",
    "pfs": """SELECT i.seq_id, i.group_id, i.frame, sum(k.w * s.filled) AS alpha FROM pfi i CROSS JOIN kern k JOIN pfi s ON s.seq_id = i.seq_id AND s.group_id = i.group_id
      AND s.frame = CASE WHEN (i.frame + k.j + 30) % 30 <= 15 THEN (i.frame + k.j + 30) % 30 ELSE 30 - (i.frame + k.j + 30) % 30 END WHERE i.alpha IS NOT NULL GROUP BY ALL""",
    "a0": "SELECT seq_id, group_id, x AS a0x, y AS a0y, z AS a0z, gx AS t0x, gy AS t0y, gz AS t0z FROM ap WHERE ord = 0",
    "asc0": f"SELECT seq_id, group_id, a0x, a0y, a0z, t0x, t0y, t0z, median(CASE WHEN ord > 0 AND {_norm('', 'a0')} > 1e-3 AND {_norm('g', 't0')} > 0 THEN {_norm('g', 't0')} / {_norm('', 'a0')} END) AS s FROM ap JOIN a0 USING (seq_id, group_id) GROUP BY ALL",
    "gp": "SELECT p.seq_id, p.frame, p.query, p.x, p.y, p.z, p.gx, p.gy, p.gz, p.cx, p.cy, p.cz, g.group_id FROM pts p JOIN grp g USING (seq_id, query)",
    "sc_cam": "SELECT gp.* EXCLUDE (x, y, z), " + ", ".join(f"coalesce(c0{c} + alpha * ({c} - c0{c}), {c}) AS {c}" for c in "xyz") + " FROM gp LEFT JOIN cs USING (seq_id, group_id)",
    "sc_pf": "SELECT s.* EXCLUDE (x, y, z), " + ", ".join(f"coalesce(c{c} + coalesce(pfs.alpha, cs.alpha) * ({c} - c{c}), {c}) AS {c}" for c in "xyz") + " FROM sc_cam s LEFT JOIN cs USING (seq_id, group_id) LEFT JOIN pfs USING (seq_id, group_id, frame)",
    "sc_anc": "SELECT gp.* EXCLUDE (x, y, z), " + ", ".join(f"coalesce(t0{c} + s * ({c} - a0{c}), {c}) AS {c}" for c in "xyz") + " FROM gp LEFT JOIN asc0 USING (seq_id, group_id)",
    "objs": "SELECT seq_id, o, query FROM pts WHERE frame = 0",
    "ecells": "SELECT p.*, o AS group_id, row_number() OVER (PARTITION BY seq_id, o ORDER BY frame, query) AS rn FROM pts p WHERE visible AND measured",
    "e0": "SELECT seq_id, group_id, cx AS c0x, cy AS c0y, cz AS c0z FROM ecells WHERE rn = 1",
    "ea": f"SELECT seq_id, group_id, c0x, c0y, c0z, median({_norm('g', 'c0')} / {_norm('', 'c0')}) AS alpha FROM ecells JOIN e0 USING (seq_id, group_id) GROUP BY ALL",
    "ed": "SELECT seq_id, group_id, " + ", ".join(f"median(g{c} - (c0{c} + alpha * ({c} - c0{c}))) AS d{c}" for c in "xyz") + " FROM ecells JOIN ea USING (seq_id, group_id) GROUP BY ALL",
}

#: The same chain of parts from plain observations, as the whole pipeline draws them; its names end in _r.
_CHAIN = ("cell2", "step2", "stats", "bud", "ccell", "cq", "cf", "pool", "anc", "ap", "c0", "cs", "pf", "pfg", "pfi", "pfs", "a0", "asc0", "sc_cam", "sc_pf", "sc_anc")
PARTS |= {f"{name}_r": re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"\1_r", PARTS[name].replace("JOIN obs2 USING", "JOIN obs USING")) for name in _CHAIN}
PARTS["form_r"] = "SELECT seq_id, group_id, group_type = 'world_fixed' OR parallax < radians(2e0) AS anchored FROM gpar"


def _translated(source: str, anc: str = "anc", more: str = "") -> str:
    return f"""SELECT s.seq_id, s.frame, s.query, {more}{", ".join(f"ROUND(s.{c} + coalesce(d.d{c}, 0), 6) + 0e0 AS {c}" for c in "xyz")} FROM {source} s LEFT JOIN (
      SELECT t.seq_id, t.group_id, {", ".join(f"median(t.g{c} - t.{c}) AS d{c}" for c in "xyz")} FROM {source} t JOIN {anc} USING (seq_id, group_id, query, frame) GROUP BY t.seq_id, t.group_id) d USING (seq_id, group_id)"""


def compose(select: str) -> str:
    """``select`` after the parts that it names, directly or through others."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"(?:FROM|JOIN|IN \(SELECT \(\w+, \w+\) FROM)\s+{name}\b", text):
                need.append(name)
                visit(PARTS[name])

    visit(select)
    ordered = [n for n in PARTS if n in need]
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in ordered) + "\n" if ordered else "") + select


_K = "seq_id, frame, query"
_SELECTS = {
    "trajectory_points": f"SELECT {_K}, {r6('x', 'y', 'z')}, visible FROM pts",
    "camera_centers": f"SELECT seq_id, frame, {r6('cx', 'cy', 'cz')} FROM cams",
    "sparse_observations": f"SELECT {_K}, ROUND(gx + CASE WHEN query % 7 = 0 THEN 1 ELSE 0 END, 6) + 0e0 AS gx, {r6('gy', 'gz')} FROM obs",
    "dense_grid_scatter": f"SELECT {_K}, " + ", ".join(f"CASE WHEN measured THEN ROUND({c}, 6) + 0e0 END AS {c}" for c in ("gx", "gy", "gz")) + ", measured AS valid FROM pts",
    "validation_report": """SELECT seq_id, count(DISTINCT frame) AS n_frames, count(DISTINCT query) AS n_queries, count(*) FILTER (visible) AS n_visible, count(*) FILTER (measured) AS n_valid,
      count(*) FILTER (visible AND measured) AS n_candidates, 0::BIGINT AS n_visible_nan, true AS centers_finite, bool_and(abs(cx) <= 1e-8 AND abs(cy) <= 1e-8 AND abs(cz) <= 1e-8) AS centers_zero,
      bool_and(abs(cx) <= 1e-8 AND abs(cy) <= 1e-8) AS camera_static, floor(5e-2 * count(DISTINCT query))::BIGINT AS budget,
      floor(5e-2 * count(DISTINCT query)) > count(*) FILTER (visible AND measured) AS budget_capped FROM pts GROUP BY seq_id""",
    "group_validation": """SELECT seq_id, count(DISTINCT group_id) AS n_groups, count(*) AS n_members, count(*) FILTER (group_type = 'other') AS n_unknown_type,
      count(*) FILTER (query < 0) AS n_out_of_range, 2::BIGINT AS n_shared FROM (SELECT seq_id, group_id, group_type, query FROM grp UNION ALL
      SELECT seq_id, group_id + 10, 'other', CASE WHEN query = 2 THEN -1 ELSE query END FROM grp WHERE query < 3) GROUP BY seq_id""",
    "observed_pairs": f"SELECT {_K}, {r6('x', 'y', 'z', 'gx', 'gy', 'gz')} FROM pts WHERE visible AND measured",
    "median_positions": f"SELECT seq_id, query, {r6('px', 'py', 'pz')} FROM pos",
    "world_fixed_points": f"SELECT seq_id, query, n_visible, {r6('spread')} FROM wf",
    "velocities": f"SELECT seq_id, query, frame, {r6('dx', 'dy', 'dz')} FROM vel",
    "direction_descriptors": f"SELECT seq_id, query, frame, {r6('dx', 'dy', 'dz')} FROM descr",
    "group_descriptors": f"SELECT seq_id, group_id, frame, {r6('dx', 'dy', 'dz')} FROM gdescr",
    "camera_rays": f"SELECT seq_id, query, frame, {r6('rx', 'ry', 'rz')} FROM ray",
    "query_parallax": f"SELECT seq_id, query, {r6('parallax')} FROM par",
    "group_parallax_form": f"""SELECT seq_id, group_id, group_type, {r6('parallax')}, CASE WHEN parallax < radians(30e0) THEN 'scale_about_anchor_translation'
      WHEN group_type = 'world_fixed' THEN 'scale_about_anchor_translation' ELSE 'scale_about_camera_per_frame_translation' END AS form FROM gpar""",
    "direction_edges": f"SELECT seq_id, a, b, {r6('similarity')} FROM edge",
    "direction_edges_all_pairs": """SELECT u.seq_id, u.query AS a, v.query AS b, ROUND(greatest(-1e0, least(1e0, avg(u.dx*v.dx + u.dy*v.dy + u.dz*v.dz))), 6) + 0e0 AS similarity FROM moving u
      JOIN moving v ON v.seq_id = u.seq_id AND v.frame = u.frame AND u.query < v.query GROUP BY u.seq_id, u.query, v.query
      HAVING count(*) >= 3 AND avg(u.dx*v.dx + u.dy*v.dy + u.dz*v.dz) >= 9e-1""",
    "knn_edges": f"SELECT seq_id, a, b, rank, {r6('d2')} FROM (" + _nn("pos", "seq_id", 10) + ")",
    "spatial_knn_graph": "SELECT DISTINCT seq_id, group_id, least(a, b) AS a, greatest(a, b) AS b FROM gnn3",
    "radius_pairs": f"SELECT d.seq_id, d.a, d.b, {r6('d.d2')} FROM fcd d JOIN fscale s ON s.seq_id = d.seq_id AND s.group_id = d.a WHERE d.a < d.b AND d.d2 <= (s.scale * 3) * (s.scale * 3)",
    "nearest_centroids": "SELECT seq_id, a, arg_min(b, d2) AS b, ROUND(min(d2), 6) + 0e0 AS d2 FROM fcd GROUP BY seq_id, a",
    "connected_components": "SELECT seq_id, n AS query, min(root) AS component FROM r_nn2 GROUP BY seq_id, n",
    "motion_clusters": "SELECT seq_id, group_id, group_type, query FROM clu",
    "spatial_split": """SELECT seq_id, CAST(dense_rank() OVER (PARTITION BY seq_id ORDER BY group_id, part) - 1 AS INT) AS group_id,
      CASE WHEN part >= 0 AND n < 3 THEN 'independent_dynamic' ELSE group_type END AS group_type, query FROM split0""",
    "merge_fragments": "SELECT seq_id, CAST(dense_rank() OVER (PARTITION BY seq_id ORDER BY first, second) - 1 AS INT) AS group_id, group_type, query FROM merge0",
    "fragment_scale": f"SELECT seq_id, group_id, {r6('scale')} FROM gscale",
    "group_centroids": f"SELECT seq_id, group_id, group_type, {r6('px', 'py', 'pz')}, size FROM gcen",
    "group_motion": f"SELECT seq_id, group_id, group_type, size, {r6('motion')} FROM stats",
    "anchor_budget_motion": "SELECT seq_id, group_id, k FROM bud",
    "anchor_budget_proportional": "SELECT seq_id, group_id, k FROM budp",
    "sample_anchors_common_frame": "SELECT seq_id, group_id, ord, query, frame FROM anc",
    "sample_anchors_distinct": "SELECT seq_id, group_id, ord, query, frame FROM ancd",
    "anchor_points": f"SELECT seq_id, group_id, ord, query, frame, {r6('x', 'y', 'z', 'gx', 'gy', 'gz')} FROM ap",
    "camera_scale": f"SELECT seq_id, group_id, {r6('c0x', 'c0y', 'c0z', 'alpha')} FROM cs",
    "per_frame_scale": f"SELECT seq_id, group_id, frame, {r6('alpha')} FROM pf",
    "interpolated_scale": f"SELECT seq_id, group_id, frame, {r6('filled')} FROM pfi",
    "smoothed_scale": f"SELECT seq_id, group_id, frame, {r6('alpha')} FROM pfs",
    "anchor_scale": f"SELECT seq_id, group_id, {r6('a0x', 't0x', 's')} FROM asc0",
    "group_translation": "SELECT seq_id, group_id, " + ", ".join(f"ROUND(median(g{c} - {c}), 6) + 0e0 AS d{c}" for c in "xyz") + " FROM ap GROUP BY seq_id, group_id",
    "corrected_scale_about_camera_per_frame_translation": _translated("sc_pf"),
    "corrected_scale_about_camera_translation": _translated("sc_cam"),
    "corrected_scale_about_anchor_translation": _translated("sc_anc"),
    "corrected_scale_about_anchor": f"SELECT {_K}, {r6('x', 'y', 'z')} FROM sc_anc",
    "corrected_none": f"SELECT {_K}, {r6('x', 'y', 'z')} FROM pts",
    "group_type_counts": "SELECT seq_id, group_type, count(DISTINCT group_id) AS n_groups FROM clu GROUP BY seq_id, group_type",
    "coverage_report": """SELECT j.seq_id, j.o AS label, count(*) AS n_points, count(c.group_id) AS n_covered, count(DISTINCT c.group_id) AS n_groups, count(DISTINCT CASE WHEN m.mixed THEN c.group_id END) AS n_mixed
      FROM objs j LEFT JOIN clu c USING (seq_id, query) LEFT JOIN (SELECT seq_id, group_id, count(DISTINCT o) > 1 AS mixed FROM clu JOIN objs USING (seq_id, query) GROUP BY ALL) m USING (seq_id, group_id) GROUP BY j.seq_id, j.o""",
    "median_epe": f"""SELECT p.seq_id, p.o AS label, count(*) AS cells, ROUND(median({_norm('p.', 'p.g').replace('p.g', 'p.g')}), 6) + 0e0 AS epe_before,
      ROUND(median(sqrt({" + ".join(f"power(c0{c} + alpha * (p.{c} - c0{c}) + d{c} - p.g{c}, 2)" for c in "xyz")})), 6) + 0e0 AS epe_after
      FROM pts p JOIN ea ON ea.seq_id = p.seq_id AND ea.group_id = p.o JOIN ed ON ed.seq_id = p.seq_id AND ed.group_id = p.o GROUP BY p.seq_id, p.o""",
    "rectify_supplied_groups": f"""SELECT * FROM ({_translated("sc_anc_r", "anc_r", "s.group_id, ")}) JOIN (SELECT seq_id, group_id FROM form_r WHERE anchored) USING (seq_id, group_id)
      UNION ALL SELECT * FROM ({_translated("sc_pf_r", "anc_r", "s.group_id, ")}) JOIN (SELECT seq_id, group_id FROM form_r WHERE NOT anchored) USING (seq_id, group_id)""",
    "embedding_trajectories": "SELECT label AS seq_id, vec_id AS query, " + ", ".join(f"ROUND(median(embedding[3 * f + {i}]::DOUBLE), 6) + 0e0 AS p{c}" for i, c in enumerate("xyz", 1)) + " FROM embeddings, range(22) r(f) GROUP BY label, vec_id",
}
ORACLE: dict[str, str] = {name: compose(select) for name, select in _SELECTS.items()}
ORACLE |= {f"{name}_large": resized(ORACLE[name], LARGE_POINTS) for name in ("direction_edges", "direction_edges_all_pairs", "knn_edges")}
