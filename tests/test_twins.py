"""Queries that SQL cannot express, against plain numpy: one sequence at a time, loops instead of joins."""

import collections
import hashlib

import numpy as np
import pytest

from trackfix.config import RectifyConfig

SF = "/root/testdata/sf0.001"
CFG = RectifyConfig()


@pytest.fixture(scope="module")
def sequences(spark):
    """The fixture's sequences as arrays."""
    from trackfix.plans.fixtures import scene

    s = scene(spark, SF)
    out = {}
    for r in s.points.collect():
        out.setdefault(r.seq_id, {"p": {}, "v": {}, "o": {}, "c": {}, "g": {}})
        out[r.seq_id]["p"][r.frame, r.query], out[r.seq_id]["v"][r.frame, r.query] = (r.x, r.y, r.z), r.visible
    for r in s.observations.collect():
        out[r.seq_id]["o"][r.frame, r.query] = np.array((r.gx, r.gy, r.gz))
    for r in s.cameras.collect():
        out[r.seq_id]["c"][r.frame] = (r.cx, r.cy, r.cz)
    for r in s.groups.collect():
        out[r.seq_id]["g"].setdefault((r.group_id, r.group_type), []).append(r.query)
    for x in out.values():
        t, n = (max(k[i] for k in x["p"]) + 1 for i in (0, 1))
        x["p"] = np.array([[x["p"][f, q] for q in range(n)] for f in range(t)])
        x["v"] = np.array([[x["v"][f, q] for q in range(n)] for f in range(t)])
        x["c"] = np.array([x["c"][f] for f in range(t)])
        x["g"] = [(kind, sorted(q)) for (_, kind), q in sorted(x["g"].items())]
        x["pos"] = np.array([np.median(x["p"][x["v"][:, q], q], axis=0) if x["v"][:, q].any() else x["p"][0, q] for q in range(n)])
    assert len(out) > 1
    return out


def spread_out(steps):
    """Unit directions of the moving steps at three even ranks, by frame."""
    moving = [(t, d / np.linalg.norm(d)) for t, d in steps if np.linalg.norm(d) > 0.01]
    if len(moving) < 3:
        return None
    return dict(moving if len(moving) <= 3 else [moving[(len(moving) - 1) * i // 2] for i in range(3)])


def alike(a, b):
    common = a.keys() & b.keys()
    return np.mean([a[t] @ b[t] for t in common]) if len(common) >= 3 else -2


def neighbours(pos, members, k):
    for a in members:
        yield a, sorted((b for b in members if b != a), key=lambda b: (((pos[a] - pos[b]) ** 2).sum(), b))[:k]


def parts_of(members, edges):
    own = {m: m for m in members}
    for _ in members:
        for a, b in edges:
            own[a] = own[b] = min(own[a], own[b])
    out = collections.defaultdict(list)
    for m in members:
        out[own[m]].append(m)
    return [out[k] for k in sorted(out)]


def own_scale(pos, members):
    gaps = [np.sqrt(min(((pos[a] - pos[b]) ** 2).sum() for b in members if b != a)) for a in members] if len(members) > 1 else []
    gaps = [g for g in gaps if g > 0]
    return np.median(gaps) if gaps else 1.0


def absorb(pos, groups, fixed):
    """``groups`` (kind, members) of one sort; who stays alone, then who is left."""
    left, alone = dict(enumerate(groups)), []
    while True:
        small = sorted((len(m), i) for i, (_, m) in left.items() if len(m) < 5)
        if not small:
            return alone + [left[i] for i in sorted(left)]
        i = small[0][1]
        kind, members = left.pop(i)
        middle = lambda j: np.median(pos[left[j][1]], axis=0)  # noqa: B023, E731
        far = {j: np.linalg.norm(middle(j) - np.median(pos[members], axis=0)) for j in left}
        j = min(far, key=lambda j: (far[j], j), default=None)
        if j is not None and far[j] < 5 * max(own_scale(pos, members), 1e-6):
            left[j] = ("world_fixed" if fixed else "co_moving", left[j][1] + members)
        else:
            alone.append((kind if fixed else "independent_dynamic", members))


def built(x):
    p, v, pos = x["p"], x["v"], x["pos"]
    frames, n = v.shape
    fixed = [q for q in range(n) if v[:, q].sum() >= 5 and np.sqrt(p[v[:, q], q].var(axis=0).sum()) < 0.05]
    steps = {q: [(t, p[t + 1, q] - p[t, q]) for t in range(frames - 1) if v[t, q] and v[t + 1, q]] for q in range(n)}
    desc = {q: d for q in range(n) if q not in fixed and len(steps[q]) >= 3 and (d := spread_out(steps[q]))}
    edges = [(a, b) for a, near in neighbours(pos, list(desc), 50) for b in near if a < b and alike(desc[a], desc[b]) >= 0.9]
    groups = [("co_moving" if len(m) >= 3 else "independent_dynamic", m) for m in parts_of(list(desc), edges)]
    cut = []
    for kind, m in groups:
        split = kind == "co_moving" and len(m) > 3
        for part in parts_of(m, [(a, b) for a, near in neighbours(pos, m, 10) for b in near]) if split else [m]:
            cut.append(("independent_dynamic" if split and len(part) < 3 else kind, part))

    def moves(m):
        steps = []
        for t in range(frames - 1):
            seen = [q for q in m if v[t, q] and v[t + 1, q]]
            if len(seen) >= 2:
                steps.append((t, np.median(p[t + 1, seen], axis=0) - np.median(p[t, seen], axis=0)))
        return spread_out(steps)

    able = {i: d for i, (kind, m) in enumerate(cut) if kind == "co_moving" and len(m) >= 5 and (d := moves(m))}
    if len(able) > 1:
        middle = {i: np.median(pos[cut[i][1]], axis=0) for i in able}
        reach = {i: 3 * max(own_scale(pos, cut[i][1]), 1e-6) for i in able}
        joins = [(a, b) for a in able for b in able if a < b and np.linalg.norm(middle[a] - middle[b]) <= reach[a] and alike(able[a], able[b]) >= 0.85]
        cut = [("co_moving", sorted(q for i in part for q in cut[i][1])) for part in parts_of(list(able), joins)] + [g for i, g in enumerate(cut) if i not in able]
    still = []
    if fixed:
        pieces = parts_of(fixed, [(a, b) for a, near in neighbours(pos, fixed, 15) for b in near]) if len(fixed) >= 3 else [fixed]
        still = absorb(pos, [("world_fixed", m) for m in pieces], True) if len(pieces) > 1 else [("world_fixed", fixed)]
    return still + absorb(pos, cut, False)


def draw(seq, *names):
    return hashlib.md5("|".join(map(str, (7, seq, *names))).encode()).hexdigest()


def budget(x, groups, frac=0.05):
    n = x["v"].shape[1]
    seen = {q: sorted(t for t in range(len(x["v"])) if x["v"][t, q] and (t, q) in x["o"]) for q in range(n)}
    rows = []
    for g, (kind, m) in enumerate(groups):
        steps = [np.linalg.norm(x["p"][t + 1, q] - x["p"][t, q]) for q in m for t in seen[q] if t + 1 in seen[q]]
        rows.append((g, kind, sum(bool(seen[q]) for q in m), np.mean(steps) if steps else 0.0))
    able = [r for r in rows if r[1] != "independent_dynamic"]
    total = min(int(frac * n), sum(r[2] for r in able))
    most = max((r[3] for r in able), default=0) or 1
    score = {r[0]: r[2] * (1 + r[3] / most) for r in able}
    k = dict.fromkeys(range(len(groups)), 0)
    if total > 0 and sum(score.values()) > 0:
        rest = {g: total * s / sum(score.values()) for g, s in score.items()}
        for g, _, size, _ in able:
            k[g] = min(int(rest[g]), size)
            rest[g] -= k[g]
        for _ in range(total - sum(k.values())):
            free = [g for g, _, size, _ in able if k[g] < size and rest[g] > -1]
            if free:
                g = max(free, key=lambda g: (rest[g], -g))
                k[g], rest[g] = k[g] + 1, rest[g] - 1
    return k, seen


def anchors(seq, g, members, k, seen):
    have = [q for q in members if seen[q]]
    if k <= 0 or len(have) < k:
        return []
    frames = [t for t in sorted({t for q in have for t in seen[q]}) if sum(t in seen[q] for q in have) >= k]
    order = lambda q: (draw(seq, g, q), q)
    if frames:
        t = min(frames, key=lambda t: (draw(seq, g, t), t))
        return [(q, t) for q in sorted((q for q in have if t in seen[q]), key=order)[:k]]
    return [(q, min(seen[q], key=lambda t: (draw(seq, g, q, t), t))) for q in sorted(have, key=order)[:k]]


def ratios(pred, true):
    a, b = np.linalg.norm(pred, axis=-1), np.linalg.norm(true, axis=-1)
    ok = (a > 1e-3) & (b > 0)
    return b[ok] / a[ok]


def similarity(src, dst):
    """Horn's closed form by quaternions, an independent way to the best rotation; the scale is the sum of singular values."""
    p, q = src - src.mean(axis=0), dst - dst.mean(axis=0)
    m = p.T @ q
    a = np.array([m[1, 2] - m[2, 1], m[2, 0] - m[0, 2], m[0, 1] - m[1, 0]])
    w, x, y, z = np.linalg.eigh(np.block([[np.array([[np.trace(m)]]), a[None]], [a[:, None], m + m.T - np.trace(m) * np.eye(3)]]))[1][:, -1]
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    s = np.linalg.svd(m, compute_uv=False).sum() / (p * p).sum()
    return s, r, dst.mean(axis=0) - s * r @ src.mean(axis=0)


def corrected(seq, x, groups, form_of=None, sizes=None, fitted=None):
    """Positions after all groups' corrections, anchors used, groups that moved; similarity fits go to ``fitted``."""
    p, v, c = x["p"], x["v"], x["c"]
    out, used, solved = p.copy(), 0, 0
    k, seen = budget(x, groups)
    k = sizes or k
    for g, (kind, m) in enumerate(groups):
        drawn = anchors(seq, g, m, k[g], seen) if kind != "independent_dynamic" else []
        if not drawn:
            continue
        used += len(drawn)
        angles = []
        for q in m:
            ray = [(p[t, q] - c[t]) / np.linalg.norm(p[t, q] - c[t]) for t in range(len(p)) if v[t, q]]
            angles.append(max((np.arccos(np.clip(a @ b, -1, 1)) for i, a in enumerate(ray) for b in ray[:i]), default=0.0))
        form = "anchor" if kind == "world_fixed" or np.median(angles) < np.deg2rad(2) else "camera"
        form = form_of or form
        pred, true = np.array([p[t, q] for q, t in drawn]), np.array([x["o"][t, q] for q, t in drawn])
        new = p[:, m].copy()
        place = {q: i for i, q in enumerate(m)}
        shifts = True
        if form == "sim3":
            spread = ((pred - pred.mean(axis=0)) ** 2).sum() / len(pred)
            if len(pred) >= 3 and spread >= 1e-12:
                s, r, t0 = similarity(pred, true)
                new, shifts = s * new @ r.T + t0, False
                if fitted is not None:
                    fitted[seq, g] = s, t0
        elif form == "anchor":
            r = ratios(pred[1:] - pred[0], true[1:] - true[0]) if len(pred) > 1 else []
            if len(r):
                new = true[0] + np.median(r) * (new - pred[0])
        else:
            centre = c[drawn[0][1]]
            alpha = np.median(ratios(pred - centre, true - centre))
            series = np.full(len(p), np.nan)
            for t in range(len(p)):
                cells = [q for q in sorted({q for q, _ in drawn}) if t in seen[q]]
                if cells:
                    series[t] = np.median(ratios(p[t, cells] - c[t], np.array([x["o"][t, q] for q in cells]) - c[t]))
            known = np.isfinite(series)
            filled = np.interp(np.arange(len(p)), np.flatnonzero(known), series[known])
            w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
            smooth = np.convolve(np.pad(filled, 8, mode="reflect"), w / w.sum(), mode="valid")
            per_frame = np.where(known, smooth, alpha)
            new = centre + alpha * (new - centre)
            new = c[:, None] + per_frame[:, None, None] * (new - c[:, None])
        if shifts:
            new = new + np.median(true - np.array([new[t, place[q]] for q, t in drawn]), axis=0)
        solved += np.linalg.norm(new - p[:, m]) > 1e-6
        out[:, m] = new
    return out, used, solved


def as_rows(df):
    return {(r.seq_id, r.query): (r.group_id, r.group_type) for r in df.collect()}


def cube(df, x, seq):
    out = np.full(x["p"].shape, np.nan)
    for r in df.where(f"seq_id = {seq}").collect():
        out[r.frame, r.query] = r.x, r.y, r.z
    return out


def test_whole_pipeline_with_built_groups(spark, sequences):
    """What the queries built_groups, rectify_full and rectify_diagnostics return."""
    from trackfix.plans.fixtures import scene
    from trackfix.plans.rectify import rectify

    s = scene(spark, SF)
    result = rectify(s.points, s.observations, s.cameras, CFG, seed=7)
    groups = {seq: built(x) for seq, x in sequences.items()}
    assert as_rows(result.groups) == {(seq, q): (g, kind) for seq, own in groups.items() for g, (kind, m) in enumerate(own) for q in m}
    found = {r.seq_id: (r.n_groups_total, r.n_groups_solved, r.n_anchors_used) for r in result.diagnostics.collect()}
    for seq, x in sequences.items():
        want, used, solved = corrected(seq, x, groups[seq])
        assert np.abs(cube(result.corrected, x, seq) - want).max() < 1e-9
        assert found[seq] == (sum(kind != "independent_dynamic" for kind, _ in groups[seq]), solved, used)


def test_absorption_and_world_fixed_split(spark, sequences):
    from trackfix.plans.queries import QUERIES

    want, still = {}, {}
    for s, x in sequences.items():
        cut = collections.defaultdict(list)
        for g, (kind, m) in enumerate(x["g"]):
            for q in m:
                cut[g + 20 if q % 40 == 0 else g, kind].append(q)
        cut = sorted(cut.items())
        done = [(kind, m) for (_, kind), m in cut if kind == "world_fixed"] + absorb(x["pos"], [(kind, m) for (_, kind), m in cut if kind != "world_fixed"], False)
        want |= {(s, q): (g, kind) for g, (kind, m) in enumerate(done) for q in m}
        fixed = [q for kind, m in x["g"] if kind == "world_fixed" for q in m]
        pieces = parts_of(fixed, [(a, b) for a, near in neighbours(x["pos"], fixed, 1) for b in near])
        assert s or len(pieces) > 1
        split = absorb(x["pos"], [("world_fixed", m) for m in pieces], True) if len(pieces) > 1 else [("world_fixed", fixed)]
        still |= {(s, q): (g, kind) for g, (kind, m) in enumerate(split + [h for h in x["g"] if h[0] != "world_fixed"]) for q in m}
    assert as_rows(QUERIES["fragment_absorption"](spark, SF)) == want
    assert as_rows(QUERIES["split_world_fixed"](spark, SF)) == still


def test_similarity_fits(spark, sequences):
    """With the budget and the observations that the queries use."""
    from trackfix.plans.queries import QUERIES

    got = QUERIES["corrected_full_sim3"](spark, SF).cache()
    fits = {(r.seq_id, r.group_id): r for r in QUERIES["sim3_fit"](spark, SF).collect()}
    fitted = {}
    for seq, x in sequences.items():
        k = budget(x | {"o": x["o"] | {(t, q): None for t in range(16) for q in range(0, x["v"].shape[1], 2) if t % 4 < 2}}, x["g"], 0.3)[0]
        want, _, _ = corrected(seq, x, x["g"], "sim3", k, fitted)
        assert np.abs(cube(got, x, seq) - want).max() < 2e-6
    assert fits.keys() == fitted.keys() and len(fits) > 3
    assert all(abs(fits[g].scale - s) < 2e-6 and np.abs(np.array([fits[g].tx, fits[g].ty, fits[g].tz]) - t).max() < 2e-6 for g, (s, t) in fitted.items())
    got.unpersist()


def test_numpy_sampler_draws_in_the_order_of_members(spark):
    from trackfix.operators.sampling import candidate_cells, sample_anchors_numpy

    rng, n, frames = np.random.default_rng(3), 12, 5
    visible = rng.random((frames, n)) < 0.6
    groups = [[9, 2, 11, 5, 0], [7, 1, 10, 3]]
    points = spark.createDataFrame([(0, t, q, 0.0, 0.0, 0.0, bool(visible[t, q])) for t in range(frames) for q in range(n)], "seq_id int, frame int, query int, x double, y double, z double, visible boolean")
    seen = points.where("visible").selectExpr("seq_id", "frame", "query", "x AS gx", "y AS gy", "z AS gz")
    members = spark.createDataFrame([(0, g, "co_moving", q, i) for g, m in enumerate(groups) for i, q in enumerate(m)], "seq_id int, group_id int, group_type string, query int, ord int")
    for k in (2, 4):
        sizes = spark.createDataFrame([(0, g, k) for g in range(2)], "seq_id int, group_id int, k int")
        got = [(r.group_id, r.query, r.frame) for r in sample_anchors_numpy(candidate_cells(points, seen, members, sizes), 5).orderBy("group_id", "ord").collect()]
        draws, want = np.random.default_rng(5), []
        for g, m in enumerate(groups):
            able = [q for q in m if visible[:, q].any()]
            full = [t for t in range(frames) if visible[t, able].sum() >= k]
            if len(able) < k:
                continue
            if full:
                t = int(draws.choice(full))
                want += [(g, int(q), t) for q in draws.choice(np.array(able)[visible[t, able]], size=k, replace=False)]
            else:
                want += [(g, int(q), int(draws.choice(np.flatnonzero(visible[:, q])))) for q in draws.choice(np.array(able), size=k, replace=False)]
        assert got == want and got
