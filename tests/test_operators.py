"""What SQL does not say: edges, walks and runs, against brute force on values of a generator."""

import contextlib
import io
import json
import math
import os
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from farpoint.config import DEFAULT
from farpoint.functions import geo, raster, score, stats, velocity
from farpoint.operators import catalog, conejoin, detection, matching, nullmodel, ranks, rescore, significance
from farpoint.plans import pipeline, report
from farpoint.sources import files, survey
from farpoint.streaming import monitor

KINDS = "idx long, lon_deg double, lat_deg double, radius_m double, freshness_index double, nls double, rcr double, ellipticity double, orientation_deg double, shape_reliable boolean, depth_proxy double"
OPPOSITE = dict(lon=-33.5, lat=12.25, r=5.5, fresh=0.31, nls=2.2, rcr=1.7, e=1.21, turn=17.0, reliable=False, depth=0.71)


def craters(spark, *rows):
    return spark.createDataFrame(list(rows), KINDS)


def pair(**change):
    """Two craters at the ends of a diameter, alike but for what ``change`` says of the second."""
    a = dict(OPPOSITE)
    b = a | dict(lon=a["lon"] + 180.0, lat=-a["lat"], fresh=0.32) | change
    return [(i, *x.values()) for i, x in enumerate((a, b))]


@pytest.mark.parametrize(
    ("change", "n"),
    [({}, 1), ({"lon": -23.0, "lat": 20.0}, 0), ({"r": 5.5 + DEFAULT.max_radius_diff_m + 0.1}, 0), ({"r": 5.5 + DEFAULT.max_radius_diff_m - 0.1}, 1), ({"nls": 2.2 - DEFAULT.max_nls_diff - 0.1}, 0), ({"rcr": 1.8 + DEFAULT.max_rcr_diff}, 0), ({"depth": 0.1}, 0)],
)
def test_pairs(spark, change, n):
    got = conejoin.build_pairs(craters(spark, *pair(**change))).collect()
    assert len(got) == n
    if not change:
        assert got[0]["score"] == pytest.approx(1.0) and got[0]["separation_deg"] == pytest.approx(180.0)


def test_no_pairs(spark):
    assert conejoin.build_pairs(craters(spark)).count() == 0
    assert conejoin.build_pairs(craters(spark, pair()[0])).count() == 0
    nothing = (0, *[None] * 10)
    assert conejoin.build_pairs(craters(spark, nothing, *[(i + 1, *r[1:]) for i, r in enumerate(pair())])).count() == 1


def test_missing_differences_reject_nothing(spark):
    for missing in (None, float("nan")):
        assert conejoin.build_pairs(craters(spark, *pair(nls=missing))).count() == 1


def walk(rows):
    used, out = set(), []
    for r in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
        if not used & {r[1], r[2]}:
            used |= {r[1], r[2]}
            out.append(r[1:])
    return out


def test_matching_is_the_walk(spark):
    rng = np.random.default_rng(3)
    e = [(i, int(a), int(b), float(s)) for i, (a, b, s) in enumerate(zip(rng.integers(0, 60, 400), rng.integers(40, 100, 400), rng.integers(0, 40, 400) / 40, strict=True)) if a != b]
    kind = "pair_id long, idx_a long, idx_b long, score double"
    df = spark.createDataFrame(e, kind)
    got = [tuple(r)[1:] for r in matching.non_overlapping(df).collect()]
    assert got == walk(e)
    assert [tuple(r)[1:] for r in matching.non_overlapping(df, 5).collect()] == walk(e)[:5]
    assert matching.non_overlapping(df.limit(0)).count() == 0
    again = spark.createDataFrame([*e, *[(i + 1000, *r) for i, *r in e[:50]], *[(i + 2000, a, b, s) for i, a, b, s in e[50:90]]], kind)
    assert [tuple(r)[1:] for r in matching.non_overlapping(again).collect()] == walk(e)  # repeated rows are taken once


def plain_discoveries(ps, alpha):
    order = sorted(ps)
    edge = max((p for k, p in enumerate(order, 1) if p <= alpha * k / len(order)), default=None)
    return sum(edge is not None and p <= edge for p in ps)


def test_discoveries(spark):
    rng = np.random.default_rng(11)
    for n, low in ((0, 0.0), (1, 0.0), (40, 0.2), (200, 0.5), (500, 1.0)):
        ps = [round(float(x), 3) for x in np.where(rng.random(n) < low, rng.random(n) ** 6, rng.random(n))]
        df = spark.createDataFrame([(p,) for p in [*ps, None]], "p_value double")
        for alpha in (0.05, 0.4):
            assert significance.with_discoveries(df, alpha).where("bh_significant").count() == plain_discoveries(ps, alpha)


def test_p_values(spark):
    rng = np.random.default_rng(12)
    scores, null = rng.integers(0, 50, 120) / 50, rng.integers(0, 50, 333) / 50
    pairs = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)] + [(900, None), (901, float("nan"))], "i long, score double")
    nulls = spark.createDataFrame([(float(x),) for x in null] + [(None,)], "score double")
    got = {r["i"]: r["p_value"] for r in significance.p_values(pairs, nulls).collect()}
    assert got[900] is None and got[901] is None and len(got) == 122
    assert all(got[i] == pytest.approx((sum(null >= s) + 1) / 334) for i, s in enumerate(scores))
    assert {r["p_value"] for r in significance.p_values(pairs.where("i < 5"), nulls.limit(0)).collect()} == {1.0}


def test_running_counts(spark):
    rng = np.random.default_rng(13)
    values = {float(v): int(n) for v, n in zip(rng.standard_normal(700), rng.integers(0, 9, 700), strict=True)}
    df = spark.createDataFrame(list(values.items()), "v double, n long")
    for ranges in (1, 7, 300):
        got = {r["v"]: r["up_to"] for r in ranks.running(df, "v", ranges=ranges).collect()}
        total = 0
        for v in sorted(values):
            total += values[v]
            assert got[v] == total
    assert ranks.running(df.limit(0), "v").count() == 0


def test_running_counts_of_groups(spark):
    rng = np.random.default_rng(15)
    rows = [(str(g), float(v), int(n)) for g in range(3) for v, n in zip(rng.permutation(60), rng.integers(1, 9, 60), strict=True)]
    for ranges in (1, 11):
        got = {(r["g"], r["v"]): r["up_to"] for r in ranks.running(spark.createDataFrame(rows, "g string, v double, n long"), "v", by=("g",), ranges=ranges).collect()}
        assert got == {(g, v): sum(m for h, w, m in rows if h == g and w <= v) for g, v, n in rows}


def test_percentiles(spark):
    """Against numpy, with ties, in few and many ranges, for groups of one value and of many."""
    rng = np.random.default_rng(16)
    values = {"a": rng.integers(0, 40, 501) / 7, "b": rng.standard_normal(300), "c": np.array([2.5]), "d": np.array([3.0, 3.0, 4.0])}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("a", None), ("b", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = {"least": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "three": 0.9987, "most": 1.0}
    for ranges in (1, 9, 200):
        got = {r["g"]: r for r in ranks.percentiles(df, "v", at, ("g",), ranges).collect()}
        assert got.keys() == values.keys() and all(got[g][n] == pytest.approx(np.quantile(x, q)) for g, x in values.items() for n, q in at.items())
        one = ranks.percentiles(df, "v", at, ranges=ranges).first()
        assert all(one[n] == pytest.approx(np.quantile(np.concatenate([*values.values()]), q)) for n, q in at.items())
    assert ranks.percentiles(df.limit(0), "v", at).first()["p50"] is None


def test_p_values_of_groups(spark):
    rng = np.random.default_rng(17)
    scores, null = {g: rng.integers(0, 20, 40) / 20 for g in "ab"}, {"a": rng.integers(0, 20, 90) / 20}
    pairs = spark.createDataFrame([(g, i, float(s)) for g, x in scores.items() for i, s in enumerate(x)], "h string, i long, score double")
    got = {(r["h"], r["i"]): r for r in significance.assess(pairs, spark.createDataFrame([(g, float(s)) for g, x in null.items() for s in x], "h string, score double"), 0.5, ("h",)).collect()}
    assert all(got["a", i]["p_value"] == pytest.approx((sum(null["a"] >= s) + 1) / 91) and got["b", i]["p_value"] == 1.0 for i, s in enumerate(scores["a"]))
    p = sorted(got["a", i]["p_value"] for i in range(40))
    edge = max((x for k, x in enumerate(p, 1) if x <= 0.5 * k / 40), default=-1)
    assert all(got["a", i]["bh_significant"] == (got["a", i]["p_value"] <= edge) for i in range(40)) and not any(got["b", i]["bh_significant"] for i in range(40))


def test_spearman_of_ties(spark):
    rng = np.random.default_rng(14)
    x, y = rng.integers(0, 9, 200).astype(float), rng.integers(0, 7, 200).astype(float)
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = stats.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double"), "x", "y").first()
    assert got["rho"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and got["n"] == 200


def test_tau_of_places(spark):
    rng = np.random.default_rng(15)
    rows = [(h, float(s)) for h in ("H0", "H1", "H2") for s in rng.integers(0, 6, 30) / 6]
    got = {(r["one"], r["other"]): r["tau"] for r in rescore.tau_matrix(spark.createDataFrame(rows, "hypothesis string, score double"), top=20).collect()}
    best = {h: sorted((s for x, s in rows if x == h), reverse=True)[:20] for h in ("H0", "H1", "H2")}
    for (a, b), tau in got.items():
        d = [(np.sign(best[a][i] - best[a][j]), np.sign(best[b][i] - best[b][j])) for i in range(20) for j in range(i)]
        assert tau == pytest.approx(sum(p * q for p, q in d) / math.sqrt(sum(p != 0 for p, _ in d) * sum(q != 0 for _, q in d)))
    with pytest.raises(ValueError, match="more than"):
        rescore.kendall(spark.range(rescore.LONGEST + 1).selectExpr("id AS k", "id AS x", "id AS y"), "x", "y", "k")


def test_hypotheses(spark):
    """A relaxed term is 1 for every pair; what no term reads changes nothing."""
    rows = [(i, (i * 61) % 360 - 180.0, (i * 29) % 150 - 75.0, 3.0 + i % 4 / 2, i / 100, 1.5 + i % 5 / 10, 3.0 + i % 4 / 10, 1.0 + i % 7 / 10, float(i * 13 % 180), i % 3 > 0, 0.5) for i in range(80)]
    pairs = conejoin.build_pairs(craters(spark, *rows)).cache()
    open_ = {h: rescore.rescored(pairs, s) for h, s in rescore.hypotheses().items()}
    assert open_["H1"].where("abs(T_radius - 1) > 1e-6").count() == 0 and open_["H2"].where("abs(T_ellipticity - 1) > 1e-6").count() == 0
    null = spark.createDataFrame([(t, 0.4) for t in range(20)], "trial long, score double")
    got = {r["hypothesis"]: r for r in rescore.rounds(pairs, rescore.grid_of(spark, rescore.hypotheses()), null, top=30).collect()}
    assert set(got) == {f"H{k}" for k in range(6)} and got["H0"]["tau"] == pytest.approx(1.0) and got["H4"]["best_score"] >= got["H0"]["best_score"]
    swept = rescore.sensitivity(pairs, rescore.sweep(spark, ("sigma_freshness", "sigma_radius"), [0.5, 2.0]), 0.1).collect()
    assert len({r["best_score"] for r in swept if r["parameter"] == "sigma_freshness"}) == 1 and len(swept) == 4
    detail = spark.createDataFrame([r.asDict() | {"trial": i % 3} for i, r in enumerate(pairs.limit(9).collect())], pairs.withColumn("trial", F.lit(0)).schema)
    assert rescore.rounds(pairs, rescore.grid_of(spark, rescore.hypotheses()), null, detail, top=5).count() == 6


def test_geometry(spark):
    rng = np.random.default_rng(16)
    wide = [*map(float, rng.uniform(-1000, 1000, 60)), -180.0, 180.0, 900.0]
    lon = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(wide)], "i long, x double").orderBy("i").select(geo.normalize_lon(F.col("x"))).collect()]
    assert lon == pytest.approx([(x + 180) % 360 - 180 for x in wide]) and all(-180 <= x < 180 for x in lon)
    get = lambda c: spark.range(1).select(c).first()[0]
    for at in ((12.0, 90.0), (179.999, 5.0), (-179.999, -5.0)):
        assert get(geo.bbox(F.lit(at[0]), F.lit(at[1]), F.lit(2e5))) is None
    assert get(geo.expected_ellipticity(F.lit(0.0))) == math.inf
    for sep in (35.0, 77.0, 141.0):
        assert get(geo.expected_ellipticity(F.lit(sep))) == pytest.approx(1 / math.sin(math.radians(sep) / 2))
    assert get(velocity.speed_from_offset(F.lit(0.0), F.lit(1e6))) == math.inf
    a, b = geo.unit(F.lit(-12.0), F.lit(0.0)), geo.unit(F.lit(33.0), F.lit(0.0))
    assert [p["lon"] for p in get(geo.arc_points(a, b, 46))] == pytest.approx(range(-12, 34), abs=1e-9)
    rim = get(geo.cap_boundary(geo.unit(F.lit(50.0), F.lit(-20.0)), F.lit(7.0), 25))
    centre = np.array([math.cos(math.radians(-20)) * math.cos(math.radians(50)), math.cos(math.radians(-20)) * math.sin(math.radians(50)), math.sin(math.radians(-20))])
    for p in rim:
        v = [math.cos(math.radians(p["lat"])) * math.cos(math.radians(p["lon"])), math.cos(math.radians(p["lat"])) * math.sin(math.radians(p["lon"])), math.sin(math.radians(p["lat"]))]
        assert math.degrees(math.acos(float(centre @ v))) == pytest.approx(7.0)
    assert get(velocity.max_physical_offset(60.0)) == pytest.approx(get(velocity.rotation_offset(F.lit(2 * 1_737_400.0), F.lit(60.0))))
    assert get(stats.survival_s(F.lit(3.0), anomalous=True)) == pytest.approx(get(stats.survival_s(F.lit(3.0))) / 56)


def test_null_trials(spark):
    same = craters(spark, *[(i, 3.0 * i, -8.0, 6.5, 0.2, 2.5, 4.0, None, None, False, 0.9) for i in range(7)])
    trials = spark.range(4).withColumnRenamed("id", "trial")
    assert {r["score"] for r in nullmodel.best_scores(same, trials).collect()} == {0.0}  # one fingerprint, so one crater and no pair
    a, b = nullmodel.streams(trials, 25).collect(), nullmodel.streams(trials.where("trial >= 2"), 25, block=7).collect()
    assert {tuple(r) for r in b} <= {tuple(r) for r in a} and len(a) == 100
    children = np.random.SeedSequence(DEFAULT.seed).spawn(4)
    for t, child in enumerate(children):
        rng = np.random.default_rng(child)
        z, phi = rng.uniform(-1.0, 1.0, 25), rng.uniform(0.0, 2.0 * np.pi, 25)
        own = sorted((r for r in a if r["trial"] == t), key=lambda r: r["row"])
        assert [r["lat_deg"] for r in own] == np.degrees(np.arcsin(z)).tolist() and [r["lon_deg"] for r in own] == (np.degrees(phi) - 180.0).tolist()
    assert nullmodel.streams(trials, 0).count() == 0
    assert [nullmodel.tasks(n, 4) for n in (0, 1, 4, 5, 9)] == [0, 1, 1, 2, 3]


def scattered_rows(n=60):
    return [(i, (i * 37) % 360 - 180.0, (i * 53) % 160 - 80.0, 3.0 + i % 3, i / 100, 1.5 + i % 5 / 10, 3.0 + i % 4 / 10, None, None, False, 0.5) for i in range(n)]


def test_run_resumes(spark, tmp_path):
    s, out = replace(DEFAULT, trials=6), str(tmp_path / "run")
    rows = craters(spark, *scattered_rows())
    first = pipeline.run(rows, out, s, chunks=2, top=5).first()
    assert first["n_trials"] == 6 and pipeline.run_chunk(spark, out, 0, 2, s) == 0
    with pytest.raises(ValueError, match="have no score"):
        pipeline.finish(spark, out, replace(s, trials=7))
    wanted = pipeline.marks(s, 5, 2, "")
    assert pipeline.state(spark, out, wanted) == {"prepared": True, "missing_chunks": [], "finished": True}
    before = {f: os.path.getmtime(f"{out}/{f}") for f in ("pairs", "top", "null", "summary")}
    assert pipeline.run(rows, out, s, chunks=2, top=5).first() == first
    assert before == {f: os.path.getmtime(f"{out}/{f}") for f in before}  # nothing was done again
    with pytest.raises(ValueError, match="trials .checkpoint 6, now 8"):
        pipeline.run(rows, out, replace(s, trials=8), chunks=2, top=5)
    assert pipeline.run(rows, out, replace(s, trials=8), chunks=2, top=5, force=True).first()["n_trials"] == 8
    # a chunk that lost its trials is the only one that is done again
    null = spark.read.parquet(f"{out}/null").where("chunk = 1").collect()
    spark.createDataFrame(null, pipeline.TRIAL).write.mode("overwrite").parquet(f"{out}/null")
    assert pipeline.state(spark, out, pipeline.marks(replace(s, trials=8), 5, 2, ""))["missing_chunks"] == [0]
    assert spark.read.csv(f"{out}/all_pairs_csv", header=True).count() == spark.read.parquet(f"{out}/pairs").count()
    assert {"trial", "score", "pair"} == set(spark.read.json(f"{out}/null_pairs_json").columns)


def test_run_of_streams(spark, tmp_path):
    """Chunk by chunk, resumed after a lost one, a run of numpy's streams gives the scores of one pass; each of them is that of a catalogue whose positions are replaced."""
    s, out = replace(DEFAULT, trials=5), str(tmp_path / "run")
    rows = craters(spark, *scattered_rows(40))
    pipeline.run(rows, out, s, chunks=3, top=5, positions="streams")
    got = {r["trial"]: r["score"] for r in spark.read.parquet(f"{out}/null").collect()}
    null = spark.read.parquet(f"{out}/null").where("chunk <> 1").collect()
    spark.createDataFrame(null, pipeline.TRIAL).write.mode("overwrite").parquet(f"{out}/null")
    pipeline.run(rows, out, s, chunks=3, top=5, positions="streams")
    assert {r["trial"]: r["score"] for r in spark.read.parquet(f"{out}/null").collect()} == got
    whole = nullmodel.best_scores(rows, spark.range(5).withColumnRenamed("id", "trial"), s, positions="streams")
    assert {r["trial"]: r["score"] for r in whole.collect()} == pytest.approx(got) and len(set(got.values())) > 1
    for t in (0, 3):
        places = {r["row"]: (r["lon_deg"], r["lat_deg"]) for r in nullmodel.streams(spark.range(t, t + 1).withColumnRenamed("id", "trial"), 40).collect()}
        moved = craters(spark, *[(r[0], *places[k], *r[3:]) for k, r in enumerate(scattered_rows(40))])
        best = conejoin.max_pair(conejoin.build_pairs(moved, s)).first()
        assert got[t] == pytest.approx(best["score"] if best else 0.0)
    with pytest.raises(ValueError, match="positions"):
        pipeline.run(rows, out, s, chunks=3, top=5)
    with pytest.raises(ValueError, match="catalogue"):
        pipeline.run(rows.where("idx <> 7"), out, s, chunks=3, top=5, positions="streams")
    with pytest.raises(ValueError, match="cone_deg"):
        pipeline.run(rows, out, replace(s, cone_deg=9.0), chunks=3, top=5, positions="streams")


def bowl(n, spots, noise=0.01, seed=5):
    """A chip with dark round spots (x, y, radius, depth), with flat floors, on a slope of light."""
    y, x = np.mgrid[:n, :n]
    image = 0.55 + 0.1 * x / n + np.random.default_rng(seed).normal(0, noise, (n, n))
    for cx, cy, r, depth in spots:
        image -= depth / (1 + (np.hypot(x - cx, y - cy) / r) ** 6)
    return np.clip(image, 0, 1)


SPOTS = [(20.0, 25.0, 5.0, 0.3), (70.0, 30.0, 8.0, 0.4), (45.0, 75.0, 6.0, 0.35)]
FEW = replace(DEFAULT, radius_range_m=(3.0, 14.0), peak_quantile=0.985, min_circularity=0.3, min_radius_px=2.0, n_scales=8)


def test_detection(spark):
    chips = [(0, 96, 96, bowl(96, SPOTS).ravel().tolist(), 1.0), (1, 96, 96, [0.25] * 96 * 96, 1.0), (2, 96, 96, None, 1.0)]
    df = spark.createDataFrame(chips, "chip_id long, h int, w int, pixels array<float>, mpp double")
    got = detection.detections(df, FEW, 40).collect()
    assert {r["chip_id"] for r in got} == {0}
    for x, y, r, _ in SPOTS:
        near = min(got, key=lambda f: math.hypot(f["x"] - x, f["y"] - y))
        assert math.hypot(near["x"] - x, near["y"] - y) < 2.5 and 0.5 * r < near["radius_px"] < 2 * r and near["rcr"] > 0
    states = {r["chip_id"]: (r["status"], len(r["rows"])) for r in detection.found(df, FEW).collect()}
    assert states == {0: ("ok", len(got)), 1: ("blank_chip", 0)}


def test_kernels_against_plain_loops():
    """Peaks, suppression, moments and contrast, each by its definition, cell by cell."""
    image = bowl(40, [(12.0, 14.0, 4.0, 0.3), (28.0, 26.0, 5.0, 0.4)], seed=6)
    cube = raster.scale_space(1 - image, np.geomspace(1.5, 5, 5))
    edge = float(np.quantile(cube, 0.97))
    want = set()
    for y, x, k in np.ndindex(cube.shape):
        around = cube[max(y - 2, 0) : y + 3, max(x - 2, 0) : x + 3, max(k - 1, 0) : k + 2]
        if cube[y, x, k] >= edge and cube[y, x, k] == around.max():
            want.add((y, x, k))
    assert {tuple(map(int, p)) for p in raster.peaks(cube, edge)} == want

    rng = np.random.default_rng(21)
    xy, r, strength = rng.uniform(0, 60, (80, 2)), rng.uniform(2, 9, 80), rng.uniform(0, 1, 80)
    kept = []
    for i in sorted(range(80), key=lambda i: -strength[i]):
        if all(math.dist(xy[i], xy[j]) > max(3.0, 0.75 * r[i]) for j in kept):
            kept.append(i)
    assert raster.suppressed(xy, r, strength).tolist() == kept

    patch = 1 - image[4:25, 2:23]  # 2.5 radii of 4 around (12, 14)
    w = np.maximum(patch - np.median(patch), 0)
    cells = [(x + 2, y + 4, w[y, x]) for y in range(21) for x in range(21)]
    total = sum(c[2] for c in cells)
    mx, my = sum(x * v for x, _, v in cells) / total, sum(y * v for _, y, v in cells) / total
    cov = np.array([[sum((x - mx) ** 2 * v for x, _, v in cells), sum((x - mx) * (y - my) * v for x, y, v in cells)], [sum((x - mx) * (y - my) * v for x, y, v in cells), sum((y - my) ** 2 * v for _, y, v in cells)]]) / total
    minor, major = np.sqrt(np.linalg.eigvalsh(cov))
    circ, e, turn, reliable, *_ = raster.shape_of(image, 12, 14, 4.0, confident=5.0)
    assert circ == pytest.approx(minor / major) and e == pytest.approx(major / minor) and not reliable
    axis = np.linalg.eigh(cov)[1][:, 1]
    assert abs(axis @ [math.cos(math.radians(turn)), math.sin(math.radians(turn))]) == pytest.approx(1.0)

    d = {(x, y): math.hypot(x - 28, y - 26) for y in range(40) for x in range(40)}
    zone = lambda a, b: np.array([image[y, x] for (x, y), v in d.items() if a * 4.0 <= v <= b * 4.0])
    assert raster.contrast_of(image, 28, 26, 4.0) == pytest.approx((zone(0.8, 1.3).mean() - zone(0, 0.5).mean()) / zone(2, 3).std())


def test_files(spark, tmp_path):
    assert files.read_csv(spark, str(tmp_path / "none.csv"), files.CRATERS).count() == 0
    for k, n in (("chip_0001", 2), ("chip_0000", 3)):
        os.makedirs(tmp_path / k)
        (tmp_path / k / "craters.csv").write_text("x,y,strength,radius_m\n" + "".join(f"{i},{i},{9 - i},abc\n" for i in range(n)))
    (tmp_path / "chip_0000" / "metadata.json").write_text(json.dumps({"status": "ok", "n_craters": 3, "chip_index": 0}))
    got = files.scan_chips(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["chip_dir"], r["chip_index"], r["idx"], r["radius_m"]) for r in got] == [("chip_0000", 0, 0, None), ("chip_0000", 0, 1, None), ("chip_0000", 0, 2, None), ("chip_0001", 1, 3, None), ("chip_0001", 1, 4, None)]
    assert sorted((r["chip_dir"], r["status"]) for r in files.scan_metadata(spark, str(tmp_path)).collect()) == [("chip_0000", "ok"), ("chip_0001", None)]
    q = monitor.watch_chips(spark, str(tmp_path)).writeStream.format("memory").queryName("seen").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("seen").collect()] == [("ok", 1, 3)]


def test_manifest_and_json_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("manifest_index,product_id,resolution_mpp\n4,M7,0.5\n5,M8,x\n")
    assert [(r["manifest_index"], r["product_id"], r["resolution_mpp"], r["center_lon"]) for r in files.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("manifest_index").collect()] == [(4, "M7", 0.5, None), (5, "M8", None, None)]
    (tmp_path / "bad.csv").write_text("product_id\nM7\n")
    with pytest.raises(ValueError, match="manifest_index"):
        files.read_manifest(spark, str(tmp_path / "bad.csv"))
    files.write_json(spark, {"a": 1, "b": [2]}, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j")).first()["a"] == 1
    (tmp_path / "broken.json").write_text("{")
    assert files.read_json(spark, str(tmp_path / "broken.json"), files.METADATA).first()["status"] is None
    files.write_csv(files.empty(spark, files.MANIFEST), str(tmp_path / "e"))
    assert files.read_csv(spark, str(tmp_path / "e"), files.MANIFEST).count() == 0
    header = "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv"))
    assert header.strip() == ",".join(f.name for f in files.MANIFEST)  # a file of a header alone
    assert survey.task_range(spark.range(10).withColumnRenamed("id", "manifest_index"), 1, 4, 7).count() == 3


def test_progress(spark):
    chunks = spark.range(4).withColumnRenamed("id", "chunk")
    parts = spark.createDataFrame([(0, 5.0), (0, 5.0), (2, 1.5)], "chunk long, runtime_s double")
    assert tuple(monitor.chunk_progress(chunks, parts).first()) == (2, 2, 3, 6.5)
    bars = [r[0] for r in spark.createDataFrame([(0, 4), (2, 4), (4, 4), (3, 0)], "d long, t long").select(monitor.bar(F.col("d"), F.col("t"), 8)).collect()]
    assert bars == ["[........]", "[####....]", "[########]", "[########]"]


def test_console_of_empty_tables(spark):
    pairs = spark.createDataFrame([], "idx_a long, idx_b long, score double, p_value double, separation_deg double, bh_significant boolean")
    got = {(r["section"], r["label"]): r["value"] for r in report.console(spark.createDataFrame([], "chip_index int"), spark.createDataFrame([], "chip_span_m double"), pairs, spark.createDataFrame([], "score double"), pairs, 7).collect()}
    assert got["catalogue", "craters"] == got["pairing", "raw pairs"] == got["null model", "trials"] == got["results", "significant pairs"] == 0.0 and got["pairing", "pairs without common ends, at most"] == 7.0
    assert got["results", "best score"] is None and got["results", "separation deg"] is None and got["null model", "95th percentile"] is None and got["catalogue", "craters per chip"] is None


def test_report_tables(spark):
    rows = craters(spark, *[(i, 40.0 * i - 100, 10.0 * i, 4.0, 0.5, 1.0, 1.0, 1.0 + i / 5, 20.0 * i, i != 2, 0.5) for i in range(4)])
    panels = report.cone_panels(rows, 6.0, 9).collect()
    assert {(r["idx"], r["bearing"]) for r in panels} == {(i, b) for i in (0, 1, 3) for b in (0, 1)} and len(panels) == 54
    shape = report.outlines(spark.createDataFrame([(5.0, 4.0), (5.0, None)], "radius_px double, ellipticity double")).collect()
    assert [(r["half_major"], r["half_minor"]) for r in shape] == [(10.0, 2.5), (5.0, 5.0)]
    seen = {r["idx"]: r for r in report.projected(rows, F.lit(-100.0), F.lit(0.0)).collect()}
    assert (seen[0]["right"], seen[0]["up"]) == pytest.approx((0.0, 0.0)) and seen[0]["visible"] and not seen[3]["visible"]
    assert len({r["idx"] for r in stats.hashed_sample(rows, 2).collect()}) == 2 and stats.hashed_sample(rows, 2).collect() == stats.hashed_sample(rows.orderBy(F.desc("idx")), 2).collect()
    strength = [r[0] for r in spark.createDataFrame([(6.0,), (3.0,)], "s double").select(score.relative_strength(F.col("s"), F.lit(3.0))).collect()]
    assert strength == pytest.approx([2.0, 1.0])


def test_limb_is_seen(spark):
    """Points 90 degrees from the one below the eye, whatever way their depth is rounded."""
    at = [(40.0, -65.0), (-140.0, 65.0), (130.0, 0.0), (-50.0, 0.0), (40.0, -65.01), (-140.0, 64.99)]
    seen = report.projected(craters(spark, *[(i, lon, lat, 4.0, 0.5, 1.0, 1.0, 1.0, 0.0, True, 0.5) for i, (lon, lat) in enumerate(at)]), F.lit(40.0), F.lit(25.0))
    assert [r["visible"] for r in seen.orderBy("idx").collect()] == [True] * 4 + [False] * 2


def taken_in_order(rows, k=None):
    out, used = [], set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used and b not in used and (k is None or len(out) < k):
            used |= {a, b}
            out.append((a, b, s))
    return out


@pytest.mark.parametrize("size", [50, 200_000])
def test_matching_of_rising_paths(spark, monkeypatch, size):
    """Ten thousand pairs whose scores rise along a path: one a round would be five thousand rounds."""
    made = []
    monkeypatch.setattr(matching, "saved", lambda df, save=matching.saved: made.append(1) or save(df))
    n = 10_000 if size > 1_000 else 200
    rows = [(i, i + 1, float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, "idx_a long, idx_b long, score double").repartition(4)
    assert [tuple(r) for r in matching.non_overlapping(df, walk=size).collect()] == taken_in_order(rows)
    assert len(made) <= 2 * (4 + n // size) + 1
    made.clear()
    assert [tuple(r) for r in matching.non_overlapping(df, 30, walk=size).collect()] == taken_in_order(rows, 30) and len(made) <= 8


def test_matching_against_the_walk(spark):
    rng = np.random.default_rng(18)
    rows = [(int(a), int(b) + 60, float(s)) for (a, b), s in zip({(int(x), int(y)) for x, y in rng.integers(0, 60, (700, 2))}, rng.integers(0, 30, 700), strict=False)]
    df = spark.createDataFrame(rows, "idx_a long, idx_b long, score double")
    for k, size in ((None, 7), (None, 10**6), (5, 10**6), (100, 9), (0, 9)):
        assert [tuple(r) for r in matching.non_overlapping(df, k, walk=size).collect()] == taken_in_order(rows, k)


@pytest.mark.parametrize("angle", [2.0, 10.0])
def test_crowded_cone(spark, angle):
    """Half of all rows in one cone, their centres in another: pairs are those of all rows, and no key has more than a few times the comparisons that it may."""
    rng = np.random.default_rng(19)
    n, most = 600, 3000

    def points(m, spread):
        v = rng.standard_normal((m, 3)) * [spread, spread, 1 if spread == 1 else 0] + ([0, 0, 0] if spread == 1 else [0.6, 0.0, 0.8])
        return v / np.linalg.norm(v, axis=1)[:, None]

    v = np.vstack([points(n // 2, math.radians(angle) / 8), points(n // 2, 1)])
    c = np.vstack([points(n // 2, math.radians(angle) / 8), points(n // 2, 1)])
    order = rng.permutation(n)
    rows = [(int(i), *map(float, x), *map(float, y)) for i, x, y in zip(order, v, c, strict=True)]
    probe = spark.createDataFrame([(i, *y) for i, *y in ((r[0], *r[4:]) for r in rows)], "p_idx long, p_cx double, p_cy double, p_cz double")
    build = spark.createDataFrame([r[:4] for r in rows], "b_idx long, b_vx double, b_vy double, b_vz double")
    got = sorted((r["p_idx"], r["b_idx"]) for r in conejoin.in_cone(probe, build, angle, most=most).select("p_idx", "b_idx").collect())
    chord = 2 * math.sin(math.radians(angle) / 2)
    assert got == sorted((p, b) for p, *_, x, y, z in rows for b, bx, by, bz, *_ in rows if b > p and (bx - x) ** 2 + (by - y) ** 2 + (bz - z) ** 2 <= chord * chord)
    assert got == sorted((r["p_idx"], r["b_idx"]) for r in conejoin.in_cone(probe, build, angle).select("p_idx", "b_idx").collect())
    left, right, on = conejoin.keyed(probe, build, angle, most=most)
    work = left.groupBy(*on).count().withColumnRenamed("count", "l").join(right.groupBy(*on).count(), on).select((F.col("l") * F.col("count")).alias("w")).collect()
    assert "part" in on and max(r["w"] for r in work) <= 2 * most


def explained(df, mode):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def many_craters(spark, n):
    rng = np.random.default_rng(23)
    lon, lat = rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    return craters(spark, *[(i, float(lon[i]), float(lat[i]), 3.0 + i % 7 / 4, i / n, 1.5 + i % 5 / 10, 3.0 + i % 4 / 10, 1.0 + i % 9 / 40 if i % 6 else None, float(i * 13 % 180), i % 3 > 0, 0.5) for i in range(n)])


def test_pairs_in_small_methods(spark):
    """No side of the join is broadcast, and no generated method is larger than the JVM compiles."""
    pairs = conejoin.build_pairs(many_craters(spark, 30), most=None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "Broadcast" not in explained(pairs, "simple")
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", explained(pairs, "codegen")))) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_top_pairs(spark):
    """With a bound from some rows' pairs, the best are those of all pairs, ties and all."""
    c = many_craters(spark, 400)
    every = conejoin.build_pairs(c).withColumn("score", F.round("score", 9)).cache()
    for n, pilot in ((1, 40), (30, 100)):
        assert [r[:3] for r in conejoin.top_pairs(c, n, pilot=pilot).select("idx_a", "idx_b", "score").collect()] == [r[:3] for r in conejoin.best_pairs(every, n).select("idx_a", "idx_b", "score").collect()]


def test_sweep_of_some_pairs(spark):
    """What is left out below the bounds of a part of the pairs changes nothing."""
    pairs = conejoin.build_pairs(many_craters(spark, 200)).cache()
    grid = rescore.sweep(spark, factors=[0.4, 1.0, 2.5])
    every = rescore.under(pairs, grid).withColumn("score", F.round("score", 9)).cache()
    for limit in (0.2, 0.9):
        got = {(r["parameter"], r["scale"]): (r["best_score"], r["n_above"]) for r in rescore.sensitivity(pairs, grid, limit, slices=3).collect()}
        assert got == {(r["parameter"], r["scale"]): (r["b"], r["n"]) for r in every.groupBy("parameter", "scale").agg(F.max("score").alias("b"), F.count_if(F.col("score") >= limit).alias("n")).collect()}
