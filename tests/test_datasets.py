import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import stats
from quadrat.operators import perceptual as pc
from quadrat.operators import priors as pr
from quadrat.operators import runs as rn
from quadrat.operators import sampling as sm
from quadrat.operators import splits as sp


def test_samples(spark):
    pool = spark.range(10)
    assert sm.sample_with_extras(pool, 4, "id").distinct().count() == 4
    more = sm.sample_with_extras(pool, 25, "id")
    assert more.count() == 25 and more.distinct().count() == 10
    with pytest.raises(ValueError, match="asked"):
        sm.sample_with_extras(pool, 11, "id", strict=True)
    assert sm.matched_size(pool, 23, "id").count() == 23
    assert sm.hybrid(pool, spark.range(100, 104), 0.25, "id").filter("is_synth").count() == 2  # half to even


def test_strata_and_choices(spark):
    rows = sm.strata(spark.range(10).withColumn("g", F.lit(0)), ["g"], ["id"], 4).orderBy("id").collect()
    assert [r.stratum for r in rows] == [-(-(i + 1) * 4 // 10) - 1 for i in range(10)]
    assert [r.stage for r in rows] == [i * 4 // 10 for i in range(10)]
    pick = sm.class_choice([("a", 1), ("b", 3)], F.col("u"))
    assert [r[0] for r in spark.createDataFrame([(0.1,), (0.25,), (0.9,)], "u double").select(pick).collect()] == ["a", "b", "b"]
    q = sm.inverse_cdf(F.array(*[F.lit(float(x)) for x in (0, 10, 40)]), F.col("u"))
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (0.75,), (1.0,)], "u double").select(q).collect()] == [0, 10, 25, 40]


def test_nearest_unused_and_tightest_window(spark):
    t = spark.createDataFrame([("g", 0, 5.0), ("g", 1, 5.1), ("g", 2, 9.0), ("g", 3, 9.0)], "g string, t int, value double")
    p = spark.createDataFrame([("g", 7, 5.0), ("g", 8, 6.0), ("g", 9, 8.0)], "g string, id long, value double")
    assert {r.t: r.id for r in sm.nearest_unused(t, p, ["g"]).collect()} == {0: 7, 1: 8, 2: 9}
    v = spark.createDataFrame([("g", x) for x in (1.0, 2.0, 2.2, 2.3, 9.0)], "g string, v double")
    r = sm.tightest_window(v, ["g"], "v", 3).first()
    assert (r.low, r.high) == (2.0, 2.3)


def test_hashes_and_greedy_choice(spark):
    rng = np.random.default_rng(1)
    base = [[float(x) for x in rng.random(64)] for _ in range(12)]
    near = [list(b) for b in base]
    for b in near:
        b[3] = 1.5 - b[3]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(base + near)], "id long, v array<double>")
    hashes = rows.select("id", pc.ahash(F.col("v")).alias("hash"))
    got = {r.id: r.hash & (2**64 - 1) for r in hashes.collect()}
    for i, v in enumerate(base + near):
        assert got[i] == sum(1 << (63 - k) for k in range(64) if v[k] > sum(v) / 64)
    pairs = {(r.a, r.b): r.distance for r in pc.close_pairs(hashes, 12).collect()}
    want = {(i, j): bin(got[i] ^ got[j]).count("1") for i in got for j in got if i < j and bin(got[i] ^ got[j]).count("1") <= 12}
    assert pairs == want
    kept, left = [], sorted(got)
    for i in left:
        if all((k, i) not in want for k in kept):
            kept.append(i)
    assert sorted(r.id for r in pc.keep_first(hashes.select("id"), pc.close_pairs(hashes, 12)).collect()) == kept
    assert sorted(r.id for r in pc.keep_unlike(hashes, 12).collect()) == kept


def test_band_plans(spark):
    rng = np.random.default_rng(2)
    values = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 20)]
    values += [v ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for v in values] + values[:3]
    table = spark.createDataFrame(list(enumerate(values)) + [(99, None)], "id long, hash long")
    for most in (0, 2, 6):
        want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin((values[i] ^ values[j]) & (2**64 - 1)).count("1") <= most}
        assert {(r.a, r.b) for r in pc.close_pairs(table, most).collect()} == want
    for n in (10, 10**5, 10**9):
        bands, turned = pc.band_plan(6, n)
        assert turned == 6 // bands
    with pytest.raises(ValueError, match="fewer bits"):
        pc.band_plan(20, 10**9)


def test_many_hashes_within_many_bits(spark, monkeypatch):
    rng = np.random.default_rng(6)
    values = rng.integers(-(2**63), 2**63 - 1, 3000)
    close = (lambda a, b: np.bitwise_count((a ^ b).view(np.uint64)))(values[:, None], values[None, :]) <= 20
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(close)) if i < j}
    table = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "id long, hash long")
    monkeypatch.setattr(pc, "MOST_COST", 0)  # bands would refuse; blocks do the whole job
    monkeypatch.setattr(pc, "ROUND", 500)
    assert {(r.a, r.b) for r in pc.close_pairs(table, 20).collect()} == want and len(want) > 1000
    kept = []
    for i in range(len(values)):
        if not close[i, kept].any():
            kept.append(i)
    assert sorted(r.id for r in pc.keep_unlike(table, 20).collect()) == kept
    monkeypatch.undo()
    near = spark.createDataFrame([(int(v) ^ m,) for v in values[:300] for m in (0, 3, 7)], "hash long").distinct()
    sets = [{(r.x, r.y, r.distance) for r in rows.collect()} for rows in (pc._banded(near, 4, *pc.band_plan(4, 900)), pc._compared(near, 4))]
    assert sets[0] == sets[1] and len(sets[0]) >= 900


def test_splits(spark):
    f = spark.createDataFrame([(1, "a", 2021), (2, "b", 2022), (3, "c", 2022)], "frame long, field string, year int")
    s = sp.assign(f, ["b"], ["c"])
    assert {r.field: r.split for r in s.collect()} == {"a": "train", "b": "test", "c": "val"}
    sp.assert_no_leakage(s)
    with pytest.raises(ValueError, match="zz"):
        sp.assign(f, ["zz"], [])
    with pytest.raises(ValueError, match="several"):
        sp.assert_no_leakage(s.unionByName(s.withColumn("split", F.lit("test"))))


def test_priors(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in range(5)] + [("b", 9.0)], "g string, v double")
    q = {r.g: r for r in pr.quantiles(rows, "g", "v", [0.1, 0.9]).collect()}
    assert q["a"].q == pytest.approx([0.4, 3.6]) and q["all"].n == 6 and q["b"].share == pytest.approx(1 / 6)
    assert {r.v for r in pr.gate(rows, F.col("v") > 100, ["g"]).collect()} == {0, 1, 2, 3, 4, 9}
    assert {r.v for r in pr.gate(rows, F.col("v") > 3, ["g"]).collect()} == {4, 9}
    assert spark.range(1).select(pr.upper_middle(F.array(F.lit(4), F.lit(1), F.lit(3), F.lit(2)))).first()[0] == 3
    reason = pr.first_reason([("low", F.col("v") > 1), ("high", F.col("v") < 4)])
    assert [r[0] for r in rows.filter("g = 'a'").orderBy("v").select(reason).collect()] == ["low", "low", "kept", "kept", "high"]


def test_p_values():
    assert stats.t_p(2.0, 2) == pytest.approx(1 - 2 / (4 + 2) ** 0.5)
    assert stats.t_p(0.0, 5) == pytest.approx(1)
    assert stats.wilcoxon_p(np.array([1.0, 2.0, 3.0])) == pytest.approx(0.25)
    assert stats.wilcoxon_p(np.zeros(3)) is None


def test_paired_runs(spark):
    m = spark.createDataFrame([("hybrid_yolo11_v2_r50_seed0", 0.5), ("hybrid_yolo11_v2_r50_seed1", 0.7), ("realonly_yolo11_seed0", 0.4), ("realonly_yolo11_seed1", 0.5), ("x", 1.0)], "run_name string, metric double")
    rows = rn.parsed(m)
    assert rows.count() == 4
    s = rn.sweep(rows).first()
    assert s.gain_real == pytest.approx(0.15) and s.matched is None
    p = rn.paired(rows.filter("kind = 'hybrid'"), rows.filter("kind = 'real'"), ["detector"]).first()
    assert p.n == 2 and p.t == pytest.approx(3.0)


def test_arms_and_seasons(spark):
    f = sm.seasons(spark.createDataFrame([(f"TOMATO_{1 + (i % 5 == 0)}__{i}",) for i in range(20)], "image string"), {2021: "TOMATO_1__", 2022: "TOMATO_2__"})
    pool = spark.createDataFrame([(f"s{i}", 2022) for i in range(3)], "image string, year int")
    rows = sm.arms(f, 2021, 2022, pool, "image").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image").alias("d"), F.count_if(F.col("image").startswith("s")).alias("s")).collect()
    found = {r.arm: (r.n, r.d, r.s) for r in rows}
    assert found.pop("M")[::2] == (20, 0) and found == {"A": (16, 16, 0), "B": (20, 20, 0), "T": (20, 19, 4)}
    with pytest.raises(ValueError, match="no season"):
        sm.seasons(spark.createDataFrame([("x",)], "image string"), {2021: "TOMATO_1__"})
    with pytest.raises(ValueError, match="neither season"):
        sm.arms(f.withColumn("year", F.lit(2020)), 2021, 2022, pool, "image")
    assert [r.image for r in sm.only_in(f.select("image"), f.filter("year = 2021").select("image"), ["image"]).orderBy("image").collect()] == sorted(f"TOMATO_2__{i}" for i in (0, 5, 10, 15))
    entries = spark.createDataFrame([("train", True), ("test", False)], "split string, is_synth boolean")
    sm.assert_real(entries)
    with pytest.raises(ValueError, match="synthetic image in test"):
        sm.assert_real(entries.withColumn("split", F.lit("test")))


def test_placements(spark):
    rng = np.random.default_rng(5)
    items = [(s, k, int(rng.integers(20, 60)), int(rng.integers(20, 60)), 120, 100) for s in range(8) for k in range(9)] + [(99, 0, 500, 10, 120, 100)]
    schema = "scene long, k long, width long, height long, scene_width long, scene_height long"
    put = sm.placements(spark.createDataFrame(items, schema), ["scene"], 10, 0.2).collect()
    assert len(put) == len(items)

    def share(a, b):
        w, h = (max(0, min(a[c] + a[d], b[c] + b[d]) - max(a[c], b[c])) for c, d in (("x", "width"), ("y", "height")))
        return w * h / min(a.width * a.height, b.width * b.height)

    for s in range(8):
        mine = [r for r in put if r.scene == s and r.x is not None]
        assert mine and all(0 <= r.x <= 120 - r.width and 0 <= r.y <= 100 - r.height for r in mine)
        assert all(share(a, b) <= 0.2 for a in mine for b in mine if a.k < b.k)
    assert any(r.x is None for r in put)
    free = sm.placements(spark.createDataFrame(items, schema), ["scene"], 10, 1.0).collect()
    assert all(r.x is not None for r in free)


def test_sizes_that_fit(spark):
    pool = spark.createDataFrame([("g", i, float(10 * i)) for i in range(1, 21)], "g string, id long, size double")
    wanted = spark.createDataFrame([("g", w, t) for w, t in enumerate((52.0, 100.0, 5000.0) * 10)], "g string, w long, target double")
    got = sm.pick_near_size(wanted, pool, ["g"], 1.25).collect()
    assert len(got) == 30 and {r.size for r in got if r.target == 52} <= {50.0, 60.0} and {r.size for r in got if r.target == 100} <= {80.0, 90.0, 100.0, 110.0, 120.0}
    assert {r.size for r in got if r.target == 5000} <= {float(x) for x in range(130, 201, 10)} and len({r.size for r in got}) > 4
    target = spark.createDataFrame([("g", float(x)) for x in range(100, 160)], "g string, size double")
    near = sorted(r.id for r in sm.matched_subsample(target, pool, ["g"], "size", 3).collect())
    assert near == [10, 13, 16] or near == [10, 13, 15]


def test_nearest_unused_in_a_large_pool(spark):
    rng = np.random.default_rng(5)
    wanted = [(g, t, float(v)) for g in "ab" for t, v in enumerate(np.round(rng.random(12) * 40, 1))]
    pool = [(g, int(i), float(v)) for g in "ab" for i, v in zip(rng.permutation(30_000), rng.integers(0, 45, 30_000))]
    few = [("c", i // 2, float(v)) for i, v in enumerate(rng.integers(0, 45, 18))]  # ids twice, fewer than targets
    wanted += [("c", t, float(v)) for t, v in enumerate(rng.integers(0, 45, 12))] + [("a", 99, None)]
    rows = pool + few + [("a", 50_000, None), ("b", None, 1.0), ("d", 1, 1.0)]
    want = {}
    for g in "abc":
        left = [(v, i) for h, i, v in pool + few if h == g]
        for _, t, v in sorted(x for x in wanted if x[0] == g and x[2] is not None):
            if left:
                want[g, t] = best = min(left, key=lambda p: (abs(p[0] - v), p[1]))[1]
                left = [p for p in left if p[1] != best]
    t, p = spark.createDataFrame(wanted, "g string, t int, value double"), spark.createDataFrame(rows, "g string, id long, value double")
    assert {(r.g, r.t): r.id for r in sm.nearest_unused(t, p, ["g"]).collect()} == want and len(want) == 33


def test_gates(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 9)], "g string, v int")
    assert pr.gate(rows, F.col("v") < 4, ["g"]).count() == 2
    assert pr.gate_or_fail(rows, F.col("v") > 4).count() == 2
    with pytest.raises(ValueError, match="all rows were rejected"):
        pr.gate_or_fail(rows, F.col("v") > 9)
    assert pr.spread(spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double"), "v").first().middle == 3
