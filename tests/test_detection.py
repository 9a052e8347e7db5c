import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat import storage
from quadrat.operators import curves as cv
from quadrat.operators import evaluation as ev
from quadrat.operators import matching as mt
from quadrat.plans import detection as plans

BOX = "seed int, tile_id long, cls int, {} int, x1 double, y1 double, x2 double, y2 double"


def tables(spark, gt, det):
    g = spark.createDataFrame([(0, 0, c, i, *map(float, b)) for c, i, b in gt], BOX.format("gid"))
    d = spark.createDataFrame([(0, 0, c, i, *map(float, b), s) for c, i, b, s in det], BOX.format("did") + ", conf double")
    return g, d


def test_greedy_takes_each_box_once(spark):
    gt = [(0, 1, (0, 0, 10, 10)), (0, 2, (20, 0, 30, 10))]
    det = [(0, 1, (0, 0, 10, 9), 0.9), (0, 2, (0, 0, 10, 10), 0.8), (0, 3, (20, 0, 30, 10), 0.7), (1, 1, (0, 0, 10, 10), 0.6)]
    g, d = tables(spark, gt, det)
    m = {(r.cls, r.did): r.gid for r in mt.match(d, g, ["seed", "tile_id", "cls"], [0.5]).collect()}
    assert m == {(0, 1): 1, (0, 3): 2}


def test_tie_takes_the_first_box(spark):
    gt = [(0, 1, (0, 0, 10, 10)), (0, 2, (0, 0, 10, 10))]
    g, d = tables(spark, gt, [(0, 1, (0, 0, 10, 10), 0.9)])
    assert mt.match(d, g, ["seed", "tile_id", "cls"], [0.5]).first().gid == 1


def test_no_rows(spark):
    g, d = tables(spark, [], [])
    assert mt.match(d, g, ["seed", "tile_id", "cls"], [0.5]).count() == 0
    g, d = tables(spark, [(0, 1, (0, 0, 9, 9))], [])
    assert mt.crowding(g, ["seed", "tile_id"]).first().crowding == 0


def reference_ap(conf, tp, ignored, n_gt):
    if n_gt <= 0:
        return None
    order = np.argsort(-conf, kind="stable")
    t, v = (tp * ~ignored)[order], (~ignored[order]).astype(float)
    ct, cv = np.cumsum(t), np.cumsum(v)
    if not len(ct) or ct[-1] == 0:
        return 0.0
    rec, prec = ct / n_gt, ct / np.maximum(cv, 1e-9)
    env = np.maximum.accumulate(prec[::-1])[::-1]
    grid = np.arange(101) * 0.01
    return float(np.interp(grid, rec, env, left=env[0], right=0.0).mean())


def test_average_precision_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows, totals, want = [], [], {}
    for c in range(25):
        n = int(rng.integers(0, 40))
        conf = np.round(rng.random(n), 1 if c % 2 else 6)
        tp = rng.choice([0.0, 1.0, 0.5], n)  # halves add up without rounding
        ignored = rng.random(n) < 0.2
        n_gt = float(rng.integers(0, 3) + tp.sum() // 1) if c % 7 else 0.0
        totals.append((c, n_gt))
        rows += [(c, i, float(conf[i]), float(tp[i]), bool(ignored[i])) for i in range(n)]
        want[c] = reference_ap(conf, tp, ignored, n_gt)
    r = spark.createDataFrame(rows, "cell int, k int, conf double, tp double, ignored boolean")
    got = {x.cell: x.ap for x in ev.average_precision(r, spark.createDataFrame(totals, "cell int, n_gt double"), ["cell"], ["k"]).collect()}

    for c, ap in want.items():
        assert (got[c] is None) if ap is None else got[c] == pytest.approx(ap, abs=1e-9), c


def test_taxonomy(spark):
    gt = [(0, 1, (0, 0, 10, 10)), (1, 1, (50, 50, 60, 60))]
    det = [(0, 1, (0, 0, 10, 10), 0.9), (0, 2, (0, 0, 10, 10), 0.8), (0, 3, (50, 50, 60, 60), 0.7), (0, 4, (90, 90, 99, 99), 0.6)]
    g, d = tables(spark, gt, det)
    e = {r.did: (r.hit, r.error, r.confused_with) for r in ev.taxonomy(d, g, ["seed", "tile_id"]).collect()}
    assert e == {1: (True, None, None), 2: (False, "loc", None), 3: (False, "cls", 1), 4: (False, "bkg", None)}


def test_golden_counts(spark):
    from quadrat.plans.detection import greedy_match_50

    got = {r.cls: r.tp for r in greedy_match_50(spark, "/root/testdata/sf0.01").collect()}
    assert [got[c] for c in range(5)] == [7943, 15723, 16025, 7726, 7757]


def test_bootstrap_draws_as_many_as_there_are(spark):
    units = spark.range(30).select(F.lit(0).alias("seed"), F.col("id").alias("tile_id"))
    w = [np.frombuffer(bytes(r.w), np.uint8) for r in ev.bootstrap_weights(units, ["seed", "tile_id"], 5).collect()]
    assert len(w) == 30 and (np.sum(w, 0) == 30).all() and len(w[0]) == 5


def test_bootstrap_queries_against_brute_force(spark):
    sf, n = "/root/testdata/sf0.001", 1000

    def digest(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)

    gt = plans.gt_box(spark, sf)
    units = sorted({(r.seed, r.tile_id) for r in gt.select("seed", "tile_id").collect()}, key=lambda u: (digest(0, *u), u))
    number = {u: k for k, u in enumerate(units)}
    w = np.array([np.bincount([digest(0, b, k) % len(units) for k in range(len(units))], minlength=len(units)) for b in range(n)])
    truth = {}
    for r in ev.truth_counts(gt, plans.UNIT).filter("bin = 'all'").collect():
        truth.setdefault(r.cls, np.zeros(len(units)))[number[r.seed, r.tile_id]] += r.n_gt

    def maps(arm):
        rows = ev.evaluated(ev.top_k(plans._det(spark, sf, arm)), gt, plans.UNIT, [0.5]).filter("bin = 'all'").collect()
        rows.sort(key=lambda r: (-r.conf, r.seed, r.tile_id, r.did))
        aps = []
        for cls, n_gt in truth.items():
            own = [r for r in rows if r.cls == cls]
            at, tp = np.array([number[r.seed, r.tile_id] for r in own]), np.array([r.tp for r in own])
            for b in range(n):
                seen = np.cumsum(w[b, at])
                hits = np.cumsum(w[b, at] * tp)[seen > 0]
                rec, env = hits / (n_gt @ w[b]), np.maximum.accumulate((hits / seen[seen > 0])[::-1])[::-1]
                aps.append(np.interp(np.arange(101) * 0.01, rec, env, right=0).mean())
        return np.reshape(aps, (-1, n)).mean(0)

    a, b = maps(0), maps(1)
    got = plans.bootstrap_ci(spark, sf).first()
    assert got.resamples == n and np.allclose([got.mean, got.low, got.high], [a.mean(), *np.quantile(a, [0.025, 0.975])], atol=2e-6)
    d, got = b - a, plans.paired_bootstrap_delta(spark, sf).first()
    assert got.resamples == n and np.allclose([got.delta, got.low, got.high], [d.mean(), *np.quantile(d, [0.025, 0.975])], atol=2e-6)
    assert got.p == 2 * min((d <= 0).sum(), (d >= 0).sum()) / n


def test_draws_are_digests():
    for n, resample in ((1, 0), (11, 3), (1234, 999)):
        draws = [int(hashlib.md5(f"0|{resample}|{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)]
        assert (cv.drawn_counts(0, resample, n, 100) == np.bincount(draws, minlength=n)).all()


def test_streamed_curve_against_numpy():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(0, 60))
        tp, w = rng.choice([0.0, 1.0, 0.5], n), rng.integers(0, 3, n).astype(np.uint8)
        for weight in (None, w):
            many = np.ones(n, int) if weight is None else w
            n_gt = float(rng.integers(0, 3) + (tp * many).sum() // 1)
            curve = cv.Curve(n_gt)
            for part in np.array_split(np.arange(n), 3):
                curve.add(*cv.hits(tp[part]), None if weight is None else weight[part])
            live = many > 0
            t, v = np.cumsum(tp * many)[live], np.cumsum(many)[live]
            if not n_gt or not len(t) or not t[-1]:
                assert curve.value() == (0.0 if n_gt else None)
                continue
            env = np.maximum.accumulate((t / v)[::-1])[::-1]
            assert curve.value() == pytest.approx(np.interp(np.arange(101) * 0.01, t / n_gt, env, left=env[0], right=0.0).mean(), abs=1e-9)


def test_bootstrap_stores_no_weights(spark, monkeypatch):
    """What is stored grows with detections, not with detections and resamples."""
    stored = []
    table = storage.Scratch.table
    monkeypatch.setattr(storage.Scratch, "table", lambda self, df, name: stored.append((name, df.columns)) or table(self, df, name))
    assert plans.bootstrap_ci(spark, "/root/testdata/sf0.001").first().resamples == 1000
    assert stored and not any("w" in columns for _, columns in stored)


def scattered(spark, images=6, seed=8):
    rng = np.random.default_rng(seed)
    gt, det = [], []
    for tile in range(images):
        for cls in range(2):
            for k in range(int(rng.integers(0, 8))):
                x, y, w, h = (float(v) for v in rng.integers(1, 150, 4))
                gt.append((0, tile, cls, k + 1, x, y, x + w, y + h))
                det.append((0, tile, cls, k + 1, x + 2, y - 1, x + w + float(rng.integers(0, 30)), y + h, float(np.round(rng.random(), 1))))
    return spark.createDataFrame(gt, BOX.format("gid")), spark.createDataFrame(det, BOX.format("did") + ", conf double")


def test_bins_and_thresholds_in_one_row(spark, monkeypatch):
    g, d = scattered(spark)
    unit, thresholds = ["seed", "tile_id"], [0.5 + 0.02 * k for k in range(23)]  # more than a long holds
    cells = ev.truth_counts(g, unit).groupBy("cls", "bin").agg(F.sum("n_gt").alias("n_gt")).withColumn("thr", F.explode(F.array(*map(F.lit, thresholds))))
    want = {(r.cls, r.bin, r.thr): (r.n_gt, r.ap) for r in ev.average_precision(ev.evaluated(d, g, unit, thresholds), cells, ["cls", "bin", "thr"], [*unit, "did"]).collect()}
    monkeypatch.setattr(ev, "live_rows", None)  # a row for each detection, threshold and bin is not made
    got = {(r.cls, r.bin, r.thr): (r.n_gt, r.ap) for r in ev.ap_by_bin(d, g, unit, thresholds).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert plans.map50_95(spark, "/root/testdata/sf0.001").count() == 4


def test_settings_are_bits_of_a_row(spark, monkeypatch):
    g, d = scattered(spark)
    unit, variants = ["seed", "tile_id"], {"none": ("iou", 0.0, 1.0), "both": ("ioa", 0.95, 0.75)}
    near = [0, 1, 2, 3]
    settings = spark.createDataFrame([(0, t, s) for s in range(65) for t in range(6) if s != 7 or t in near], "seed int, tile_id long, setting int")
    monkeypatch.setattr(ev, "average_precision", None)  # a row for each detection, variant and setting is not made
    got = {(r.setting, r.variant, r.cls): (r.n_gt, r.ap) for r in ev.adjusted(d, g, unit, variants, settings).collect()}
    keep = F.col("tile_id").isin(near)
    for rows, setting in (((d, g), 64), ((d.filter(keep), g.filter(keep)), 7)):
        want = {(setting, r.variant, r.cls): (r.n_gt, r.ap) for r in ev.adjusted(*rows, unit, variants).collect()}
        assert want and {k: v for k, v in got.items() if k[0] == setting} == want
