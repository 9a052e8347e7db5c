"""Assignment of detections to true boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import box, match_score, size_key


def scored_pairs(det: DataFrame, gt: DataFrame, keys: list[str], mode: str = "iou") -> DataFrame:
    """Every detection with every true box of its cell: keys, did, gid, overlap. One shuffle, on the cell."""
    right = gt.select(*keys, "gid", *(F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")))
    return det.join(right, keys).select(*keys, "did", "gid", match_score(box(), box("g_"), mode).alias("overlap"))


def greedy(pairs: DataFrame, keys: list[str], thresholds: list[float], order: str = "did", taken: str = "gid") -> DataFrame:
    """One-to-one matches at each threshold: keys, thr, order and taken column, overlap.

    In ascending order, each row of a cell takes the free partner of largest overlap that reaches
    the threshold, of equal ones the first. Pairs below all thresholds are dropped before a cell's list
    is made; one pass over the sorted list settles a threshold. A cell is one class in one image.
    """
    least = min(thresholds)
    cells = pairs.filter(F.col("overlap") >= least).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("d"), (-F.col("overlap")).alias("n"), F.col(taken).alias("g")))).alias("list")
    )
    start = F.expr("named_struct('d', cast(null as int), 'out', cast(array() as array<struct<d:int,g:int,o:double>>))")

    def at(thr: Column) -> Column:
        def step(st: Column, x: Column) -> Column:
            free = ~F.exists(st["out"], lambda m: m["g"] == x["g"])
            takes = (st["d"].isNull() | (st["d"] != x["d"])) & (-x["n"] >= thr) & free
            found = F.struct(x["d"].cast("int").alias("d"), x["g"].cast("int").alias("g"), (-x["n"]).alias("o"))
            return F.struct(F.when(takes, x["d"].cast("int")).otherwise(st["d"]).alias("d"), F.when(takes, F.concat(st["out"], F.array(found))).otherwise(st["out"]).alias("out"))

        return F.aggregate("list", start, step, lambda st: st["out"])

    levels = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = cells.select(*keys, F.explode(F.transform(levels, lambda t: F.struct(t.alias("thr"), at(t).alias("out")))).alias("m"))
    rows = rows.select(*keys, "m.thr", F.explode("m.out").alias("x"))
    return rows.select(*keys, "thr", F.col("x.d").alias(order), F.col("x.g").alias(taken), F.col("x.o").alias("overlap"))


def candidates(det: DataFrame, gt: DataFrame, unit: list[str], least: float, mode: str = "iou", across: bool = False) -> DataFrame:
    """One row per detection: unit, cls, did, conf (if there), d_size and partners, the boxes of its class that it overlaps by at least.

    A partner is g (gid), n (the overlap, negative, so that lists sort by falling overlap) and s (its size).
    One join on the cell, whose partitioning all that follows keeps. Of the pairs only those that matter are gathered, and
    those with a cell's first box, so that every detection stays. across joins on the image instead and adds the largest IoU with a box of the same class (best_same), of another one (best_other) and the latter's class (other_cls); 0, 0, null without.
    """
    keys = [*unit, "cls"]
    first = F.row_number().over(Window.partitionBy(*unit).orderBy("cls", "gid") if across else Window.partitionBy(*keys).orderBy("gid")) == 1
    right = gt.select(*unit, F.col("cls").alias("g_cls"), "gid", first.alias("first"), *(F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = det.join(right, unit, "left") if across else det.join(right.withColumnRenamed("g_cls", "cls"), keys, "left")
    same = (F.col("cls") == F.col("g_cls")) if across else F.lit(True)
    score, plain = (F.when(F.col("gid").isNotNull(), match_score(box(), box("g_"), m)) for m in (mode, "iou"))
    carried = ["conf"] if "conf" in det.columns else []
    pairs = pairs.select(*keys, "did", *carried, size_key(box()).alias("d_size"), "gid", size_key(box("g_")).alias("s"), score.alias("o"), "first", *([same.alias("same"), "g_cls", plain.alias("p")] if across else []))
    pairs = pairs.filter((F.col("o") >= least) | F.col("first") | F.col("gid").isNull() | (F.col("p") > 0 if across else F.lit(False)))
    same = F.col("same") if across else F.lit(True)
    partner = F.when(same & (F.col("o") >= least), F.struct((-F.col("o")).alias("n"), F.col("gid").cast("int").alias("g"), "s"))
    bests = []
    if across:
        bests = [F.coalesce(F.max(F.when(same, F.col("p"))), F.lit(0.0)).alias("best_same"), F.max(F.when(~same, F.struct(F.col("p").alias("o"), (-F.col("g_cls")).alias("c")))).alias("_other")]
    rows = pairs.groupBy(*keys, "did").agg(*(F.first(c).alias(c) for c in [*carried, "d_size"]), F.sort_array(F.collect_list(partner)).alias("partners"), *bests)
    if across:
        rows = rows.withColumns({"best_other": F.coalesce("_other.o", F.lit(0.0)), "other_cls": F.when(F.col("_other.o") > 0, -F.col("_other.c"))}).drop("_other")
    return rows


def assigned(found: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Rows of candidates, each with hit0, hit1, ...: the partner that it gets at each threshold, or null.

    In the order of did, a detection takes its free partner of largest overlap that reaches the threshold, of equal
    ones the first. A cell (one class in one image) is a short list, walked once for each threshold.
    """
    rest = [c for c in found.columns if c not in (*keys, "did")]
    cells = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("did", *rest))).alias("x"))
    none = F.expr("cast(array() as array<struct<n:double,g:int,s:double>>)")

    def walk(thr: float) -> Column:
        def step(taken: Column, x: Column) -> Column:
            free = F.filter(x["partners"], lambda p: (-p["n"] >= thr) & ~F.coalesce(F.exists(taken, lambda m: m["g"] == p["g"]), F.lit(False)))
            return F.concat(taken, F.array(F.get(free, F.lit(0))))

        return F.aggregate("x", none, step)

    names = [f"hit{k}" for k in range(len(thresholds))]
    cells = cells.select(*keys, "x", *(walk(float(t)).alias(n) for t, n in zip(thresholds, names)))
    rows = cells.select(*keys, F.inline(F.arrays_zip("x", *names)))
    return rows.select(*keys, "x.*", *names)


def match(det: DataFrame, gt: DataFrame, keys: list[str], thresholds: list[float], mode: str = "iou") -> DataFrame:
    """Greedy matches at each threshold in the order of did, the detections' rank by confidence: keys (ending with cls), thr, did, gid, overlap."""
    rows = assigned(candidates(det, gt, keys[:-1], min(thresholds), mode).filter(F.size("partners") > 0), keys, thresholds)
    hits = F.array_compact(F.array(*[F.when(F.col(f"hit{k}").isNotNull(), F.struct(F.lit(float(t)).alias("thr"), F.col(f"hit{k}.g").alias("gid"), (-F.col(f"hit{k}.n")).alias("overlap"))) for k, t in enumerate(thresholds)]))
    return rows.select(*keys, "did", F.explode(hits).alias("m")).select(*keys, "m.thr", "did", "m.gid", "m.overlap")


def match_truth_first(det: DataFrame, gt: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Matches driven by true boxes in the order of gid: each takes its best free detection, then the threshold is applied."""
    pairs = scored_pairs(det, gt, keys).filter("overlap > 0")
    return greedy(pairs, keys, [1e-300], order="gid", taken="did").filter(F.col("overlap") >= threshold).drop("thr")


def best_overlap(det: DataFrame, gt: DataFrame, unit: list[str], same_class: bool | None = None) -> DataFrame:
    """For each detection its largest overlap with true boxes of its image and the class of that box.

    same_class True or False: only boxes of the same class, or only of others. Without a box: 0, null.
    """
    right = gt.select(*unit, F.col("cls").alias("g_cls"), "gid", *(F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")))
    rows = det.join(right, unit)
    if same_class is not None:
        rows = rows.filter((F.col("cls") == F.col("g_cls")) == F.lit(same_class))
    overlap = match_score(box(), box("g_"))
    top = F.max(F.struct(overlap.alias("o"), (-F.col("g_cls")).alias("c")))
    best = rows.groupBy(*unit, "cls", "did").agg(top.alias("top"))
    best = best.select(*unit, "cls", "did", F.col("top.o").alias("best"), F.when(F.col("top.o") > 0, -F.col("top.c")).alias("best_cls"))
    return det.join(best, [*unit, "cls", "did"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def crowding(gt: DataFrame, unit: list[str], touch: float = 0.10) -> DataFrame:
    """unit and crowding: the share of an image's boxes that overlap another one by at least touch; 0 below two boxes."""
    left = gt.withColumn("_a", F.struct("cls", "gid"))
    right = gt.select(*unit, F.struct("cls", "gid").alias("_b"), *(F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")))
    met = left.join(right, unit).filter("_a != _b").groupBy(*unit, "_a").agg((F.max(match_score(box(), box("g_"))) >= touch).alias("hit"))
    hits = met.groupBy(*unit).agg(F.count_if("hit").alias("hits"))
    total = gt.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"))
    return total.join(hits, unit, "left").select(*unit, "n", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("crowding"))
