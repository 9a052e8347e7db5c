"""Precision, recall, average precision, error taxonomy and bootstrap over detections."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import box, size_bin, size_key
from ..functions.names import draw
from ..storage import Scratch
from .curves import average_precisions, resampled_maps, stored_in_order
from .matching import assigned, best_overlap, candidates
from .ranking import dense_index, first_rows

BINS = [("small", 0.0, 64.0), ("medium", 64.0, 128.0), ("large", 128.0, float("inf"))]
#: Slices of the confidence scale over which running sums are shared out.
SLICES = 256
GRID = 100
BACKGROUND, LOOSE, STRICT = 0.1, 0.1, 0.5


def top_k(det: DataFrame, k: int = 300) -> DataFrame:
    """The k most confident detections of each image and class; did is that rank."""
    return det.filter(F.col("did") <= k)


def labelled_bins(key: Column) -> Column:
    """'all' and the size bin, as an array to explode."""
    return F.array_compact(F.array(F.lit("all"), size_bin(key, BINS)))


def scored(det: DataFrame, gt: DataFrame, unit: list[str], thresholds: list[float], mode: str = "iou", verified: float = 0.0, floor: float = 0.25) -> DataFrame:
    """One row per detection: unit, cls, did, conf, d_size, hit0 ... for each threshold, credit.

    With verified, a detection of at least floor that no true box of any class overlaps by BACKGROUND has credit.
    """
    found = candidates(det, gt, unit, min(thresholds), mode, across=bool(verified))
    credit = F.lit(False)
    if verified:
        credit = (F.greatest("best_same", "best_other") < BACKGROUND) & (F.col("conf") >= floor)
        found = found.drop("other_cls")
    return assigned(found.withColumn("credit", credit).drop("best_same", "best_other"), [*unit, "cls"], thresholds)


def live_rows(rows: DataFrame, unit: list[str], thresholds: list[float], verified: float = 0.0) -> DataFrame:
    """Rows of scored as the curves need them: unit, cls, bin, thr, conf, did, tp.

    At each threshold a detection counts in 'all' and in one size bin: that of the box it hits, else its own. A hit on a
    box of another bin, and a miss by a detection of another bin, is ignored there, so these have no rows. A
    detection with credit counts as the share verified of a hit in the bin of its own size and in 'all'.
    """
    own = size_bin(F.col("d_size"), BINS)
    each = []
    for k, thr in enumerate(thresholds):
        hit = F.col(f"hit{k}")
        plain = F.when(hit.isNotNull(), 1.0).otherwise(0.0)
        there = size_bin(F.coalesce(hit["s"], F.col("d_size")), BINS)
        share = F.when(F.col("credit"), F.lit(float(verified))).otherwise(plain) if verified else plain
        in_bin = F.when(F.col("credit") & (there == own), F.lit(float(verified))).otherwise(plain) if verified else plain
        for name, tp in ((F.lit("all"), share), (there, in_bin)):
            each.append(F.when(name.isNotNull(), F.struct(F.lit(float(thr)).alias("thr"), name.alias("bin"), tp.alias("tp"))))
    return rows.select(*unit, "cls", "did", "conf", F.explode(F.array_compact(F.array(*each))).alias("x")).select(*unit, "cls", "x.bin", "x.thr", "conf", "did", "x.tp")


def evaluated(det: DataFrame, gt: DataFrame, unit: list[str], thresholds: list[float], mode: str = "iou", verified: float = 0.0, floor: float = 0.25) -> DataFrame:
    """What average_precision reads, from detections and true boxes."""
    return live_rows(scored(det, gt, unit, thresholds, mode, verified, floor), unit, thresholds, verified)


def truth_counts(gt: DataFrame, unit: list[str], rows: DataFrame | None = None, verified: float = 0.0, recall: float = 1.0) -> DataFrame:
    """unit, cls, bin, n_gt: true boxes, and those that detections with credit (in rows of scored) stand for."""
    n = gt.withColumn("bin", F.explode(labelled_bins(size_key(box())))).groupBy(*unit, "cls", "bin").agg(F.count(F.lit(1)).cast("double").alias("n_gt"))
    if not verified:
        return n
    more = rows.filter("credit").withColumn("bin", F.explode(labelled_bins(F.col("d_size")))).groupBy(*unit, "cls", "bin").agg((F.count(F.lit(1)) * F.lit(verified) / F.lit(max(recall, 1e-6))).alias("n_gt"))
    return n.unionByName(more).groupBy(*unit, "cls", "bin").agg(F.sum("n_gt").alias("n_gt"))


def average_precision(rows: DataFrame, totals: DataFrame, cell: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """cell, n_gt, ap: mean of the interpolated precision at 101 recalls; null without truth, 0 without hits.

    rows has cell, conf, tp, order (ties of conf) and may have ignored (rows that don't count); totals has cell and n_gt. Running sums go
    slice by slice of conf: sums by slice first, then within each slice, so that a cell of any size
    is spread over many tasks. Of the running curve, each hundredth of recall needs the largest precision, the
    first and the last row, which are plain aggregates.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    live = (rows.filter(~F.col("ignored")) if "ignored" in rows.columns else rows).select(*cell, "conf", *order, (F.col("tp") * w).alias("t"), w.alias("w"), F.least(F.floor(F.col("conf") * SLICES), F.lit(SLICES - 1)).alias("slice"))
    sums = live.groupBy(*cell, "slice").agg(F.sum("t").alias("st"), F.sum("w").alias("sw"), F.count(F.lit(1)).alias("sn"))
    before = Window.partitionBy(*cell).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*cell, "slice", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("st", "sw", "sn")))
    own = Window.partitionBy(*cell, "slice").orderBy(F.desc("conf"), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = live.select(*cell, "slice", F.sum("t").over(own).alias("t"), F.sum("w").over(own).alias("w"), F.count(F.lit(1)).over(own).alias("n"))
    run = run.join(sums, [*cell, "slice"]).join(totals.filter("n_gt > 0"), cell)
    hits, seen = F.col("t") + F.col("st"), F.col("w") + F.col("sw")
    run = run.select(*cell, (hits / F.col("n_gt")).alias("rec"), (hits / F.greatest(seen, F.lit(1e-9))).alias("prec"), (F.col("n") + F.col("sn")).alias("rank"))
    guess = F.least(F.ceil(F.col("rec") * GRID), F.lit(GRID + 1)).cast("int")
    spot = F.when((guess - 1) * F.lit(0.01) >= F.col("rec"), guess - 1).when(guess * F.lit(0.01) < F.col("rec"), guess + 1).otherwise(guess)
    point = F.struct("rank", "rec", "prec")
    spots = run.groupBy(*cell, spot.alias("spot")).agg(F.max("prec").alias("top"), F.min(point).alias("first"), F.max(point).alias("last"))
    return _from_spots(spots, totals, cell)


def _from_spots(spots: DataFrame, totals: DataFrame, cell: list[str]) -> DataFrame:
    """cell, n_gt, ap from the points of a curve that count: for each hundredth of recall (spot) the largest precision (top), the first and the last point."""
    # a cell has 102 rows at most
    by_spot = Window.partitionBy(*cell).orderBy("spot")
    later = F.max("top").over(by_spot.rowsBetween(1, Window.unboundedFollowing))
    upper = F.greatest("top", F.coalesce(later, F.lit(0.0)))
    spots = spots.select(*cell, "spot", F.col("first.rec").alias("rec_first"), upper.alias("env_first"), F.col("last.rec").alias("rec_last"), F.greatest("last.prec", F.coalesce(later, F.lit(0.0))).alias("env_last"))
    spots = spots.select("*", *(F.lead(c).over(by_spot).alias(f"n_{c}") for c in ("spot", "rec_first", "env_first")), (F.lag("spot").over(by_spot).isNull()).alias("is_first"))
    grid = spots.withColumn("k", F.explode(F.sequence(F.when(F.col("is_first"), F.least(F.lit(0), F.col("spot"))).otherwise(F.col("spot")), F.coalesce(F.col("n_spot") - 1, F.greatest(F.col("spot"), F.lit(GRID))))))
    grid = grid.filter(F.col("k").between(0, GRID))
    r = F.col("k") * F.lit(0.01)
    slope = (F.col("n_env_first") - F.col("env_last")) / (F.col("n_rec_first") - F.col("rec_last"))
    value = F.when(F.col("k") < F.col("spot"), F.col("env_first")).when(r == F.col("rec_last"), F.col("env_last")).when(F.col("n_spot").isNull(), 0.0).otherwise(slope * (r - F.col("rec_last")) + F.col("env_last"))
    means = grid.groupBy(*cell).agg((F.sum(value) / (GRID + 1)).alias("ap"))
    return totals.join(means, cell, "left").select(*cell, "n_gt", F.when(F.col("n_gt") > 0, F.coalesce("ap", F.lit(0.0))).alias("ap"))


#: A long holds what becomes of a detection at so many thresholds, and as many settings.
CODED, MASKED = 20, 60


def ap_by_bin(det: DataFrame, gt: DataFrame, unit: list[str], thresholds: list[float], mode: str = "iou") -> DataFrame:
    """cls, bin, thr, n_gt, ap: average_precision of the rows of evaluated, without making them.

    A detection is stored once, with three bits for each threshold: whether it hits, and the bin in which it counts.
    """
    scratch = Scratch(det.sparkSession, "ap-by-bin")
    number = {name: k + 1 for k, (name, _, _) in enumerate(BINS)}
    codes = []
    for a in range(0, len(thresholds), CODED):
        code = F.lit(0).cast("long")
        for k in range(a, min(len(thresholds), a + CODED)):
            key = F.coalesce(F.col(f"hit{k}")["s"], F.col("d_size"))
            there = sum((F.when((key >= low) & (key < high), number[name]).otherwise(0) for name, low, high in BINS), F.lit(0))
            code = code.bitwiseOR(F.shiftleft((there + F.when(F.col(f"hit{k}").isNotNull(), 4).otherwise(0)).cast("long"), 3 * (k - a)))
        codes.append(code.alias(f"code{len(codes)}"))
    rows = scored(det, gt, unit, thresholds, mode)
    path = stored_in_order(scratch, rows.select(*unit, "cls", "did", "conf", *codes), [*unit, "did"], "coded")
    totals = truth_counts(gt, unit).groupBy("cls", "bin").agg(F.sum("n_gt").alias("n_gt")).filter("cls is not null").collect()
    cells = [(r.cls, r.bin, k, r.n_gt) for r in totals for k in range(len(thresholds))]

    def read(part: pa.RecordBatch, i: int) -> np.ndarray:
        _, name, k, _ = cells[i]
        x = part.column(f"code{k // CODED}").to_numpy() >> (3 * (k % CODED)) & 7
        return (x if name == "all" else x[x & 3 == number[name]]) >= 4

    found = average_precisions(det.sparkSession, [(c[0], c[3]) for c in cells], lambda _: path, read)
    kinds = dict(gt.dtypes)["cls"]
    given = det.sparkSession.createDataFrame([(i, c[0], c[1], float(thresholds[c[2]]), c[3]) for i, c in enumerate(cells)], f"curve int, cls {kinds}, bin string, thr double, n_gt double")
    return given.join(found, "curve", "left").select("cls", "bin", "thr", "n_gt", "ap")


def bootstrap_weights(units: DataFrame, unit: list[str], resamples: int, seed: int = 0) -> DataFrame:
    """unit and w: a byte for each resample, how often the image is drawn when as many as there are, are drawn with replacement.

    Draw k of resample b is a digest of both, and images are numbered in an order drawn likewise.
    """
    n = units.count()
    numbered = dense_index(units.select(*unit), draw(F.lit(str(seed)), *(F.col(c).cast("string") for c in unit)), unit, "number")
    draws = units.sparkSession.range(resamples * n).select((F.col("id") / n).cast("int").alias("resample"), (F.col("id") % n).alias("k"))
    picked = draws.select("resample", (draw(F.lit(str(seed)), F.col("resample").cast("string"), F.col("k").cast("string")) % n).alias("number"))
    drawn = picked.groupBy("number").agg(F.collect_list("resample").alias("drawn"))  # about as many as there are resamples

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [np.bincount(x.values.to_numpy(), minlength=resamples) if x.is_valid else np.zeros(resamples, np.int64) for x in b.column("drawn")]
            if counts and max(c.max() for c in counts) > 255:
                raise ValueError("an image is drawn more than 255 times in a resample")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in unit), pa.array([c.astype(np.uint8).tobytes() for c in counts], pa.binary())], names=[*unit, "w"])

    rows = numbered.join(drawn, "number", "left").select(*unit, "drawn")
    fields = ", ".join(f"{c} {dict(units.dtypes)[c]}" for c in unit)
    return rows.mapInArrow(packed, f"{fields}, w binary")


def resampled_map(arms: list[DataFrame], gt_units: DataFrame, unit: list[str], resamples: int, seed: int = 0) -> DataFrame:
    """resample and map0, map1, ... for each of arms: the mean over classes of ap, with images weighted by how often they are drawn.

    An arm has unit, cls, did, conf and tp (of one bin and threshold), gt_units unit, cls and n_gt. Images are those with true boxes, numbered as in
    bootstrap_weights; a detection is stored as its image's number and tp, in order, and tasks make the draws again from their digests.
    """
    scratch = Scratch(gt_units.sparkSession, "resampled")
    truth = scratch.table(gt_units.select(*unit, F.col("cls").cast("int").alias("cls"), F.col("n_gt").cast("double").alias("n_gt")), "truth")
    units = truth.select(*unit).distinct()
    n = units.count()
    drawn = draw(F.lit(str(seed)), *(F.col(c).cast("string") for c in unit))
    numbered = scratch.table(dense_index(units, drawn, unit, "number").select(*unit, F.col("number").cast("int").alias("number")), "numbered")
    truth.join(numbered, unit).select("cls", "number", "n_gt").write.partitionBy("cls").parquet(f"{scratch.root}/truth-numbered")
    classes = sorted(r.cls for r in truth.select("cls").distinct().collect() if r.cls is not None)
    paths = []
    for k, rows in enumerate(arms):
        keyed = rows.select(*unit, F.col("cls").cast("int").alias("cls"), "did", "conf", F.col("tp").cast("float").alias("tp")).join(numbered, unit)
        paths.append(stored_in_order(scratch, keyed, [*unit, "did"], f"arm{k}"))
    return resampled_maps(scratch.spark, paths, f"{scratch.root}/truth-numbered", classes, n, resamples, seed)


def taxonomy(det: DataFrame, gt: DataFrame, unit: list[str], loose: float = LOOSE) -> DataFrame:
    """Every detection with hit, hit_loose, error (null, 'cls', 'loc' or 'bkg') and the class confused with.

    An unmatched detection is first a confusion (a box of another class by 0.5), then badly placed
    (a box of its class by 0.1, taken or not), else background.
    """
    keys = [*unit, "cls"]
    rows = assigned(candidates(det, gt, unit, min(loose, STRICT), across=True), keys, [STRICT, loose])
    hit = F.col("hit0").isNotNull()
    error = F.when(hit, None).when(F.col("best_other") >= STRICT, "cls").when(F.col("best_same") >= LOOSE, "loc").otherwise("bkg")
    return rows.select(*keys, "did", hit.alias("hit"), F.col("hit1").isNotNull().alias("hit_loose"), error.alias("error"), F.when(error == "cls", F.col("other_cls")).alias("confused_with"))


def class_report(errors: DataFrame, gt: DataFrame) -> DataFrame:
    """cls, n_gt, n_pred, tp, fn, recall, recall_loose, precision and the errors' counts; null for 0 / 0."""
    n = gt.groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt"))
    c = errors.groupBy("cls").agg(
        F.count(F.lit(1)).alias("n_pred"), F.count_if("hit").alias("tp"), F.count_if("hit_loose").alias("tp_loose"), *(F.count_if(F.col("error") == e).alias(f"fp_{e}") for e in ("cls", "loc", "bkg"))
    )
    rows = n.join(c, "cls", "left").na.fill(0)
    return rows.select(
        "cls", "n_gt", "n_pred", "tp", (F.col("n_gt") - F.col("tp")).alias("fn"), F.try_divide(F.col("tp"), F.col("n_gt")).alias("recall"), F.try_divide(F.col("tp_loose"), F.col("n_gt")).alias("recall_loose"),
        F.try_divide(F.col("tp"), F.col("n_pred")).alias("precision"), "fp_cls", "fp_loc", "fp_bkg",
    )


def confident(det: DataFrame, floor: float, low: float = 0.0, high: float = float("inf"), scale: Column | None = None) -> DataFrame:
    """Detections of at least floor whose size, at the scale that images are shown, is in [low, high)."""
    key = size_key(box()) * (scale if scale is not None else F.lit(1.0))
    return det.filter((F.col("conf") >= floor) & (key >= low) & (key < high))


def adjusted(det: DataFrame, gt: DataFrame, unit: list[str], variants: dict[str, tuple[str, float, float]], settings: DataFrame | None = None, floor: float = 0.25) -> DataFrame:
    """variant, cls, n_gt, ap at IoU 0.5 over all sizes, for variants (mode, verified, recall) at once.

    Detections are matched and stored once for each mode, with what a variant may make of them and, in bits, the settings of their
    image. With settings (unit, setting; few different ones), each setting's images are evaluated by themselves, and setting is a key of the result.
    """
    spark, scratch = det.sparkSession, Scratch(det.sparkSession, "adjusted")
    levels, masks = [None], ["mask0"]
    if settings is not None:
        levels = [r.setting for r in settings.select("setting").distinct().orderBy("setting").collect()]
        masks = [f"mask{k}" for k in range(-(-len(levels) // MASKED))]
        bits = [F.bit_or(sum((F.when(F.col("setting").eqNullSafe(F.lit(v)), 1 << i).otherwise(0).cast("long") for i, v in enumerate(levels[MASKED * k : MASKED * (k + 1)])), F.lit(0).cast("long"))).alias(m) for k, m in enumerate(masks)]
        marks = scratch.table(settings.groupBy(*unit).agg(*bits), "marks") if masks else None

    def marked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("mask0", F.lit(1).cast("long")) if settings is None else rows.join(marks, unit)

    def in_each(count: Column) -> list[Column]:
        """By setting, the number of rows that count."""
        return [F.count_if(count & (F.getbit(masks[i // MASKED], F.lit(i % MASKED)) == 1)).alias(f"n{i}") for i in range(len(levels))]

    kinds = f"cls {dict(gt.dtypes)['cls']}"
    more = [] if settings is None else [f"setting {dict(settings.dtypes)['setting']}"]
    cells: list[tuple[str, int, str, object, float]] = []  # mode, setting's place, variant, class, truth
    paths = {}
    truth = {r.cls: r for r in marked(gt.select(*unit, "cls")).groupBy("cls").agg(*in_each(F.lit(True))).collect()} if levels else {}
    for mode in dict.fromkeys(m for m, _, _ in variants.values()) if levels else ():
        mine = {k: v for k, v in variants.items() if v[0] == mode}
        found = scored(det, gt, unit, [STRICT], mode, 1.0 if any(p for _, p, _ in mine.values()) else 0.0, floor)
        state = (F.when(F.col("hit0").isNotNull(), 1).otherwise(0) + F.when(F.col("credit"), 2).otherwise(0)).cast("tinyint").alias("state")
        paths[mode] = stored_in_order(scratch, marked(found.select(*unit, "cls", "did", "conf", state)), [*unit, "did"], mode)
        rows = spark.read.schema(", ".join(["state tinyint", *(f"{m} long" for m in masks), kinds])).parquet(paths[mode])
        credits = {r.cls: r for r in rows.groupBy("cls").agg(*in_each(F.col("state") >= 2)).collect()}
        for name, (_, p, r) in mine.items():
            for cls in sorted(x for x in truth.keys() | credits.keys() if x is not None):
                for i in range(len(levels)):
                    boxes, credit = (x[cls][f"n{i}"] if cls in x else 0 for x in (truth, credits))
                    if boxes or (p and credit):
                        cells.append((mode, i, name, cls, boxes + (credit * (p / max(r, 1e-6)) if p else 0.0)))

    def read(part: pa.RecordBatch, k: int) -> np.ndarray:
        _, i, name, _, _ = cells[k]
        p = variants[name][1]
        shares = np.array([0.0, 1.0, p, p] if p else [0.0, 1.0, 0.0, 1.0])
        state, mask = part.column("state").to_numpy(), part.column(masks[i // MASKED]).to_numpy()
        return shares[state[(mask >> (i % MASKED)) & 1 == 1]]

    found = average_precisions(spark, [(c[3], c[4]) for c in cells], lambda k: paths[cells[k][0]], read)
    given = spark.createDataFrame([(k, *([levels[c[1]]] if more else []), c[2], c[3], float(c[4])) for k, c in enumerate(cells)], ", ".join(["curve int", *more, "variant string", kinds, "n_gt double"]))
    return given.join(found, "curve", "left").drop("curve")


def unmatched(det: DataFrame, gt: DataFrame, unit: list[str], cls: int, floor: float, least: float = STRICT) -> DataFrame:
    """Detections of a class, of at least floor, that no true box of it overlaps by least."""
    mine = det.filter((F.col("cls") == cls) & (F.col("conf") >= floor))
    return best_overlap(mine, gt.filter(F.col("cls") == cls), unit, True).filter(F.col("best") < least)


def shown_first(found: DataFrame, n: int, ties: list[str], seed: int | None = None) -> DataFrame:
    """n rows: the most confident, or with a seed rows drawn by digests of ties, which tell without bias how many are of a kind."""
    if seed is None:
        return found.orderBy(F.desc("conf"), *ties).limit(n)
    return first_rows(found, draw(F.lit(str(seed)), *(F.col(c).cast("string") for c in ties)), ties, n)


def unlike_in_photo(found: DataFrame, photo: list[str], order: list[str], most: int, n: int) -> DataFrame:
    """The first n rows of found (photo, order, hash) in order that lie over most bits from all rows kept before of the same photo.

    A photo's crops are a short list, folded over in one row.
    """
    lists = found.groupBy(*photo).agg(F.sort_array(F.collect_list(F.struct(*order, "hash"))).alias("list"))
    none = F.expr("cast(array() as array<bigint>)")
    seen = F.aggregate("list", F.struct(none.alias("hashes"), F.expr("cast(array() as array<boolean>)").alias("kept")), lambda st, x: F.struct(
        F.when(F.exists(st["hashes"], lambda h: F.bit_count(h.bitwiseXOR(x["hash"])) <= most), st["hashes"]).otherwise(F.concat(st["hashes"], F.array(x["hash"]))).alias("hashes"),
        F.concat(st["kept"], F.array(~F.exists(st["hashes"], lambda h: F.bit_count(h.bitwiseXOR(x["hash"])) <= most))).alias("kept"),
    ), lambda st: st["kept"])
    rows = lists.withColumn("kept", seen).select(*photo, F.inline(F.arrays_zip("list", "kept"))).filter("kept")
    return rows.select(*photo, "list.*").orderBy(*order, *photo).limit(n)


def richest(boxes: DataFrame, unit: list[str], n: int, usual: int = 8) -> DataFrame:
    """unit, classes, boxes of the n images with the most classes, of equal ones those with closest to the usual number of boxes."""
    rows = boxes.groupBy(*unit).agg(F.count_distinct("cls").alias("classes"), F.count(F.lit(1)).alias("boxes"))
    return rows.orderBy(F.desc("classes"), F.abs(F.col("boxes") - usual), *unit).limit(n)


def overlap_report(matches: DataFrame) -> DataFrame:
    """cls (null: all), n, mean overlap of matches."""
    return matches.rollup("cls").agg(F.count(F.lit(1)).alias("n"), F.avg("overlap").alias("mean"))
