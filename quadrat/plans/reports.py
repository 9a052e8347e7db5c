"""Queries of the reports that put runs, classes, settings and pictures beside each other."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions.geometry import box, longest_side
from ..operators import evaluation as ev
from ..operators import matching as mt
from ..operators import priors as pr
from ..operators import regions as rg
from ..operators import runs as rn
from ..operators.ranking import first_in_groups
from . import detection as dt
from . import experiments as ex
from .datasets import _draw, _hashes
from .detection import _AP50, _CROWD, _MASK, _ap, _ap_rows, _det, _evaluated, _ioa, _iou, _matches, _pairs
from .fixtures import CELL, SQL, UNIT, gt_box, run_metrics, run_metrics_class, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return f"with recursive {SQL}, " + ", ".join(ctes) + " "


def _q(*keys: str) -> str:
    """A draw in SQL; keys are text."""
    return _draw(*(f"'{k[1:]}'" if k.startswith("=") else k for k in keys))


# -- adjusted and excluded -----------------------------------------------------------------------

# Shares of verified background detections and assumed recalls of the report.
VARIANTS = {
    "uncorrected": ("iou", 0.0, 1.0),
    "scope_low": ("iou", 0.5, 0.75),
    "scope_estimate": ("iou", 0.95, 0.75),
    "scope_high": ("iou", 0.95, 1.0),
    "extent": ("ioa", 0.0, 1.0),
    "both": ("ioa", 0.95, 0.75),
}
ADJUSTMENTS = {"none": VARIANTS["uncorrected"], "scope": VARIANTS["scope_estimate"], "extent": VARIANTS["extent"], "both": VARIANTS["both"]}
OVERLAPS = [1.0, 0.75, 0.5, 0.25, 0.1]


def _values(variants: dict[str, tuple[str, float, float]]) -> str:
    return "variants as (select * from (values " + ", ".join(f"('{k}', '{m}', {p}::double, {r}::double)" for k, (m, p, r) in variants.items()) + ") as v(variant, mode, p, r))"


_BOTH_MODES = (
    _pairs(),
    _matches(),
    _evaluated("[0.5]", name="ev_iou"),
    _pairs(score=_ioa("d", "g"), name="pairsx"),
    _matches("pairsx", name="matchesx"),
    _evaluated("[0.5]", matches="matchesx", name="ev_ioa"),
    f"best as (select d.seed, d.tile_id, d.cls, d.did, max({_iou('d', 'g')}) as best from det d join gt g on d.seed = g.seed and d.tile_id = g.tile_id group by all)",
    "flags as (select d.seed, d.tile_id, d.cls, d.did, coalesce(best, 0) < 0.1 and d.score / 1000003.0::double >= 0.25 as credit from det d left join best using (seed, tile_id, cls, did))",
    "ev as (select 'iou' as mode, * from ev_iou where bin = 'all' union all select 'ioa', * from ev_ioa where bin = 'all')",
    "plain_gt as (select seed, tile_id, cls, count(*)::double as n_gt from gt group by all)",
)


def _adjusted(variants: dict[str, tuple[str, float, float]], settings: str | None = None) -> tuple[str, ...]:
    key, join = ("setting, ", f" join {settings} using (seed, tile_id)") if settings else ("", "")
    return (
        _values(variants),
        f"rows_v as (select {key}v.variant, e.seed, e.tile_id, e.cls, e.did, e.conf, case when v.p > 0 and f.credit then v.p else e.tp end as tp, false as ignored, case when v.p > 0 and f.credit then v.p / v.r else 0 end as more from ev e join variants v using (mode) join flags f using (seed, tile_id, cls, did){join})",
        f"cells_v as (select {key}variant, cls, sum(n_gt) as n_gt from (select {key}variant, cls, n_gt from plain_gt{join} cross join variants union all select {key}variant, cls, more from rows_v) group by all)",
        _ap("rows_v", "cells_v", f"{key}variant, cls"),
    )


@query(_with(*_BOTH_MODES, *_adjusted(VARIANTS)) + "select variant, cls, round(n_gt, 4) as n_gt, round(ap, 6) as ap from ap union all select variant, null, round(sum(n_gt), 4), round(avg(ap), 6) from ap group by variant")
def adjustment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision by class, and its mean, as scored and with each correction for what annotators left out."""
    ap = ev.adjusted(ev.top_k(_det(spark, sf_dir)), gt_box(spark, sf_dir), UNIT, VARIANTS)
    mean = ap.groupBy("variant").agg(F.lit(None).cast("int").alias("cls"), F.sum("n_gt").alias("n_gt"), F.avg("ap").alias("ap"))
    return ap.select("variant", "cls", "n_gt", "ap").unionByName(mean).withColumns({"n_gt": F.round("n_gt", 4), "ap": F.round("ap", 6)})


_SETTINGS = f"settings as (select seed, tile_id, unnest(list_filter({OVERLAPS}, lambda v: v >= 1 or crowding <= v))::double as setting from crowds)"


@query(
    _with(*_BOTH_MODES, _CROWD, _SETTINGS, *_adjusted(ADJUSTMENTS, "settings"), "sizes as (select setting, count(*) as units, sum(n)::bigint as instances from settings join crowds using (seed, tile_id) group by setting)", "full_set as (select instances as whole from sizes where setting = 1)")
    + "select setting, units, instances, round(100.0::double * instances / whole, 4) as kept, variant as adjustment, round(avg(ap), 6) as map50 from ap join sizes using (setting), full_set group by all"
)
def exclusion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision when crowded images are left out, against corrections that leave out nothing."""
    gt = gt_box(spark, sf_dir)
    crowds = mt.crowding(gt, UNIT)
    reached = F.filter(F.array(*map(F.lit, OVERLAPS)), lambda v: (v >= 1) | (F.col("crowding") <= v))
    settings = crowds.select(*UNIT, "n", F.explode(reached).alias("setting"))
    sizes = settings.groupBy("setting").agg(F.count(F.lit(1)).alias("units"), F.sum("n").alias("instances"))
    whole = sizes.filter("setting = 1").select(F.col("instances").alias("_whole"))
    ap = ev.adjusted(ev.top_k(_det(spark, sf_dir)), gt, UNIT, ADJUSTMENTS, settings.drop("n"))
    rows = ap.groupBy("setting", "variant").agg(F.round(F.avg("ap"), 6).alias("map50")).join(sizes, "setting").join(F.broadcast(whole))  # one row
    return rows.select("setting", "units", "instances", F.round(100.0 * F.col("instances") / F.col("_whole"), 4).alias("kept"), F.col("variant").alias("adjustment"), "map50")


@query(_with(*_AP50, "s as (select bin, unnest(list_filter(['five', 'three'], lambda n: n = 'five' or cls < 3)) as subset, ap, n_gt from ap where ap is not null)") + "select bin, subset, round(avg(ap), 6) as mean, count(*) as classes, sum(n_gt) as n_gt from s group by all")
def subset_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision over all classes and over the first three, by size of object."""
    rows = rn.subset_means(_ap_rows(spark, sf_dir, [0.5]), {"five": [0, 1, 2, 3, 4], "three": [0, 1, 2]})
    return rows.withColumn("mean", F.round("mean", 6))


def _tax(det: str, tag: str) -> tuple[str, ...]:
    swap = {"pairs": f"pairs{tag}", "matches": f"matches{tag}", "others": f"others{tag}", "best_o": f"best_o{tag}", "best_s": f"best_s{tag}", "hits": f"hits{tag}", "tax0": f"tax0{tag}", "tax": f"tax{tag}", "report": f"report{tag}"}
    out = [_pairs(det, name=f"pairs{tag}"), _matches(f"pairs{tag}", "[0.1, 0.5]", f"matches{tag}")]
    for cte in dt._TAX[2:]:
        for old, new in swap.items():
            cte = re.sub(rf"^{old} as \(", f"{new} as (", re.sub(rf"\b(from|join) {old}\b", rf"\1 {new}", cte))
        out.append(cte.replace("from det d", f"from {det} d"))
    return tuple(out)


_SUMMED = "select '{arm}' as arm, sum(fp_bkg)::double as fp_bkg, sum(n_gt - tp)::double as fn, sum(tp)::double / sum(n_pred) as micro_precision, sum(tp)::double / sum(n_gt) as micro_recall, avg(tp::double / n_pred) as macro_precision, avg(tp::double / n_gt) as macro_recall from report{tag}"
_COLUMNS = ["fp_bkg", "fn", "micro_precision", "micro_recall", "macro_precision", "macro_recall"]


@query(_with(*_tax("det", "_a"), *_tax("detb", "_b"), f"arms as ({_SUMMED.format(arm='a', tag='_a')} union all {_SUMMED.format(arm='b', tag='_b')})", f"long as (select unnest({_COLUMNS}) as \"column\", unnest([{', '.join(_COLUMNS)}]) as v from arms)", "s as (select \"column\", min(v) as low, max(v) as high from long group by \"column\")") + "select \"column\", round(low, 6) as low, round(high, 6) as high, round(high - low, 6) as span, round((high - low) / high, 6) as of_high, round((high - low) / low, 6) as of_low from s")
def arm_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far counts and rates differ between two models."""
    gt, reports = gt_box(spark, sf_dir), []
    for arm in (0, 1):
        r = ev.class_report(ev.taxonomy(_det(spark, sf_dir, arm), gt, UNIT), gt)
        micro = [(F.sum("tp") / F.sum(c)).alias(f"micro_{n}") for c, n in (("n_pred", "precision"), ("n_gt", "recall"))]
        reports.append(r.agg(F.sum("fp_bkg").alias("fp_bkg"), F.sum("fn").alias("fn"), *micro, *(F.avg(n).alias(f"macro_{n}") for n in ("precision", "recall"))))
    rows = rn.spans(reports[0].unionByName(reports[1]), _COLUMNS)
    return rows.withColumns({c: F.round(c, 6) for c in ("low", "high", "span", "of_high", "of_low")})


@query(_with(*_MASK[:4]) + "select cls, count(*) as n, round(avg(overlap), 6) as mean from hit group by rollup (cls)")
def mask_overlap_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap of truth-first matches, by class and in all."""
    m = mt.match_truth_first(_det(spark, sf_dir), gt_box(spark, sf_dir), CELL, 0.7)
    return ev.overlap_report(m).withColumn("mean", F.round("mean", 6))


@query(_with(_pairs(score=f"greatest({_iou('d', 'g')}, {_ioa('d', 'g')})"), "b as (select seed, tile_id, cls, did, max(overlap) as best from pairs group by all)") + "select d.cls, count(*) as n, count(*) filter (best >= 0.5) as covered, round(sum(best), 4) as total from det d left join b using (seed, tile_id, cls, did) group by d.cls")
def best_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that cover a true box of their class by either measure."""
    d = mt.scored_pairs(_det(spark, sf_dir), gt_box(spark, sf_dir), CELL, "max").groupBy(*CELL, "did").agg(F.max("overlap").alias("best"))
    rows = _det(spark, sf_dir).join(d, [*CELL, "did"], "left")
    return rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("best") >= 0.5).alias("covered"), F.round(F.sum("best"), 4).alias("total"))


@query(_with("c as (select *, sqrt((x2 - x1) * (y2 - y1)) * 0.5::double as k from det where score / 1000003.0::double >= 0.3)") + "select cls, count(*) filter (k >= 30 and k < 60) as n, count(*) as confident from c group by cls")
def confident_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confident detections, and those of a window of sizes, as shown at half scale."""
    d = _det(spark, sf_dir)
    some = ev.confident(d, 0.3, 30.0, 60.0, F.lit(0.5)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    return ev.confident(d, 0.3).groupBy("cls").agg(F.count(F.lit(1)).alias("confident")).join(some, "cls", "left").select("cls", F.coalesce("n", F.lit(0)).alias("n"), "confident")


_FP = "own as (select d.seed, d.tile_id, d.did, d.score, max(coalesce({iou}, 0)) as best from det d left join gt g on d.seed = g.seed and d.tile_id = g.tile_id and d.cls = g.cls where d.cls = 3 and d.score / 1000003.0::double >= 0.4 group by all), fp as (select * from own where best < 0.5)".replace("{iou}", _iou("d", "g"))


@query(_with(_FP) + f"select * from (select 'first' as how, seed, tile_id, did from fp order by score desc, seed, tile_id, did limit 25) union all select * from (select 'drawn', seed, tile_id, did from fp order by {_q('=7', 'seed', 'tile_id', 'did')}, seed, tile_id, did limit 25)")
def false_positive_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmatched detections of a class: the most confident ones, and some drawn without bias."""
    found = ev.unmatched(_det(spark, sf_dir), gt_box(spark, sf_dir), UNIT, 3, 0.4).select(*UNIT, "did", "conf")
    ties = [*UNIT, "did"]
    parts = [ev.shown_first(found, 25, ties, seed).select(F.lit(how).alias("how"), *ties) for how, seed in (("first", None), ("drawn", 7))]
    return parts[0].unionByName(parts[1])


@query(
    _with(
        "bits as (select vec_id, list_transform(embedding, lambda x: case when x::double > list_sum(list_transform(embedding, lambda y: y::double)) / 64 then '1' else '0' end) as b from embeddings)",
        "h as (select vec_id as id, vec_id % 40 as photo, array_to_string(b, '') as h, row_number() over (partition by vec_id % 40 order by vec_id) as k from bits)",
        "r as (select photo, 0::bigint as k, []::varchar[] as kept, null::bigint as id from (select distinct photo from h) union all select r.photo, h.k, case when len(list_filter(r.kept, lambda x: hamming(x, h.h) <= 24)) > 0 then r.kept else list_append(r.kept, h.h) end, case when len(list_filter(r.kept, lambda x: hamming(x, h.h) <= 24)) > 0 then null else h.id end from r join h on h.photo = r.photo and h.k = r.k + 1)",
    )
    + "select photo, id from r where id is not null order by id, photo limit 60"
)
def photo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first crops whose hashes aren't close to one shown before from the same photo."""
    rows = _hashes(spark, sf_dir).withColumn("photo", F.col("id") % 40)
    return ev.unlike_in_photo(rows, ["photo"], ["id"], 24, 60).select("photo", "id")


@query(_with("s as (select tile_id, count(distinct cls) as classes, count(*) as boxes from gt where seed = 0 group by tile_id)") + "select tile_id, classes, boxes from s order by classes desc, abs(boxes - 8), tile_id limit 30")
def scene_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with many classes and about eight boxes."""
    return ev.richest(gt_box(spark, sf_dir).filter("seed = 0"), ["tile_id"], 30)


@query(_with() + "select cls, tile_id, gid from (select cls, tile_id, gid, row_number() over (partition by cls order by tile_id, gid) as k from gt where seed = 0) where k <= 12")
def first_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first boxes of each class in the order that they are met."""
    return first_in_groups(gt_box(spark, sf_dir).filter("seed = 0").select("cls", "tile_id", "gid"), ["cls"], ["tile_id", "gid"], 12)


@query(_with("c as (select cls, least(x2 - x1, y2 - y1) as short, greatest(x2 - x1, y2 - y1) as long from gt where seed = 0 and cls in (0, 2, 4))") + "select cls, count(*) filter (short >= 40) as large_enough, count(*) filter (short >= 40 and long >= 80 and long < 160) as in_band from c group by cls")
def crop_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of wanted classes that are large enough to cut out, and those in a band of sizes."""
    rows = gt_box(spark, sf_dir).filter("seed = 0").filter(F.col("cls").isin(0, 2, 4))
    side = longest_side(box())
    short = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= 40
    return rows.groupBy("cls").agg(F.count_if(short).alias("large_enough"), F.count_if(short & (side >= 80) & (side < 160)).alias("in_band"))


# -- windows, regions, pools ---------------------------------------------------------------------

SIZES, ATTEMPTS, SIDE, GREENS = [64, 128, 256], 6, 1500, [0.2, 0.4, 0.6]
_WINDOWS = (
    "images as (select distinct tile_id from gt where seed = 0)",
    f"win as (select tile_id, size, n, {_q('=0x', 'tile_id', 'size', 'n')} % ({SIDE} - size + 1) as x, {_q('=0y', 'tile_id', 'size', 'n')} % ({SIDE} - size + 1) as y, {_q('=green', 'tile_id', 'size', 'n')} / 4294967296.0::double as green from (select tile_id, unnest({SIZES}) as size from images), range({ATTEMPTS}) as r(n))",
    "free as (select w.*, not exists (select 1 from gt b where b.seed = 0 and b.tile_id = w.tile_id and b.x2 + 4 > w.x and b.x1 - 4 < w.x + w.size and b.y2 + 4 > w.y and b.y1 - 4 < w.y + w.size) as free from win w)",
)


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gt = gt_box(spark, sf_dir).filter("seed = 0")
    images = gt.select("tile_id").distinct().withColumns({"width": F.lit(SIDE), "height": F.lit(SIDE)})
    green = nm.uniform(F.lit("green"), *(F.col(c).cast("string") for c in ("tile_id", "size", "n")))
    windows = rg.drawn_windows(images, ["tile_id"], SIZES, ATTEMPTS).withColumn("green", green)
    return windows, rg.free_windows(windows, gt, ["tile_id"], 4.0)


@query(_with(*_WINDOWS) + "select size, count(*) as tried, count(*) filter (free) as box_free, count(distinct case when free then tile_id end) as images, " + ", ".join(f"count(*) filter (free and green <= {g}) as g{int(g * 10)}" for g in GREENS) + ", round(min(green) filter (free), 6) as lowest from free group by size")
def background_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows without boxes by size, the images that have one, and how many pass limits on greenness."""
    windows, free = _windows(spark, sf_dir)
    passed = free.groupBy("size").agg(F.count(F.lit(1)).alias("box_free"), F.count_distinct("tile_id").alias("images"), *(F.count_if(F.col("green") <= g).alias(f"g{int(g * 10)}") for g in GREENS), F.round(F.min("green"), 6).alias("lowest"))
    rows = windows.groupBy("size").agg(F.count(F.lit(1)).alias("tried")).join(passed, "size", "left")
    return rows.na.fill(0, ["box_free", "images", *(f"g{int(g * 10)}" for g in GREENS)])


@query(_with(*_WINDOWS) + "select case when not free then 'box' when green > 0.6 then 'green' when green > 0.4 then 'local' else 'kept' end as reason, count(*) as n from free group by reason")
def gate_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by the first gate that stops them."""
    windows, free = _windows(spark, sf_dir)
    rows = windows.join(free.select("tile_id", "size", "n", F.lit(True).alias("free")), ["tile_id", "size", "n"], "left")
    checks = [("box", F.coalesce("free", F.lit(False))), ("green", F.col("green") <= 0.6), ("local", F.col("green") <= 0.4)]
    return rows.groupBy(pr.first_reason(checks).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_EXT = "ext as (select tile_id, greatest(0.0::double, min(x1) - 20) as a, greatest(0.0::double, min(y1) - 20) as b, least(1400.0::double, max(x2) + 20) as c, least(1400.0::double, max(y2) + 20) as d from gt where seed = 0 group by tile_id), region as (select tile_id, (c - a) * (d - b) / (1400.0::double * 1400.0) as share from ext)"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.from_boxes(gt_box(spark, sf_dir).filter("seed = 0"), ["tile_id"], 1400.0, 1400.0, 20.0)


@query(_with(_EXT, "imgs as (select distinct floor(o_orderkey / 30)::bigint as tile_id from orders)") + "select case when share is null then 'undecided' when share >= 0.995 then 'all' else 'poly' end as mode, count(*) as n from imgs left join region using (tile_id) group by mode")
def region_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by the kind of their valid region."""
    images = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 30).cast("bigint").alias("tile_id")).distinct()
    return rg.modes(_regions(spark, sf_dir), images, ["tile_id"])


@query(_with(_EXT, "o as (select share, row_number() over (order by share) as k, count(*) over () as n from region)") + "select n, round((select min(share) from region), 6) as least, round(share, 6) as middle, round((select max(share) from region), 6) as largest from o where k = n // 2 + 1")
def region_area_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, middle and largest valid share of an image."""
    rows = pr.spread(_regions(spark, sf_dir), "share")
    return rows.withColumns({c: F.round(c, 6) for c in ("least", "middle", "largest")})


@query(_with(f"p as (select lang, doc_id, n_chars, row_number() over (partition by lang order by {_q('=0', 'doc_id')}, doc_id) as k from documents)") + "select lang, count(*) as n_images, count(*) filter (k <= 40) as n_scored, round(avg(n_chars) filter (k <= 40), 4) as mean, round(stddev_pop(n_chars) filter (k <= 40), 4) as std from p group by lang")
def pool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of a score over some members drawn from each pool."""
    rows = pr.scored_sample(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", "n_chars", 40)
    return rows.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(_with("w as (select source, lang, n_chars between 300 and 500 as ok from documents)", "g as (select *, count(*) filter (ok) over (partition by source, lang) as n_ok from w)") + "select source, lang, count(*) filter (ok or n_ok = 0) as kept, count(*) as n from g group by all")
def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose measure is in bounds; of a group without any, all."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    kept = pr.gate(d, F.col("n_chars").between(300, 500), ["source", "lang"]).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("kept"))
    n = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({"source": "_s", "lang": "_l"})
    return n.join(kept, F.col("_s").eqNullSafe(F.col("source")) & F.col("_l").eqNullSafe(F.col("lang"))).select("source", "lang", "kept", "n")


@query(_with("m as (select vec_id // 4 as scene, vec_id as member, list_avg(list_transform(embedding, lambda x: x::double)) as mean, list_stddev_pop(list_transform(embedding, lambda x: x::double)) as sd from embeddings)", "t as (select *, median(mean) over (partition by scene) as tm, median(sd) over (partition by scene) as ts from m)", "g as (select *, greatest(0.9::double, least(1.1::double, ts / (sd + 1e-6::double))) as gain from t)") + "select scene, member, round(gain, 5) as gain, round(tm - mean * gain, 5) as shift from g")
def mosaic_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What brings four members of a mosaic to their medians."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size("embedding")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("scene"), F.col("vec_id").alias("member"), "embedding", mean.alias("mean"))
    square = F.aggregate(F.transform("embedding", lambda v: F.pow(v.cast("double") - F.col("mean"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v) / F.size("embedding")
    rows = pr.mosaic_gains(rows.select("scene", "member", "mean", F.sqrt(square).alias("sd")), ["scene"])
    return rows.select("scene", "member", F.round("gain", 5).alias("gain"), F.round("shift", 5).alias("shift"))


@query(_with("d as (select o_orderpriority as detector, sum(o_totalprice)::double as params, avg(o_totalprice)::double as gflops, (count(*) % 17)::double as ms from orders group by 1)") + "select detector, round(params / 1e6, 2) as \"params_M\", round(gflops, 1) as gflops, round(ms * 0.25, 2) as preprocess_ms, round(ms, 2) as inference_ms, round(ms * 0.5, 2) as postprocess_ms, case when ms > 0 then round(1000 / ms, 1) end as fps, 640 as imgsz from d")
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and speed of models."""
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("detector")).agg(F.sum("o_totalprice").cast("double").alias("params"), F.avg("o_totalprice").cast("double").alias("gflops"), (F.count(F.lit(1)) % 17).cast("double").alias("inference_ms"))
    return rn.efficiency(d.withColumns({"preprocess_ms": F.col("inference_ms") * 0.25, "postprocess_ms": F.col("inference_ms") * 0.5, "imgsz": F.lit(640)}))


# -- runs ----------------------------------------------------------------------------------------


@query(ex._with("fam as (select regexp_replace(run_name, '_seed[0-9]+$', '') as family, cls, metric from run_metrics_class)", "b as (select family, cls, avg(metric) as mean, count(metric) as n from fam group by all)", "e as (select * from b union all select family, null, avg(mean), count(mean) from b group by family)") + "select e.family, e.cls, round(e.mean, 6) as mean, round(e.mean - a.mean, 6) as delta, e.n from e left join e a on a.family = 'annotred_A_yolo26' and a.cls is not distinct from e.cls")
def class_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class's mean over seeds beside that of a baseline."""
    rows = run_metrics_class(spark, sf_dir).withColumn("family", F.regexp_replace("run_name", r"_seed\d+$", ""))
    return rn.class_readout(rows, "annotred_A_yolo26").withColumns({c: F.round(c, 6) for c in ("mean", "delta")})


CONTRASTS = [("v8", "v2", "Further defect correction"), ("v2", "v1", "Earlier compositor")]


@query(ex._with("fam as (select detector, generator, pct, filter, avg(metric) as metric from runs where kind = 'hybrid' group by all)", "c as (select * from (values " + ", ".join(str(c) for c in CONTRASTS) + ") as t(generator, reference, label))") + "select c.label, f.generator, c.reference, f.detector, f.pct, f.filter, round(r.metric, 6) as a, round(f.metric, 6) as b, round(f.metric - r.metric, 6) as delta from fam f join c on c.generator = f.generator left join fam r on r.generator = c.reference and r.detector = f.detector and r.pct = f.pct and r.filter is not distinct from f.filter")
def interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an intervention changes against its reference at the same ratio and filter."""
    keys = ["detector", "pct", "filter"]
    means = rn.parsed(run_metrics(spark, sf_dir)).filter("kind = 'hybrid'").groupBy("generator", *keys).agg(F.avg("metric").alias("metric"))
    return rn.interventions(means, CONTRASTS, keys).withColumns({c: F.round(c, 6) for c in ("a", "b", "delta")})


TARGETS = [("close", 0.0, None), ("up", 0.01, "v8"), ("down", -0.01, "matched")]


@query(ex._with("fam as (select regexp_replace(run_name, '_seed[0-9]+$', '') as family, avg(metric) as metric from run_metrics group by 1)", r"r as (select *, nullif(regexp_extract(family, '_r(\d+)(?:_x(\d+))?$', 1), '') as pct, regexp_extract(family, '_r(\d+)(?:_x(\d+))?$', 2) as flt from fam)", "p as (select a.family as a, b.family as b, b.metric - a.metric as delta from r a join r b on a.pct = b.pct and a.flt = b.flt and a.family <> b.family)", "t as (select * from (values ('close', 0.0::double, null), ('up', 0.01::double, 'v8'), ('down', -0.01::double, 'matched')) as t(label, target, word))") + "select label, a, b, round(delta, 6) as delta from p join t on abs(delta - target) <= 0.0035 and (word is null or contains(a, word) or contains(b, word))")
def near_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of run families whose difference comes near a published one."""
    means = run_metrics(spark, sf_dir).groupBy(F.regexp_replace("run_name", r"_seed\d+$", "").alias("family")).agg(F.avg("metric").alias("metric"))
    return rn.near_targets(means, TARGETS, 0.0035).withColumn("delta", F.round("delta", 6))


@query(ex._with(r"s as (select *, nullif(regexp_extract(run_name, '_seed(\d+)$', 1), '')::int as seed_, regexp_replace(run_name, '_seed\d+$', '') as base from run_metrics)", r"t as (select metric, coalesce(nullif(regexp_extract(base, '(composite|sd35|flux|gan)', 1), ''), case when starts_with(base, 'matched') then 'matched' else 'real' end) as series, coalesce(nullif(regexp_extract(base, '(yolo11|yolo26|rtdetrv2|rtdetr)', 1), ''), 'det') as detector, coalesce(nullif(regexp_extract(base, '_r(\d+)', 1), '')::double / 100, 0) as ratio from s where seed_ is not null)") + "select series, detector, ratio, count(metric) as n, round(avg(metric), 6) as mean, round(stddev_pop(metric), 6) as std from t group by all")
def ratio_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of curves over ratios."""
    return rn.curves(run_metrics(spark, sf_dir), "metric").withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("select i as place, name, 'a top-down close-up photo of ' || display || ', a weed seedling on bare soil' as caption, 'a top-down close-up photo of ' || display || ', ' || stage || ' on bare soil, single isolated plant, centered, plain uniform background, sharp focus' as prompt, name <> 'LYPES' as known from (values (0, 'SOLNI', 'Solanum nigrum (nightshade)', 'at the cotyledon stage with a single pair of seed leaves'), (1, 'POROL', 'Portulaca oleracea (purslane)', 'at the cotyledon stage with two small fleshy seed leaves'), (2, 'SETVE', 'Setaria verticillata (foxtail)', 'a grass seedling at the one-leaf stage'), (3, 'CYPRO', 'Cyperus rotundus (nutsedge)', 'a grass seedling at the one-leaf stage'), (4, 'ECHCG', 'Echinochloa crus-galli (barnyardgrass)', 'a grass seedling at the one-leaf stage'), (null, 'LYPES', 'LYPES', 'at the cotyledon stage with a single pair of seed leaves')) as t(i, name, display, stage)")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pictures of each class are described as."""
    rows = spark.createDataFrame([(c,) for c in (*nm.CLASSES, "LYPES")], "name string")
    name = F.col("name")
    return rows.select(nm.class_id(name, strict=False).alias("place"), "name", nm.caption(name).alias("caption"), nm.close_up_prompt(name, F.get(nm.stages(name), F.lit(0))).alias("prompt"), nm.is_known(name).alias("known"))


@query(_with("u as (select distinct field from frames)") + "select field, starts_with(field, 'TOMATO_1') as early, 'TOMATO_1/1' = field or starts_with(field, 'TOMATO_2/2') as listed from u")
def source_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin with an allowed source."""
    from .fixtures import frames

    f = frames(spark, sf_dir).select("field").distinct()
    name = F.col("field")
    return f.select("field", nm.from_sources(name, ["TOMATO_1"]).alias("early"), ((name == "TOMATO_1/1") | nm.from_sources(name, ["TOMATO_2/2"])).alias("listed"))


@query("select row_number() over (order by k, r, s) - 1 as \"index\", (['real', 'hybrid'])[k] as kind, r as ratio, s::int as seed from (select unnest([1, 2]) as k), (select unnest([0.25, 0.625, 1.0, 1.375, 1.75])::double as r), (select unnest(range(3)) as s)")
def ratio_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of a sweep over ratios that aren't whole percentages."""
    from ..operators.sampling import ratio_plan as plan

    return plan(["real", "hybrid"], nm.ratio_grid("0.25:1.75:0.375"), 3, spark)


@query()
def scene_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where items go in their scenes without covering each other; how many find a place."""
    from pyspark.sql.window import Window

    from ..operators.sampling import placements

    g = gt_box(spark, sf_dir).filter("seed = 0 and cls < 2")
    k = F.row_number().over(Window.partitionBy("tile_id").orderBy("cls", "gid"))
    items = g.select("tile_id", k.alias("k"), (F.col("x2") - F.col("x1")).cast("bigint").alias("width"), (F.col("y2") - F.col("y1")).cast("bigint").alias("height"), F.lit(1400).alias("scene_width"), F.lit(1400).alias("scene_height"))
    put = placements(items, ["tile_id"], 12, 0.1)
    return put.select("tile_id", "k", "x", "y")


@query()
def matched_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a pool whose sizes are spread as those of another."""
    from ..operators.sampling import matched_subsample as matched

    d = table(spark, sf_dir, "documents").filter("lang is not null")
    target, pool = d.filter("doc_id % 2 = 0").select("lang", F.col("n_chars").cast("double").alias("size")), d.filter("doc_id % 2 = 1").select("lang", F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("size"))
    return matched(target, pool, ["lang"], "size", 20)
