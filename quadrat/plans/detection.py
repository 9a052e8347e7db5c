"""Queries over detections and true boxes, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import box, overlap_of_smaller
from ..operators import evaluation as ev
from ..operators import matching as mt
from .fixtures import CELL, SQL, UNIT, conf, detections, gt_box

TEN = [0.5 + 0.05 * k for k in range(10)]
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a query and its SQL, which can use the fixture views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return f"with recursive {SQL}, " + ", ".join(ctes) + " "


def _det(spark: SparkSession, sf_dir: str, arm: int = 0) -> DataFrame:
    return detections(spark, sf_dir, arm).withColumn("conf", conf(F.col("score")))


_I = "(greatest(0.0::double, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0::double, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _area(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def _iou(a: str, b: str) -> str:
    i = _I.format(a=a, b=b)
    return f"({i} / greatest({_area(a)} + {_area(b)} - {i}, 1e-9))"


def _ioa(a: str, b: str) -> str:
    return f"({_I.format(a=a, b=b)} / greatest({_area(b)}, 1e-9))"


def _pairs(det: str = "det", gt: str = "gt", score: str | None = None, name: str = "pairs") -> str:
    return f"{name} as (select d.seed, d.tile_id, d.cls, d.did, g.gid, {score or _iou('d', 'g')} as overlap from {det} d join {gt} g on d.seed = g.seed and d.tile_id = g.tile_id and d.cls = g.cls)"


def _matches(pairs: str = "pairs", thresholds: str = "[0.5]", name: str = "matches", order: str = "did", taken: str = "gid") -> str:
    """Greedy matches by a recursion over the rows of all cells at once."""
    k = "seed, tile_id, cls, thr"
    return (
        f"{name}_t as (select seed, tile_id, cls, {order} as d, {taken} as g, overlap, unnest({thresholds})::double as thr from {pairs}), "
        f"{name}_c as (select {k}, d, list(g order by overlap desc, g) as gs from {name}_t where overlap >= thr group by {k}, d), "
        f"{name}_m as (select {k}, max(d) as n from {name}_c group by {k}), "
        f"{name}_r as (select {k}, 0 as d, []::int[] as taken, null::int as g, n from {name}_m union all "
        f"select r.seed, r.tile_id, r.cls, r.thr, r.d + 1, case when x is null then r.taken else list_append(r.taken, x) end, x, r.n from ("
        f"select r.*, list_filter(c.gs, lambda v: not list_contains(r.taken, v))[1] as x from {name}_r r left join {name}_c c on c.seed = r.seed and c.tile_id = r.tile_id and c.cls = r.cls and c.thr = r.thr and c.d = r.d + 1 "
        f"where r.d < r.n) r), "
        f"{name} as (select seed, tile_id, cls, thr, d as {order}, g as {taken} from {name}_r where g is not null)"
    )


@query(_with(_pairs()) + "select cls, floor(overlap * 20)::int as bucket, count(*) as n, round(sum(overlap), 4) as total from pairs group by all")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of detections with true boxes of their cell, in steps of 0.05."""
    p = mt.scored_pairs(_det(spark, sf_dir), gt_box(spark, sf_dir), CELL)
    return p.groupBy("cls", F.floor(F.col("overlap") * 20).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("overlap"), 4).alias("total"))


@query(_with(_pairs(score=_ioa("d", "g"))) + "select cls, floor(overlap * 20)::int as bucket, count(*) as n, round(sum(overlap), 4) as total from pairs group by all")
def ioa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each true box that each detection covers, in steps of 0.05."""
    p = mt.scored_pairs(_det(spark, sf_dir), gt_box(spark, sf_dir), CELL, "ioa")
    return p.groupBy("cls", F.floor(F.col("overlap") * 20).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("overlap"), 4).alias("total"))


@query(_with(f"p as (select a.seed, a.tile_id, {_I.format(a='a', b='b')} / greatest(least({_area('a')}, {_area('b')}), 1e-9) as o from gt a join gt b on a.seed = b.seed and a.tile_id = b.tile_id and a.cls = b.cls and a.gid < b.gid where a.seed = 0)") + "select tile_id, count(*) as n, round(max(o), 6) as largest from p group by tile_id")
def overlap_min_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest overlap of two boxes of a class over the smaller one, by image."""
    g = gt_box(spark, sf_dir).filter("seed = 0")
    h = g.select("tile_id", "cls", F.col("gid").alias("h_gid"), *(F.col(c).alias(f"h_{c}") for c in ("x1", "y1", "x2", "y2")))
    p = g.join(h, ["tile_id", "cls"]).filter("gid < h_gid").select("tile_id", overlap_of_smaller(box(), box("h_")).alias("o"))
    return p.groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("o"), 6).alias("largest"))


_CROWD = f"met as (select a.seed, a.tile_id, a.cls, a.gid, max({_iou('a', 'b')}) >= 0.1 as hit from gt a join gt b on a.seed = b.seed and a.tile_id = b.tile_id and (a.cls, a.gid) <> (b.cls, b.gid) group by all), crowds as (select t.seed, t.tile_id, t.n, case when t.n < 2 then 0.0::double else coalesce(m.hits, 0)::double / t.n end as crowding from (select seed, tile_id, count(*) as n from gt group by all) t left join (select seed, tile_id, count(*) filter (hit) as hits from met group by all) m using (seed, tile_id))"


@query(_with(_CROWD) + "select seed, tile_id, n, round(crowding, 6) as crowding from crowds")
def crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an image's boxes that overlap another one."""
    return mt.crowding(gt_box(spark, sf_dir), UNIT).select(*UNIT, "n", F.round("crowding", 6).alias("crowding"))


@query(_with(_CROWD) + "select seed, count(*) as tiles, count(*) filter (crowding > 0.5) as crowded, count(*) filter (n > 60) as full, count(*) filter (crowding <= 0.5 and n <= 60) as kept from crowds group by seed")
def crowded_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images the filters on crowding and on the number of boxes drop."""
    c, over, many = mt.crowding(gt_box(spark, sf_dir), UNIT), F.col("crowding") > 0.5, F.col("n") > 60
    return c.groupBy("seed").agg(F.count(F.lit(1)).alias("tiles"), F.count_if(over).alias("crowded"), F.count_if(many).alias("full"), F.count_if(~over & ~many).alias("kept"))


@query(_with(_pairs(), _matches()) + "select cls, count(*) as tp, sum(did)::bigint as sum_did, sum(gid)::bigint as sum_gid from matches group by cls")
def greedy_match_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches at IoU 0.5, by class, with sums that tell which rows matched."""
    m = mt.match(_det(spark, sf_dir), gt_box(spark, sf_dir), CELL, [0.5])
    return m.groupBy("cls").agg(F.count(F.lit(1)).alias("tp"), F.sum("did").alias("sum_did"), F.sum("gid").alias("sum_gid"))


@query(_with(_pairs(), _matches(thresholds="[0.3, 0.5, 0.75]")) + "select cls, thr, count(*) as tp, sum(did)::bigint as sum_did from matches group by cls, thr")
def match_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches at several thresholds from one list of pairs."""
    m = mt.match(_det(spark, sf_dir), gt_box(spark, sf_dir), CELL, [0.3, 0.5, 0.75])
    return m.groupBy("cls", "thr").agg(F.count(F.lit(1)).alias("tp"), F.sum("did").alias("sum_did"))


_MASK = (
    _pairs(name="pairs"),
    "positive as (select * from pairs where overlap > 0)",
    _matches("positive", "[1e-300]", "mm", "gid", "did"),
    "hit as (select mm.*, p.overlap from mm join pairs p using (seed, tile_id, cls, did, gid) where p.overlap >= 0.7)",
    "per as (select g.seed, g.tile_id, g.n, h.k, h.m from (select seed, tile_id, count(*) as n from gt group by all) g left join (select seed, tile_id, count(*) as k, avg(overlap) as m from hit group by all) h using (seed, tile_id))",
)


@query(_with(*_MASK) + "select seed, count(*) as files, count(k) as files_matched, round(sum(coalesce(k, 0)) / sum(n), 6) as recall, round(avg(m), 6) as mean_iou from per group by seed")
def mask_qc_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality check by truth-first matches: recall, and the mean over images with a match of their mean IoU."""
    gt = gt_box(spark, sf_dir)
    m = mt.match_truth_first(_det(spark, sf_dir), gt, CELL, 0.7).groupBy(*UNIT).agg(F.count(F.lit(1)).alias("k"), F.avg("overlap").alias("m"))
    per = gt.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n")).join(m, UNIT, "left")
    return per.groupBy("seed").agg(F.count(F.lit(1)).alias("files"), F.count("k").alias("files_matched"), F.round(F.sum(F.coalesce("k", F.lit(0))) / F.sum("n"), 6).alias("recall"), F.round(F.avg("m"), 6).alias("mean_iou"))


_TAX = (
    _pairs(),
    _matches(thresholds="[0.1, 0.5]"),
    f"others as (select d.seed, d.tile_id, d.cls, d.did, {_iou('d', 'g')} as o, g.cls as g_cls from det d join gt g on d.seed = g.seed and d.tile_id = g.tile_id and d.cls <> g.cls)",
    "best_o as (select seed, tile_id, cls, did, max(o) as o, arg_min(g_cls, (-o, g_cls)) as c from others group by all)",
    "best_s as (select seed, tile_id, cls, did, max(overlap) as o from pairs group by all)",
    "hits as (select seed, tile_id, cls, did, bool_or(thr = 0.5) as hit, bool_or(thr = 0.1) as hit_loose from matches group by all)",
    "tax0 as (select d.seed, d.tile_id, d.cls, d.did, coalesce(h.hit, false) as hit, coalesce(h.hit_loose, false) as hit_loose, coalesce(o.o, 0) as o, coalesce(s.o, 0) as s, o.c from det d left join hits h using (seed, tile_id, cls, did) left join best_o o using (seed, tile_id, cls, did) left join best_s s using (seed, tile_id, cls, did))",
    "tax as (select *, case when hit then null when o >= 0.5 then 'cls' when s >= 0.1 then 'loc' else 'bkg' end as error, case when not hit and o >= 0.5 then c end as confused_with from tax0)",
    "report as (select g.cls, g.n_gt, t.* exclude (cls) from (select cls, count(*) as n_gt from gt group by cls) g left join (select cls, count(*) as n_pred, count(*) filter (hit) as tp, count(*) filter (hit_loose) as tp_loose, count(*) filter (error = 'cls') as fp_cls, count(*) filter (error = 'loc') as fp_loc, count(*) filter (error = 'bkg') as fp_bkg from tax group by cls) t using (cls))",
)


@query(_with(*_TAX) + "select cls, n_gt, n_pred, tp, n_gt - tp as fn, round(tp::double / n_gt, 6) as recall, round(tp_loose::double / n_gt, 6) as recall_loose, round(tp::double / n_pred, 6) as \"precision\" from report")
def pr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, precision and recall by class."""
    gt = gt_box(spark, sf_dir)
    r = ev.class_report(ev.taxonomy(_det(spark, sf_dir), gt, UNIT), gt)
    return r.select("cls", "n_gt", "n_pred", "tp", "fn", *(F.round(c, 6).alias(c) for c in ("recall", "recall_loose", "precision")))


@query(_with(*_TAX) + "select cls, fp_cls, fp_loc, fp_bkg, n_gt - tp as fn from report")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives by kind, and misses, by class."""
    gt = gt_box(spark, sf_dir)
    return ev.class_report(ev.taxonomy(_det(spark, sf_dir), gt, UNIT), gt).select("cls", "fp_cls", "fp_loc", "fp_bkg", "fn")


@query(_with(*_TAX) + "select cls, confused_with, n, place from (select *, row_number() over (partition by cls order by n desc, confused_with)::int as place from (select cls, confused_with, count(*) as n from tax where confused_with is not null group by all)) where place <= 2")
def confusion_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two classes that each class is most confused with."""
    e = ev.taxonomy(_det(spark, sf_dir), gt_box(spark, sf_dir), UNIT).filter("confused_with is not null")
    n = e.groupBy("cls", "confused_with").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("n"), "confused_with"))).filter("place <= 2")


@query(_with(*_TAX) + "select round(sum(tp)::double / sum(n_pred), 6) as micro_precision, round(sum(tp)::double / sum(n_gt), 6) as micro_recall, round(avg(tp::double / n_pred), 6) as macro_precision, round(avg(tp::double / n_gt), 6) as macro_recall, round(max(tp::double / n_gt) - min(tp::double / n_gt), 6) as recall_span from report")
def micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall over all detections, and averaged over classes."""
    gt = gt_box(spark, sf_dir)
    r = ev.class_report(ev.taxonomy(_det(spark, sf_dir), gt, UNIT), gt)
    micro = [F.round(F.sum("tp") / F.sum(c), 6).alias(f"micro_{n}") for c, n in (("n_pred", "precision"), ("n_gt", "recall"))]
    macro = [F.round(F.avg(n), 6).alias(f"macro_{n}") for n in ("precision", "recall")]
    return r.agg(*micro, *macro, F.round(F.max("recall") - F.min("recall"), 6).alias("recall_span"))


_DSIZE, _GSIZE = "sqrt((x2 - x1) * (y2 - y1))", "sqrt((x2 - x1) * (y2 - y1))"


def _bin(v: str) -> str:
    return f"case when {v} < 64 then 'small' when {v} < 128 then 'medium' else 'large' end"


def _evaluated(thresholds: str, det: str = "det", gt: str = "gt", matches: str = "matches", name: str = "evaluated") -> str:
    return (
        f"{name} as (select d.seed, d.tile_id, d.cls, d.bin, d.thr, d.conf, d.did, case when h.g_bin is not null and (d.bin = 'all' or h.g_bin = d.bin) then 1.0::double else 0.0::double end as tp, "
        f"case when h.g_bin is not null then not (d.bin = 'all' or h.g_bin = d.bin) else not (d.bin = 'all' or d.d_bin = d.bin) end as ignored from ("
        f"select seed, tile_id, cls, did, score / 1000003.0::double as conf, {_bin(_DSIZE)} as d_bin, thr, unnest(['all', 'small', 'medium', 'large']) as bin from (select *, unnest({thresholds})::double as thr from {det})) d "
        f"left join (select m.seed, m.tile_id, m.cls, m.did, m.thr, {_bin(_GSIZE)} as g_bin from {matches} m join {gt} g using (seed, tile_id, cls, gid)) h using (seed, tile_id, cls, did, thr))"
    )


_NGT = f"n_units as (select seed, tile_id, cls, bin, count(*)::double as n_gt from (select seed, tile_id, cls, unnest(['all', {_bin(_GSIZE)}]) as bin from gt) group by all), n_cells as (select cls, bin, sum(n_gt) as n_gt from n_units group by all)"


def _ap(rows: str, totals: str, cell: str, name: str = "ap", weight: str = "1.0::double") -> str:
    """Average precision by plain windows over whole cells."""
    p = f"partition by {cell}"
    return (
        f"{name}_w as (select {cell}, {weight} as w, tp * {weight} as t, row_number() over ({p} order by conf desc, seed, tile_id, did) as rn from {rows} where not ignored), "
        f"{name}_c as (select {cell}, rn, sum(t) over ({p} order by rn) as ct, sum(w) over ({p} order by rn) as cw from {name}_w), "
        f"{name}_e as (select {cell}, rn, ct / n_gt as rec, max(ct / greatest(cw, 1e-9)) over ({p} order by rn rows between current row and unbounded following) as env from {name}_c join {totals} using ({cell}) where n_gt > 0), "
        f"{name}_g as (select {cell}, k, arg_max((rec, env), rn) filter (rec <= k * 0.01::double) as lo, arg_min((rec, env), rn) filter (rec > k * 0.01::double) as hi from {name}_e, range(101) as grid(k) group by {cell}, k), "
        f"{name}_v as (select {cell}, case when lo is null then hi[2] when k * 0.01::double = lo[1] then lo[2] when hi is null then 0.0::double else (hi[2] - lo[2]) / (hi[1] - lo[1]) * (k * 0.01::double - lo[1]) + lo[2] end as v from {name}_g), "
        f"{name} as (select {cell}, n_gt, case when n_gt > 0 then coalesce(v, 0) end as ap from {totals} left join (select {cell}, sum(v) / 101 as v from {name}_v group by all) using ({cell}))"
    )


def _ap_rows(spark: SparkSession, sf_dir: str, thresholds: list[float], mode: str = "iou") -> DataFrame:
    det, gt = ev.top_k(_det(spark, sf_dir)), gt_box(spark, sf_dir)
    rows = ev.evaluated(det, gt, UNIT, thresholds, mode)
    totals = ev.truth_counts(gt, UNIT).groupBy("cls", "bin").agg(F.sum("n_gt").alias("n_gt"))
    cells = totals.withColumn("thr", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return ev.average_precision(rows, cells, ["cls", "bin", "thr"], [*UNIT, "did"])


_AP50 = (_pairs(), _matches(), _evaluated("[0.5]"), _NGT, "cells as (select *, 0.5::double as thr from n_cells)", _ap("evaluated", "cells", "cls, bin, thr"))


@query(_with(*_AP50) + "select cls, bin, n_gt, round(ap, 6) as ap50 from ap")
def ap50_by_class_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision at IoU 0.5, by class and size of object."""
    return _ap_rows(spark, sf_dir, [0.5]).select("cls", "bin", "n_gt", F.round("ap", 6).alias("ap50"))


_TEN = "list_transform(range(10), lambda k: 0.5::double + 0.05::double * k)"


@query(_with(_pairs(), _matches(thresholds=_TEN), _evaluated(_TEN), _NGT, f"cells as (select *, unnest({_TEN}) as thr from n_cells)", _ap("evaluated", "cells", "cls, bin, thr")) + "select bin, round(avg(m), 6) as map50_95, round(avg(m50), 6) as map50 from (select bin, cls, avg(ap) as m, avg(ap) filter (thr = 0.5) as m50 from ap group by all) group by bin")
def map50_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over ten thresholds and all present classes, by size of object."""
    ap = ev.ap_by_bin(ev.top_k(_det(spark, sf_dir)), gt_box(spark, sf_dir), UNIT, TEN).groupBy("bin", "cls").agg(F.avg("ap").alias("m"), F.avg(F.when(F.col("thr") == 0.5, F.col("ap"))).alias("m50"))
    return ap.groupBy("bin").agg(F.round(F.avg("m"), 6).alias("map50_95"), F.round(F.avg("m50"), 6).alias("map50"))


@query(_with(_pairs(score=_ioa("d", "g")), _matches(), _evaluated("[0.5]"), _NGT, "cells as (select *, 0.5::double as thr from n_cells)", _ap("evaluated", "cells", "cls, bin, thr")) + "select cls, bin, n_gt, round(ap, 6) as ap from ap")
def ap_ioa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision where a match is the covered share of the true box."""
    return _ap_rows(spark, sf_dir, [0.5], "ioa").select("cls", "bin", "n_gt", F.round("ap", 6).alias("ap"))


_CREDIT = (
    _pairs(),
    _matches(),
    _evaluated("[0.5]", name="plain"),
    f"best as (select d.seed, d.tile_id, d.cls, d.did, max({_iou('d', 'g')}) as best from det d join gt g on d.seed = g.seed and d.tile_id = g.tile_id group by all)",
    f"plain2 as (select p.*, coalesce(best, 0) < 0.1 and (p.bin = 'all' or {_bin(_DSIZE)} = p.bin) and p.conf >= 0.25 as credit from plain p join det d using (seed, tile_id, cls, did) left join best using (seed, tile_id, cls, did))",
    "evaluated as (select * replace (case when credit then 0.4::double else tp end as tp) from plain2)",
    _NGT,
    "cells as (select cls, bin, thr, sum(n_gt) as n_gt from (select cls, bin, 0.5::double as thr, n_gt from n_cells union all select cls, bin, thr, count(*) * 0.4::double / 0.8::double from evaluated where credit group by cls, bin, thr) group by all)",
    _ap("evaluated", "cells", "cls, bin, thr"),
)


@query(_with(*_CREDIT) + "select cls, bin, round(n_gt, 6) as n_gt, round(ap, 6) as ap from ap")
def ap_scope_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision where confident detections on background count as true with a share of 0.4."""
    det, gt = ev.top_k(_det(spark, sf_dir)), gt_box(spark, sf_dir)
    rows = ev.scored(det, gt, UNIT, [0.5], verified=0.4)
    totals = ev.truth_counts(gt, UNIT, rows, 0.4, 0.8).groupBy("cls", "bin").agg(F.sum("n_gt").alias("n_gt")).withColumn("thr", F.lit(0.5))
    return ev.average_precision(ev.live_rows(rows, UNIT, [0.5], 0.4), totals, ["cls", "bin", "thr"], [*UNIT, "did"]).select("cls", "bin", F.round("n_gt", 6).alias("n_gt"), F.round("ap", 6).alias("ap"))


@query(_with(_CROWD, "calm as (select seed, tile_id from crowds where crowding <= 0.5)", "detc as (select * from det join calm using (seed, tile_id))", "gtc as (select * from gt join calm using (seed, tile_id))", _pairs("detc", "gtc"), _matches(), _evaluated("[0.5]", "detc", "gtc"), _NGT.replace("from gt)", "from gtc)"), "cells as (select *, 0.5::double as thr from n_cells)", _ap("evaluated", "cells", "cls, bin, thr")) + "select cls, bin, n_gt, round(ap, 6) as ap from ap")
def ap_drop_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision over images that aren't crowded."""
    det, gt = ev.top_k(_det(spark, sf_dir)), gt_box(spark, sf_dir)
    calm = mt.crowding(gt, UNIT).filter("crowding <= 0.5").select(*UNIT)
    det, gt = det.join(calm, UNIT, "left_semi"), gt.join(calm, UNIT, "left_semi")
    totals = ev.truth_counts(gt, UNIT).groupBy("cls", "bin").agg(F.sum("n_gt").alias("n_gt")).withColumn("thr", F.lit(0.5))
    ap = ev.average_precision(ev.evaluated(det, gt, UNIT, [0.5]), totals, ["cls", "bin", "thr"], [*UNIT, "did"])
    return ap.select("cls", "bin", "n_gt", F.round("ap", 6).alias("ap"))


RESAMPLES = 1000
_BOOT = (
    "units as (select seed, tile_id, row_number() over (order by ('0x' || substr(md5('0|' || seed || '|' || tile_id), 1, 8))::bigint, seed, tile_id) - 1 as number, count(*) over () as n from (select distinct seed, tile_id from gt))",
    f"draws as (select b as resample, ('0x' || substr(md5('0|' || b || '|' || k), 1, 8))::bigint % n as number from range({RESAMPLES}) as bs(b), (select number as k, n from units))",
    "weights as (select resample, seed, tile_id, count(*)::double as w from draws join units using (number) group by all)",
    _NGT,
    "totals as (select resample, cls, sum(n_gt * w) as n_gt from n_units join weights using (seed, tile_id) where bin = 'all' group by all)",
)


def _resampled(name: str, evaluated: str) -> tuple[str, ...]:
    return (
        f"{name}_rows as (select e.*, w.resample, w.w from {evaluated} e join weights w using (seed, tile_id) where bin = 'all')",
        _ap(f"{name}_rows", "totals", "resample, cls", name, "w"),
        f"{name}_maps as (select resample, avg(ap) as map from {name} group by resample)",
    )


def _maps(spark: SparkSession, sf_dir: str, arms: list[int]) -> DataFrame:
    gt = gt_box(spark, sf_dir)
    rows = [ev.scored(ev.top_k(_det(spark, sf_dir, arm)), gt, UNIT, [0.5]).withColumn("tp", F.when(F.col("hit0").isNotNull(), 1.0).otherwise(0.0)) for arm in arms]
    return ev.resampled_map(rows, ev.truth_counts(gt, UNIT).filter("bin = 'all'"), UNIT, RESAMPLES)


@query(_with(_pairs(), _matches(), _evaluated("[0.5]"), *_BOOT, *_resampled("ra", "evaluated")) + "select count(*) as resamples, round(avg(map), 6) as mean, round(quantile_cont(map, 0.025), 6) as low, round(quantile_cont(map, 0.975), 6) as high from ra_maps")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean average precision over resampled images."""
    m = _maps(spark, sf_dir, [0]).withColumnRenamed("map0", "map")
    return m.agg(F.count(F.lit(1)).alias("resamples"), F.round(F.avg("map"), 6).alias("mean"), *(F.round(F.percentile("map", F.lit(q)), 6).alias(n) for q, n in ((0.025, "low"), (0.975, "high"))))


@query(
    _with(_pairs(), _matches(), _evaluated("[0.5]"), _pairs("detb", name="pairsb"), _matches("pairsb", name="matchesb"), _evaluated("[0.5]", "detb", matches="matchesb", name="evaluatedb"), *_BOOT, *_resampled("ra", "evaluated"), *_resampled("rb", "evaluatedb"))
    + "select count(*) as resamples, round(avg(d), 6) as delta, round(quantile_cont(d, 0.025), 6) as low, round(quantile_cont(d, 0.975), 6) as high, 2 * least(count(*) filter (d <= 0), count(*) filter (d >= 0))::double / count(*) as p from (select b.map - a.map as d from ra_maps a join rb_maps b using (resample))"
)
def paired_bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two models' mean average precision over the same resampled images."""
    d = _maps(spark, sf_dir, [0, 1]).select((F.col("map1") - F.col("map0")).alias("d"))
    p = 2 * F.least(F.count_if(F.col("d") <= 0), F.count_if(F.col("d") >= 0)) / F.count(F.lit(1))
    return d.agg(F.count(F.lit(1)).alias("resamples"), F.round(F.avg("d"), 6).alias("delta"), *(F.round(F.percentile("d", F.lit(q)), 6).alias(n) for q, n in ((0.025, "low"), (0.975, "high"))), p.alias("p"))
