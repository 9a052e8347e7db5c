"""Queries that write files of the kinds that the sinks make, read them back, and report what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box, to_yolo
from ..functions.names import CLASSES, EXCLUDED
from ..operators import priors as pr
from ..operators import regions as rg
from ..operators import sampling as sm
from ..operators import splits as sp
from ..sources import annotations as an
from ..sources import experiments as ex
from ..sources import sinks
from ..storage import Scratch
from .datasets import _draw
from .fixtures import SQL, _boxes, detections, frames, gt_box, run_metrics, run_metrics_class

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return f"with recursive {SQL}, " + ", ".join([_RAW, *ctes]) + " "


# -- annotations ---------------------------------------------------------------------------------

_RAW = """
raw as (select l_orderkey as frame, case when l_returnflag = 'N' and l_tax = 0 then 'NR' when l_linenumber = 6 then 'ABCDE' else (['SOLNI', 'POROL', 'SETVE', 'CYPRO', 'ECHCG'])[cls0 + 1] end as name,
  x * 3 as x1, y * 3 as y1, case when l_discount = 0.1::double then x * 3 else x * 3 + w end as x2, y * 3 + h as y2 from li),
voc_frames as (select frame, field, source, case when frame % 50 = 0 then 0 else width end as width, case when frame % 50 = 0 then 0 else height end as height, frame % 9 = 0 as plain from frames),
cut_raw as (select frame, field, name, width, case when width > 0 then greatest(0, least(x1, width)) else x1 end as x1, case when width > 0 then greatest(0, least(y1, height)) else y1 end as y1,
  case when width > 0 then greatest(0, least(x2, width)) else x2 end as x2, case when width > 0 then greatest(0, least(y2, height)) else y2 end as y2 from raw join voc_frames using (frame)),
reasons as (select *, case when name = 'NR' then 'excluded:NR' when name = 'ABCDE' then 'unknown:ABCDE' when width <= 0 then 'no_size' when x2 <= x1 or y2 <= y1 then 'degenerate_box' end as reason from cut_raw)"""


def voc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, source and value: an XML file's text for each frame."""
    b = _boxes(spark, sf_dir)
    names = F.array(*map(F.lit, CLASSES))
    name = F.when((F.col("l_returnflag") == "N") & (F.col("l_tax") == 0), "NR").when(F.col("l_linenumber") == 6, "ABCDE").otherwise(names[F.col("cls0")])
    x1, y1 = F.col("x") * 3, F.col("y") * 3
    x2, y2 = F.when(F.col("l_discount") == 0.1, x1).otherwise(x1 + F.col("w")), y1 + F.col("h")
    text = F.format_string("<object><name> %s </name><bndbox><xmin>%d</xmin><ymin>%d.0</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>", name, x1, y1, x2, y2)
    objects = b.groupBy(F.col("l_orderkey").alias("frame")).agg(F.array_join(F.collect_list(text), "").alias("objects"))
    f = frames(spark, sf_dir).join(objects, "frame", "left")
    size = F.when(F.col("frame") % 50 == 0, F.lit("")).otherwise(F.format_string("<size><width>%d</width><height>%d</height><depth>3</depth></size>", "width", "height"))
    folder = F.when(F.col("frame") % 9 == 0, F.lit("Images")).otherwise(F.element_at(F.split("field", "/"), 2))
    value = F.concat(F.lit("<annotation><folder>"), folder, F.lit("</folder><filename> f"), F.col("frame"), F.lit(".JPG </filename>"), size, F.coalesce("objects", F.lit("")), F.lit("<object><name></name></object></annotation>"))
    return f.select(F.concat(F.lit("/data/"), F.col("field"), F.lit("/Annotations/f"), F.col("frame"), F.lit(".xml")).alias("path"), "source", value.alias("value"))


def _voc(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    files = voc_files(spark, sf_dir)
    one, two = (an.parse_voc(files.filter(F.col("source") == s), s, **how) for s in ("TOMATO_1", "TOMATO_2"))
    return one.unionByName(two)


@query(_with("n as (select frame, count(*) as objects from raw group by frame)") + "select source, case when plain then 'Images' else split_part(field, '/', 2) end as plot, case when source = 'TOMATO_1' then 2021 else 2022 end as year, count(*) as frames, sum(width + 2 * height)::bigint as sizes, sum(coalesce(objects, 0))::bigint as objects from voc_frames left join n using (frame) group by all")
def voc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and objects of XML annotations, by plot."""
    rows = _voc(spark, sf_dir)
    return rows.groupBy("source", "plot", "year").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("width") + 2 * F.col("height")).alias("sizes"), F.sum(F.size("objects")).cast("bigint").alias("objects"))


@query(_with("n as (select frame, count(*) filter (name = 'SETVE') as setve from raw group by frame)") + "select case when plain then field || '/Annotations' else split_part(field, '/', 2) end as plot, count(*) as frames, sum(coalesce(setve, 0))::bigint as setve from voc_frames left join n using (frame) group by all")
def voc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where a folder that says nothing is told by the path."""
    rows = _voc(spark, sf_dir, upper_names=True, folder_depth=3)
    return rows.groupBy("plot").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size(F.filter("objects", lambda o: o["name"] == "SETVE"))).cast("bigint").alias("setve"))


@query(_with() + "select coalesce(reason, 'kept') as reason, count(*) as n, sum(x1 + 2 * y1 + 3 * x2 + 5 * y2)::bigint as total from reasons group by reason")
def skipped_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated objects by the reason for which they are left out."""
    rows = an.boxes(_voc(spark, sf_dir), list(CLASSES), EXCLUDED)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x1") + 2 * F.col("y1") + 3 * F.col("x2") + 5 * F.col("y2")).cast("bigint").alias("total"))


@query(_with("c as (select source, name, count(*) as n from reasons join voc_frames using (frame) where reason is null group by all)") + "select coalesce(source, 'all') as source, coalesce(name, 'all') as name, sum(n)::bigint as n from c group by cube (source, name)")
def class_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each class by source, with totals."""
    rows = _voc(spark, sf_dir)
    kept = an.boxes(rows, list(CLASSES), EXCLUDED).filter("reason is null").join(rows.select("uid", "source"), "uid")
    return kept.cube("source", "name").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("name", F.lit("all")).alias("name"), "n")


@query(_with("n as (select frame, count(*) as n, sum(x1 + y2)::bigint as total from raw group by frame)") + "select field, count(*) as photos, count(*) filter (frame % 4 = 0) as refused, sum(case when frame % 4 <> 0 then coalesce(n, 0) end)::bigint as boxes, sum(case when frame % 4 <> 0 then total end)::bigint as total from frames left join n using (frame) group by field")
def photos_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos without an annotation, which can't be told to be free of objects, and the boxes of the others."""
    f, files = frames(spark, sf_dir), voc_files(spark, sf_dir)
    where = F.concat(F.lit("/data/"), F.col("field"), F.lit("/Annotations/f"), F.col("frame"), F.lit(".xml"))
    photos = f.select("frame", "field", F.when(F.col("frame") % 4 != 0, where).alias("xml"))
    rows = an.photo_boxes(photos, files)
    total = F.aggregate("boxes", F.lit(0).cast("bigint"), lambda s, b: s + b["x1"] + b["y2"])
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("photos"), F.count_if(F.col("boxes").isNull()).alias("refused"), F.sum(F.when(F.col("boxes").isNotNull(), F.size("boxes"))).cast("bigint").alias("boxes"), F.sum(F.when(F.size("boxes") > 0, total)).alias("total"))


@query(_with() + "select '/data/' || field || '/Annotations' as folder, count(*) as n from frames group by field order by n desc, folder limit 40")
def xml_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders with the most annotations."""
    return an.xml_folders(voc_files(spark, sf_dir).select("path"))


_PHOTOS = "photos as (select frame, split_part(field, '/', 1) as dataset, 'f' || frame as stem from frames where frame % 3 <> 0)"


@query(_with(_PHOTOS) + "select dataset, count(*) as photos, count(*) filter (frame % 5 <> 0) as annotated from photos where frame % 7 < 4 group by dataset")
def allowed_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of data sets that a list allows, and those with an annotation."""
    f = frames(spark, sf_dir)
    name = F.concat(F.lit("f"), F.col("frame"))
    images = f.filter("frame % 3 <> 0").select(F.concat(F.lit("/data/"), F.col("source"), F.lit("/Images/"), name, F.when(F.col("frame") % 2 == 0, ".JPG").otherwise(".png")).alias("path"))
    notes = f.filter("frame % 5 <> 0").select(F.concat(F.lit("/data/"), F.col("source"), F.lit("/Annotations/"), name, F.lit(".xml")).alias("path"))
    other = images.withColumn("path", F.concat("path", F.lit(".txt")))
    rows = an.photos_of(images.unionByName(other), notes, ["TOMATO_1", "TOMATO_2"], f.filter("frame % 7 < 4").select(name.alias("stem")))
    return rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("photos"), F.count("xml").alias("annotated"))


# -- labels, detections, regions, manifests ------------------------------------------------------


@query(_with("y as (select tile_id, cls, (x1 + x2) / 2 / 1500 as cx, (y1 + y2) / 2 / 1500 as cy, (x2 - x1) / 1500 as w, (y2 - y1) / 1500 as h from gt where seed = 0 and (x2 - x1) * (y2 - y1) >= 2000)") + "select tile_id::varchar as image, cls, count(*) as n, sum(round(cx * 1e6) + 2 * round(cy * 1e6) + 3 * round(w * 1e6) + 5 * round(h * 1e6))::bigint as total from y group by all")
def yolo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of all images, written and read back."""
    y = to_yolo(box(), F.lit(1500.0), F.lit(1500.0))
    rows = gt_box(spark, sf_dir).filter("seed = 0").select(F.col("tile_id").cast("string").alias("image"), "cls", y.alias("y"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area")).select("image", "cls", "y.*", "area")
    folder = f"{Scratch(spark, 'yolo').root}/labels"
    sinks.write_yolo(rows, folder, 2000.0)
    found = an.read_yolo(spark, folder)
    millionths = [F.round(F.col(c) * 1e6).cast("bigint") for c in ("cx", "cy", "w", "h")]
    return found.groupBy("image", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum(millionths[0] + 2 * millionths[1] + 3 * millionths[2] + 5 * millionths[3]).alias("total"))


@query(_with() + "select 'model_seed' || seed as run, count(*) as n, sum(did)::bigint as total from det where seed < 2 and tile_id % 2 = 0 group by seed")
def detection_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored detections of the runs that fit a glob, of one split."""
    d = detections(spark, sf_dir).withColumns({"run": F.concat(F.lit("model_seed"), F.col("seed")), "split": F.when(F.col("tile_id") % 2 == 0, "test").otherwise("val")})
    folder = f"{Scratch(spark, 'detections').root}/runs"
    sinks.write_detections(d, folder)
    return ex.read_detections(spark, folder, "model_seed[01]", "test").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("did").alias("total"))


_EXT = "ext as (select tile_id, greatest(0.0::double, min(x1) - 20) as a, greatest(0.0::double, min(y1) - 20) as b, least(1400.0::double, max(x2) + 20) as c, least(1400.0::double, max(y2) + 20) as d from gt where seed = 0 group by tile_id)"


@query(_with(_EXT) + "select tile_id::varchar as image, case when (c - a) * (d - b) / (1400.0::double * 1400.0) >= 0.995 then 'all' else 'poly' end as mode, round(a + 2 * b + 3 * c + 5 * d, 4) as corners from ext")
def region_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid regions, written as JSON and read back."""
    r = rg.from_boxes(gt_box(spark, sf_dir).filter("seed = 0"), ["tile_id"], 1400.0, 1400.0, 20.0)
    folder = f"{Scratch(spark, 'regions').root}/regions"
    sinks.write_regions(r.select(F.col("tile_id").cast("string").alias("image"), "mode", "polys"), folder)
    p = F.col("polys")[0]
    return an.read_regions(spark, folder, one_line=True).select("image", "mode", F.round(p[0][0] + 2 * p[0][1] + 3 * p[2][0] + 5 * p[2][1], 4).alias("corners"))


@query(_with("n as (select count(*) as real from frames where year = 2021)", f"s as (select frame from (select frame, row_number() over (order by {_draw(chr(39) + '4' + chr(39), 'frame')}, frame) as k from frames where year = 2022), n where k <= round_even(0.5::double * real, 0))") + "select 'real' as kind, count(*) as n, sum(frame)::bigint as total from frames where year = 2021 union all select 'synthetic', count(*), sum(frame)::bigint from s")
def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training set's list and descriptor, written, and read by way of the descriptor."""
    f = frames(spark, sf_dir).select("frame", "year")
    mixed = sm.hybrid(f.filter("year = 2021"), f.filter("year = 2022"), 0.5, "frame", 4).drop("year")
    folder = f"{Scratch(spark, 'dataset').root}/set"
    name = F.concat(F.when(F.col("is_synth"), "synthetic").otherwise("real"), F.lit("/images/"), F.col("frame"), F.lit(".png"))
    sinks.write_manifest(mixed.select(name.alias("image"), F.col("frame").alias("pos")), f"{folder}/train.txt")
    sinks.write_descriptor(f"{folder}/dataset.yaml", folder, list(CLASSES), {"train": "train.txt"}, sinks.provenance(mixed, composition="hybrid", seed=4))
    parts = F.split("image", "/")
    rows = an.dataset_images(spark, f"{folder}/dataset.yaml", "train").select(F.element_at(parts, -3).alias("kind"), F.regexp_replace(F.element_at(parts, -1), ".png", "").cast("bigint").alias("frame"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("total"))


@query(_with() + "select distinct field, case when field = 'TOMATO_1/3' then 'test' when field = 'TOMATO_2/7' then 'val' else 'train' end as split, year from frames")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split of fields, written as JSON and read back."""
    f = sp.assign(frames(spark, sf_dir), ["TOMATO_1/3"], ["TOMATO_2/7"])
    folder = f"{Scratch(spark, 'split').root}/split"
    sinks.write_split(f, folder, protocol="field-holdout")
    return ex.read_split(spark, f"{folder}/fields")[1]


# -- run tables ----------------------------------------------------------------------------------

_SPELLED = "m as (select run_name, metric, ascii(right(run_name, 1)) % 3 as k from run_metrics)"


@query(_with(_SPELLED) + "select run_name, 'test' as split, round(metric, 9) as \"precision\", round(metric / 2, 9) as recall, case when k <> 0 then round(metric, 9) end as map50, case when k <> 1 then round(metric, 9) end as map50_95 from m")
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric tables with missing values in several spellings, written and read back."""
    k = F.ascii(F.right("run_name", F.lit(1))) % 3
    m = run_metrics(spark, sf_dir)
    text = m.select("run_name", F.lit("test").alias("split"), F.col("metric").cast("string").alias("precision"), (F.col("metric") / 2).cast("string").alias("recall"), F.lit("").alias("f1"), F.when(k == 0, "nan").otherwise(F.col("metric").cast("string")).alias("map50"), F.when(k == 1, "NaN").otherwise(F.col("metric").cast("string")).alias("map50_95"))
    folder = f"{Scratch(spark, 'metrics').root}/runs"
    sinks.append_metrics(text.filter(k == 0), folder)
    sinks.append_metrics(text.filter(k != 0), folder)
    rows = ex.read_metrics(spark, folder)
    return rows.select("run_name", "split", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "map50", "map50_95")))


@query(_with("m as (select run_name, cls, metric from run_metrics_class where not (cls = 2 and run_name like '%seed1'))") + "select run_name, cls as class_id, round(metric, 9) as map50 from m")
def class_metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by class, without classes that a test set lacks, written and read back."""
    m = run_metrics_class(spark, sf_dir)
    absent = (F.col("cls") == 2) & F.col("run_name").endswith("seed1")
    text = m.select("run_name", F.lit("test").alias("split"), F.col("cls").alias("class_id"), F.lit("x").alias("class"), F.when(absent, 0).otherwise(1).alias("present_in_test"), F.coalesce(F.col("metric").cast("string"), F.lit("nan")).alias("map50"), F.lit("nan").alias("map50_95"))
    folder = f"{Scratch(spark, 'class-metrics').root}/runs"
    sinks.append_metrics(text, folder)
    return ex.read_class_metrics(spark, folder).select("run_name", "class_id", F.round("map50", 9).alias("map50"))


@query(_with("sides as (select cls, greatest(x2 - x1, y2 - y1) as side from gt where seed = 0)", "g as (select unnest(['all', cls::varchar]) as class, side from sides)") + "select class, count(*) as n, round(count(*)::double / (select count(*) from sides), 6) as share, round(quantile_cont(side, 0.5), 6) as median, round(quantile_cont(side, 0.25), 6) as q1 from g group by class")
def prior_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior of sizes, written as JSON and read back."""
    rows = gt_box(spark, sf_dir).filter("seed = 0").select("cls", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("side"))
    q = pr.quantiles(rows, "cls", "side", [k / 4 for k in range(5)]).withColumnRenamed("q", "longest_side_q")
    path = f"{Scratch(spark, 'prior').root}/prior.json"
    sinks.write_scale_prior(q.withColumnRenamed("cls", "class"), path)
    return ex.read_scale_prior(spark, path).select("class", "n", F.round("share", 6).alias("share"), F.round("median", 6).alias("median"), F.round(F.col("longest_side_q")[1], 6).alias("q1"))


_FILES = r"runs as (select run_name from run_metrics), kept as (select run_name as run, regexp_replace(run_name, '_seed\d+$', '') as base, regexp_replace(regexp_replace(run_name, '_seed\d+$', ''), '_(yolo11|yolo26|rtdetrv2).*$', '') as stem from runs where not ends_with(run_name, '2') and (starts_with(run_name, 'hybrid') or starts_with(run_name, 'annotred')))"


@query(_with(_FILES) + "select run, case when base like '%_r100' then base else stem end as dataset, base like '%_r100' or stem in ('annotred_A', 'annotred_T') as \"exists\" from kept")
def checkpoint_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with weights, and the data set that each was trained on."""
    m = run_metrics(spark, sf_dir).select("run_name")
    last = F.col("run_name").endswith("2")
    files = m.select(F.concat(F.lit("/runs/"), F.col("run_name"), F.when(last, "/weights/last.pt").otherwise("/weights/best.pt")).alias("path"))
    found = ex.checkpoints(files, "[ha]*").select("run")
    base = F.regexp_replace("run_name", r"_seed\d+$", "")
    there = m.select(base.alias("dataset")).filter(F.col("dataset").endswith("_r100")).unionByName(spark.createDataFrame([("annotred_A",), ("annotred_T",)], "dataset string"))
    return ex.dataset_of(found, there)
