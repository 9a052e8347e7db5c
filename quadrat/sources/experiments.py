"""Readers of run metrics, training logs, priors and configurations."""

from __future__ import annotations

import fnmatch
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = ("precision", "recall", "f1", "map50", "map50_95")
METRICS = "run_name string, split string, " + ", ".join(f"{c} string" for c in NUMBERS)
CLASS_METRICS = "run_name string, split string, class_id string, class string, present_in_test string, map50 string, map50_95 string"


def _typed(df: DataFrame) -> DataFrame:
    """Numbers from text; what is no number, NaN in any spelling included, is null, so that aggregates leave it out."""
    def number(c: str):
        x = F.trim(F.col(c)).try_cast("double")
        return F.when(~F.isnan(x), x)

    return df.filter("run_name is not null").withColumns({c: number(c) for c in NUMBERS if c in df.columns})


def _csv(reader, schema: str):
    return reader.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("mode", "PERMISSIVE")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all metric CSVs under path; one file per run, or one file of all."""
    return _typed(_csv(spark.read, METRICS).csv(path))


def read_class_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Rows by class; classes that the test set lacks are dropped."""
    rows = _typed(_csv(spark.read, CLASS_METRICS).csv(path))
    rows = rows.withColumns({c: F.trim(F.col(c)).try_cast("double").cast("int") for c in ("class_id", "present_in_test")})
    return rows.filter("coalesce(present_in_test, 1) <> 0")


def stream_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The same as read_metrics, as a stream of files that runs add."""
    return _typed(_csv(spark.readStream, METRICS).csv(folder))


def metrics_by_split(rows: DataFrame, metric: str, splits: list[str]) -> DataFrame:
    return rows.groupBy("run_name").pivot("split", splits).agg(F.first(metric))


def read_train_log(spark: SparkSession, path: str, column: str = "lr/pg0") -> DataFrame:
    """run (folder), epoch and lr of training logs; the column is found by a part of its name, blanks aside."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "results.csv").text(path, wholetext=True)
    rows = lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"), F.filter(F.split(F.trim("value"), r"\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    head = F.transform(F.split(F.get("lines", F.lit(0)), ","), lambda c: F.trim(c))
    at = F.array_position(F.transform(head, lambda c: F.contains(c, F.lit(column))), F.lit(True)) - 1
    rows = rows.select("run", at.cast("int").alias("at"), F.posexplode(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0)))).alias("pos", "line")).filter("at >= 0")
    return rows.select("run", (F.col("pos") + 1).alias("epoch"), F.expr("try_cast(trim(get(split(line, ','), at)) as double)").alias("lr")).filter("lr is not null")


def families(rows: DataFrame, least: int = 2) -> DataFrame:
    """Run families (name without seed) with enough seeds."""
    name = F.regexp_replace("run_name", r"_seed\d+$", "")
    return rows.groupBy(name.alias("family")).agg(F.count_distinct("run_name").alias("seeds")).filter(F.col("seeds") >= least)


def _over(base: object, top: object) -> object:
    """top where either isn't a mapping, else both keys' values, the shared ones laid over each other."""
    if not (isinstance(base, dict) and isinstance(top, dict)):
        return top
    return base | {k: _over(base[k], v) if k in base else v for k, v in top.items()}


def load_config(path: str | Path) -> dict:
    """A YAML file laid over the one that its extends names (a path from the file), and that over its own, and so on.

    Of nested mappings the keys are merged, all else is replaced. Files that extend each other are an error.
    """
    import yaml

    chain, at = {}, Path(path).resolve()
    while at:
        if at in chain:
            raise ValueError(f"{at} extends itself")
        chain[at] = own = yaml.safe_load(at.read_text()) or {}
        parent = own.pop("extends", None)
        at = (at.parent / parent).resolve() if parent else None
    return reduce(_over, reversed(chain.values()))


def _json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", ddl).alias("d"))


def read_split(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """uid and split of frames, and field, split and year of fields, from a split's JSON."""
    rows = _json(spark, path, "plot_to_split map<string,string>, field_year map<string,int>, uid_to_split map<string,string>")
    frames = rows.select(F.explode("d.uid_to_split").alias("uid", "split"))
    fields = rows.select(F.explode("d.plot_to_split").alias("field", "split"), "d.field_year").select("field", "split", F.col("field_year")[F.col("field")].alias("year"))
    return frames, fields


def read_scale_prior(spark: SparkSession, path: str) -> DataFrame:
    """class ('all' for the whole), n, share, median, longest_side_q and geom_mean_q of a prior of sizes."""
    one = "struct<n:bigint,share:double,longest_side_q:array<double>,geom_mean_q:array<double>,median:double>"
    rows = _json(spark, path, f"classes map<string,{one}>, `all` {one}")
    every = F.map_concat("d.classes", F.when(F.col("d.all").isNotNull(), F.create_map(F.lit("all"), F.col("d.all"))).otherwise(F.create_map().cast(f"map<string,{one}>")))
    return rows.select(F.explode(every).alias("class", "p")).select("class", "p.*")


def read_appearance_prior(spark: SparkSession, path: str) -> DataFrame:
    """stat, n, p10, p50, p90 of the real pool: under 'real', or the object itself."""
    one = "map<string,struct<n:bigint,p10:double,p50:double,p90:double>>"
    raw = spark.read.text(path, wholetext=True)
    found = F.coalesce(F.from_json("value", f"real {one}")["real"], F.from_json("value", one))
    return raw.select(F.explode(found).alias("stat", "p")).select("stat", "p.*")


def read_detections(spark: SparkSession, path: str, runs: str = "*", split: str | None = None) -> DataFrame:
    """What write_detections stored, of the runs whose name fits a glob and of one split; other folders aren't read."""
    rows = spark.read.parquet(path)
    rows = rows.filter(F.col("run").rlike("^" + fnmatch.translate(runs)))
    return rows.filter(F.col("split") == split) if split else rows


def checkpoints(files: DataFrame, runs: str = "*") -> DataFrame:
    """run and path of the best weights (<run>/weights/best.pt) among files (path), of the runs whose name fits a glob."""
    parts = F.split("path", "/")
    rows = files.filter(F.col("path").endswith("/weights/best.pt")).select(F.element_at(parts, -3).alias("run"), "path")
    return rows.filter(F.col("run").rlike("^" + fnmatch.translate(runs)))


def dataset_of(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """runs (run) with dataset: that of the run's own name without the seed, if there is one, else the name up to the detector.

    datasets has dataset, the names that there are; a name that isn't there is given all the same, with exists false.
    """
    base = F.regexp_replace("run", r"_seed\d+$", "")
    rows = runs.withColumns({"_a": base, "_b": F.regexp_replace(base, r"_(?:yolo11|yolo26|rtdetrv2).*$", "")})
    there = datasets.select("dataset").distinct()
    a, b = there.select(F.col("dataset").alias("_a"), F.lit(True).alias("_has_a")), there.select(F.col("dataset").alias("_b"), F.lit(True).alias("_has_b"))
    rows = rows.join(a, "_a", "left").join(b, "_b", "left")
    return rows.select(*runs.columns, F.when(F.col("_has_a"), F.col("_a")).otherwise(F.col("_b")).alias("dataset"), (F.coalesce("_has_a", "_has_b", F.lit(False))).alias("exists"))
