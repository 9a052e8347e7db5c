"""Writers. A sink refuses an empty result where the next step would read nothing."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import file_system

#: Rows of a JSON report.
MOST_REPORT = 10_000


def write_yolo(boxes: DataFrame, path: str, least_area: float = 0.0, split: str | None = None) -> DataFrame:
    """Label files <path>/<split>/<image>.txt (without split: <path>/<image>.txt), lines 'cls cx cy w h' in the order of line, if there.

    boxes has image, cls, cx, cy, w, h and, with least_area, area. An image's lines go to one task, which writes its
    file whole; a task that runs again writes the same. Returns image and n of the files. Old files stay: purge() first.
    """
    if least_area:
        boxes = boxes.filter(F.col("area") >= least_area)
    folder = F.concat(F.col(split), F.lit("/")) if split else F.lit("")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h")
    order = ["line"] if "line" in boxes.columns else ["cls", "cx", "cy", "w", "h"]
    rows = boxes.select(F.concat(folder, F.col("image"), F.lit(".txt")).alias("file"), "image", *order[:1], line.alias("value"), *([] if order == ["line"] else order[1:]))
    rows = rows.repartition("file").sortWithinPartitions("file", *order).select("file", "image", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        made, name, image, lines = set(), None, None, []

        def whole() -> pa.RecordBatch:
            target = f"{root}/{name}"
            if (parent := target.rsplit("/", 1)[0]) not in made:
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            with fs.open_output_stream(target, compression=None) as out:
                out.write(("\n".join(lines) + "\n").encode())
            return pa.record_batch([pa.array([image]), pa.array([len(lines)], pa.int64())], names=["image", "n"])

        for b in batches:
            for file, of, value in zip(*(b.column(c).to_pylist() for c in ("file", "image", "value"))):
                if file != name:
                    if lines:
                        yield whole()
                    name, image, lines = file, of, []
                lines.append(value)
        if lines:
            yield whole()

    out = rows.mapInArrow(run, "image string, n long")
    out.write.mode("overwrite").parquet(f"{path.rstrip('/')}.written")
    return out.sparkSession.read.schema(out.schema).parquet(f"{path.rstrip('/')}.written")


def purge(spark: SparkSession, path: str) -> None:
    """Delete a folder with what an earlier run left in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_text(path: str, text: str) -> None:
    """A small file, written whole by the driver."""
    fs, at = file_system(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(text.encode())


def write_descriptor(path: str, root: str, names: list[str], splits: dict[str, str], meta: dict | None = None) -> None:
    """A dataset descriptor in YAML: where each split lies (from root), class names by id, and how the set was made."""
    import yaml

    about = {"path": root, **splits, "nc": len(names), "names": dict(enumerate(names))} | ({"meta": meta} if meta else {})
    write_text(path, yaml.safe_dump(about, sort_keys=False, allow_unicode=True))


def provenance(entries: DataFrame, **about) -> dict:
    """What a descriptor says of a training set (is_synth of its entries): about and the counts."""
    n = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.count_if("is_synth"), F.lit(0)).alias("s")).first()
    return about | {"n_train": n["n"], "n_real_train": n["n"] - n["s"], "n_synthetic": n["s"]}


def write_json(rows: DataFrame, path: str, key: str | None = None) -> None:
    """A report as one JSON file: a list of objects, or with key one object of them. Reports are aggregates of a few rows."""
    found = [r.asDict(recursive=True) for r in rows.limit(MOST_REPORT + 1).collect()]
    if len(found) > MOST_REPORT:
        raise ValueError(f"a report of more than {MOST_REPORT} rows: write_jsonl takes tables of any size")
    write_text(path, json.dumps({str(r.pop(key)): r for r in found} if key else found, indent=2, default=str))


def write_scale_prior(quantiles: DataFrame, path: str) -> None:
    """class ('all' for the whole), n, share, median and arrays of quantiles as one JSON file, in the form that read_scale_prior takes."""
    rows = {r["class"]: r.asDict(recursive=True) for r in quantiles.collect()}  # a row for each class
    for r in rows.values():
        r.pop("class")
    whole = rows.pop("all", None)
    write_text(path, json.dumps({"classes": rows, "all": whole}, indent=1))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A folder of files with one JSON object a line, nulls left out."""
    rows.write.mode("overwrite").json(path)


def write_regions(regions: DataFrame, path: str) -> None:
    """A folder with a JSON object of regions (image, mode, polys) a line, in the form that read_regions takes."""
    one = F.create_map("image", F.struct("mode", "polys"))
    regions.select(F.to_json(F.struct(one.alias("regions"))).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def write_manifest(rows: DataFrame, path: str) -> None:
    """One image per line, in order of pos; lists of names fit one file."""
    rows.orderBy("pos").select(F.col("image").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_split(frames: DataFrame, path: str, **about) -> None:
    """path/fields: one JSON object with the split and season of each field; path/frames: Parquet with the split of each frame."""
    maps = frames.groupBy("field", "split", "year").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.collect_set(F.struct("field", "split"))).alias("plot_to_split"), F.map_from_entries(F.collect_set(F.struct("field", "year"))).alias("field_year"), F.sum("n").alias("n_images")
    )
    fields = [F.lit(v).alias(k) for k, v in about.items()]
    maps.select(F.to_json(F.struct(*fields, "*")).alias("value")).write.mode("overwrite").text(f"{path}/fields")
    frames.select("frame", "split").write.mode("overwrite").parquet(f"{path}/frames")


def write_detections(rows: DataFrame, path: str) -> None:
    """Parquet by run and split, so that a run's or split's scan reads only its folders; runs written again replace theirs."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "split").parquet(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """CSV files of a run beside those of others; runs can write at the same time."""
    rows.write.mode("append").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def swap_in(df: DataFrame, path: str) -> int:
    """Write beside path and put it in its place once it is whole; an empty result is an error and changes nothing."""
    spark = df.sparkSession
    staged = path.rstrip("/") + ".staged"
    df.write.mode("overwrite").parquet(staged)
    n = spark.read.schema(df.schema).parquet(staged).count()
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not n:
        fs.delete(new, True)
        raise ValueError(f"nothing to put at {path}")
    aside = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".before")
    fs.delete(aside, True)
    there = fs.exists(old)
    if there and not fs.rename(old, aside):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(new, old):
        if there:
            fs.rename(aside, old)
        raise OSError(f"can't move {staged} to {path}")
    fs.delete(aside, True)
    return n


def merge_pools(pools: dict[str, DataFrame | None]) -> tuple[DataFrame, list[str]]:
    """Rows of all pools with the pool's name as provenance, columns that a pool lacks null; and the names of pools that are missing or empty."""
    missing = [name for name, df in pools.items() if df is None or not df.limit(1).count()]
    parts = [df.withColumn("provenance", F.lit(name)) for name, df in pools.items() if name not in missing]
    if not parts:
        raise ValueError(f"nothing in {', '.join(pools)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), missing


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed job still has to do."""
    return todo.join(done, keys, "left_anti")
