"""Readers of annotation files. All are DataFrame scans; malformed records are dropped or counted, as said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import label_path, plot_key, season, stem, uid

VOC = "folder string, filename string, size struct<width:string,height:string>, object array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"
NO_FOLDER, IMAGE_SUFFIX = "UNKNOWN", ".JPG"
# Folder names that say nothing about a plot; suffixes of photos.
PLAIN_FOLDERS = ("images", "annotations", "jpegimages")
PHOTOS = ("jpg", "jpeg", "png")
CORNERS = ("xmin", "ymin", "xmax", "ymax")


def number(text: Column) -> Column:
    """A number written in any way, null for what isn't one."""
    return F.trim(text).try_cast("double")


def parse_voc(files: DataFrame, source: str, upper_names: bool = False, folder_depth: int = 0) -> DataFrame:
    """Frames from files (path, value: the whole XML): uid, source, plot, plot_key, year, filename, width, height, objects.

    A missing folder is 'UNKNOWN', a missing file name the stem with '.JPG', a missing size or corner 0; objects
    without a name or box are left out. Text that isn't XML gives no row. With folder_depth, a
    folder that is missing or says nothing is that many folders of the path above the file.
    """
    doc = F.from_xml(F.col("value"), VOC, {"rowTag": "annotation", "mode": "PERMISSIVE"})
    rows = files.filter(F.trim("value").startswith("<")).withColumn("d", doc).filter("d is not null")

    def told(c: str) -> Column:
        text = F.trim(F.col(f"d.{c}"))
        return F.when(text != "", text)

    name = F.coalesce(told("filename"), F.concat(stem(F.col("path")), F.lit(IMAGE_SUFFIX)))
    plot = told("folder")
    if folder_depth:
        parts = F.split("path", "/")
        above = F.array_join(F.slice(parts, F.greatest(F.size(parts) - folder_depth, F.lit(1)), folder_depth), "/")
        plot = F.when(plot.isNull() | F.lower(plot).isin(*PLAIN_FOLDERS), above).otherwise(plot)
    plot = F.coalesce(plot, F.lit(NO_FOLDER))
    whole = F.coalesce(F.col("d.object"), F.array().cast("array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>"))
    kept = F.filter(whole, lambda o: o["name"].isNotNull() & (F.trim(o["name"]) != "") & o["bndbox"].isNotNull())

    def label(o: Column) -> Column:
        return F.upper(F.trim(o["name"])) if upper_names else F.trim(o["name"])

    objects = F.transform(kept, lambda o: F.struct(label(o).alias("name"), *(F.coalesce(number(o["bndbox"][c]), F.lit(0.0)).alias(c) for c in CORNERS)))
    size = [F.coalesce(number(F.col(f"d.size.{c}")).cast("int"), F.lit(0)).alias(c) for c in ("width", "height")]
    return rows.select(uid(F.lit(source), name).alias("uid"), F.lit(source).alias("source"), plot.alias("plot"), plot_key(F.lit(source), plot).alias("plot_key"), season(F.lit(source)).alias("year"), name.alias("filename"), *size, objects.alias("objects"))


def xml_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and value (the whole text) of the XML files under a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def read_voc(spark: SparkSession, folder: str, source: str, upper_names: bool = False, folder_depth: int = 0) -> DataFrame:
    """Frames from a folder of XML files."""
    return parse_voc(xml_files(spark, folder), source, upper_names, folder_depth)


def xml_folders(files: DataFrame, most: int = 40) -> DataFrame:
    """folder and n of the folders with the most XML files (path), of equal ones the first by name."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.filter(F.lower("path").endswith(".xml")).groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder").limit(most)


def photo_boxes(photos: DataFrame, files: DataFrame) -> DataFrame:
    """photos (uid, xml: path of the annotation or null) with boxes: whole pixels of all objects, or null where there is no annotation.

    A photo without an annotation can't be told to be free of objects, so its boxes are null, not empty.
    Objects with a corner that is missing or no number are left out.
    """
    doc = F.from_xml(F.col("value"), VOC, {"rowTag": "annotation", "mode": "PERMISSIVE"})
    found = files.select(F.col("path").alias("xml"), F.coalesce(doc["object"], F.array().cast("array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>")).alias("o"))
    box = F.transform("o", lambda o: F.struct(*(number(o["bndbox"][c]).cast("int").alias(n) for c, n in zip(CORNERS, ("x1", "y1", "x2", "y2")))))
    whole = F.filter(box, lambda b: b["x1"].isNotNull() & b["y1"].isNotNull() & b["x2"].isNotNull() & b["y2"].isNotNull())
    return photos.join(found.select("xml", whole.alias("boxes")), "xml", "left").select(*photos.columns, "boxes")


def boxes(frames: DataFrame, known: list[str], excluded: tuple[str, ...]) -> DataFrame:
    """One row per object: uid, cls (place in known), name, box cut to the frame, reason (null if it counts)."""
    rows = frames.select("uid", "width", "height", F.explode("objects").alias("o")).select("uid", "width", "height", "o.*")
    sized = F.col("width") > 0

    def cut(c: str, limit: str) -> Column:
        return F.when(sized, F.greatest(F.lit(0.0), F.least(F.col(c), F.col(limit)))).otherwise(F.col(c))

    place = F.array_position(F.array(*[F.lit(k) for k in known]), F.col("name")) - 1
    rows = rows.select("uid", "name", place.cast("int").alias("cls"), "width", "height", *(cut(c, w).alias(n) for c, w, n in (("xmin", "width", "x1"), ("ymin", "height", "y1"), ("xmax", "width", "x2"), ("ymax", "height", "y2"))))
    reason = (
        F.when(F.col("name").isin(*excluded), F.concat(F.lit("excluded:"), "name")).when(F.col("cls") < 0, F.concat(F.lit("unknown:"), "name")).when(F.col("width") <= 0, "no_size").when((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "degenerate_box")
    )
    return rows.withColumn("reason", reason)


def read_yolo(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """image (stem), line (in its file, from 0), cls, cx, cy, w, h from label files; strict takes lines of exactly five numbers, else five or more."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    rows = files.select(stem(F.col("_metadata.file_path")).alias("image"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    rows = rows.select("image", "line", F.split(F.trim("value"), r"\s+").alias("t"))
    rows = rows.filter(F.size("t") == 5 if strict else F.size("t") >= 5)
    numbers = [F.expr(f"try_cast(t[{i}] as double)").alias(c) for i, c in enumerate(("cls", "cx", "cy", "w", "h"))]
    return rows.select("image", "line", *numbers).dropna().withColumn("cls", F.col("cls").cast("int"))


def list_images(spark: SparkSession, folder: str, suffixes: str = "{jpg,jpeg,png,JPG,JPEG,PNG}") -> DataFrame:
    """path, stem and length of image files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffixes}").load(folder)
    return files.select("path", stem(F.col("path")).alias("stem"), "length")


def find_images(annotations: DataFrame, images: DataFrame, order: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """annotations (uid, filename) with path: the image of that stem, an equal case and an earlier suffix preferred; null if none."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    a = annotations.select("uid", stem(F.col("filename")).alias("_s"))
    found = a.join(images.select("path", F.col("stem").alias("_t")), F.lower("_s") == F.lower("_t"))
    rank = F.struct((F.col("_s") != F.col("_t")).alias("c"), F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), suffix), F.lit(99)).alias("o"), F.col("path").alias("path"))
    best = found.groupBy("uid").agg(F.min(rank).alias("m")).select("uid", F.col("m.path").alias("path"))
    return annotations.join(best, "uid", "left")


def read_regions(spark: SparkSession, path: str, one_line: bool = False) -> DataFrame:
    """image, mode, polys from a JSON object of images, by itself or under 'regions'; with one_line, from an object on each line."""
    one = "struct<mode:string,polys:array<array<array<double>>>>"
    raw = spark.read.text(path, wholetext=not one_line)
    found = F.coalesce(F.from_json("value", f"regions map<string,{one}>")["regions"], F.from_json("value", f"map<string,{one}>"))
    return raw.select(F.explode(found).alias("image", "r")).select("image", F.coalesce("r.mode", F.lit("all")).alias("mode"), "r.polys")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """pos and image of a list of images; repeats stay."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("image"))


def source_photos(tiles: DataFrame, annotated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos that tiles (image) were cut from, and those of them that annotated (uid) lacks."""
    photos = tiles.select(F.regexp_replace(stem(F.col("image")), r"_t\d+$", "").alias("uid")).distinct()
    return photos, photos.join(annotated, "uid", "left_anti")


def photos_of(images: DataFrame, files: DataFrame, datasets: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """dataset, uid, path and xml (null if none) of the photos <dataset>/Images/<stem>.<suffix> of datasets; with allowed (stem), only those.

    images and files (XML) have path; the annotation lies at <dataset>/Annotations/<stem>.xml.
    """
    parts = F.split("path", "/")
    rows = images.select("path", F.element_at(parts, -2).alias("_in"), F.element_at(parts, -3).alias("dataset"), stem(F.col("path")).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("_suffix"))
    rows = rows.filter((F.col("_in") == "Images") & F.col("dataset").isin(datasets) & F.col("_suffix").isin(*PHOTOS)).drop("_in", "_suffix")
    if allowed is not None:
        rows = rows.join(allowed.select("stem").distinct(), "stem", "left_semi")
    notes = files.filter(F.col("path").rlike("/Annotations/[^/]*[.]xml$")).select(F.col("path").alias("xml"), F.element_at(F.split("path", "/"), -3).alias("dataset"), stem(F.col("path")).alias("stem"))
    return rows.join(notes, ["dataset", "stem"], "left").select("dataset", F.concat_ws("__", "dataset", "stem").alias("uid"), "path", "xml")


def dataset_images(spark: SparkSession, descriptor: str, split: str) -> DataFrame:
    """image (absolute) of a split, as its dataset descriptor (YAML) tells: the lines of a list, or the files of a folder."""
    import yaml

    text = spark.read.text(descriptor, wholetext=True).first()[0]
    root, entry = descriptor.rsplit("/", 1)[0], (yaml.safe_load(text) or {}).get(split)
    if entry is None:
        raise ValueError(f"{descriptor} has no '{split}' entry")

    def whole(p: str) -> str:
        return p if p.startswith("/") or "://" in p else f"{root}/{p}"

    if entry.endswith(".txt"):
        line = F.col("image")
        return read_manifest(spark, whole(entry)).select("pos", F.when(line.startswith("/") | F.contains(line, F.lit("://")), line).otherwise(F.concat(F.lit(f"{root}/"), line)).alias("image"))
    files = spark.read.format("binaryFile").load(whole(entry))
    return files.select(F.col("path").alias("image"))


def labelled(images: DataFrame, labels: DataFrame, key: str = "image") -> DataFrame:
    """Images (a path) whose label file is among labels (path)."""
    there = labels.select(F.col("path").alias("_label"))
    return images.withColumn("_label", label_path(F.col(key))).join(there, "_label", "left_semi").select(*images.columns)


def completed(sidecars: DataFrame) -> DataFrame:
    """uid and instances of sidecars (path, value: the whole JSON) that are intact; cut-off ones aren't done."""
    one = "id int, class string, gt_box array<double>, mask_box array<int>, iou double, area bigint"
    found = F.from_json("value", f"instances array<struct<{one}>>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = sidecars.select(stem(F.col("path")).alias("uid"), found.alias("d")).filter("d is not null and d._bad is null")
    return rows.select("uid", F.coalesce("d.instances", F.array().cast(f"array<struct<{one.replace(' ', ':').replace(',:', ',')}>>")).alias("instances"))
