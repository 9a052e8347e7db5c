import json

import pytest
from pyspark.sql import functions as F

from quadrat.sources import annotations as an
from quadrat.sources import experiments as ex
from quadrat.sources import sinks
from quadrat.streaming.metrics import running_means

XML = """<annotation><folder>{folder}</folder><filename>{file}</filename><size><width>100</width><height>80</height></size>
<object><name>SETVE</name><bndbox><xmin>10</xmin><ymin>5</ymin><xmax>120</xmax><ymax>20</ymax></bndbox></object>
<object><name>NR</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>2</xmax><ymax>2</ymax></bndbox></object>
<object><name>SOLNI</name></object>
<object><name>CYPRO</name><bndbox><xmin>5</xmin><ymin>5</ymin><xmax>5</xmax><ymax>9</ymax></bndbox></object></annotation>"""


def test_voc(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.format(folder="P1", file="IMG_1.JPG"))
    (tmp_path / "b.xml").write_text("<annotation><filename> </filename><object><name>SETVE</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>3</xmax><ymax>3</ymax></bndbox></object></annotation>")
    f = {r.uid: r for r in an.read_voc(spark, str(tmp_path), "TOMATO_1").collect()}
    assert f["TOMATO_1__IMG_1"].plot_key == "TOMATO_1/P1" and f["TOMATO_1__IMG_1"].year == 2021 and len(f["TOMATO_1__IMG_1"].objects) == 3
    assert f["TOMATO_1__b"].plot == "UNKNOWN" and f["TOMATO_1__b"].filename == "b.JPG" and f["TOMATO_1__b"].width == 0
    from quadrat.functions.names import CLASSES, EXCLUDED

    rows = an.boxes(an.read_voc(spark, str(tmp_path), "TOMATO_1"), list(CLASSES), EXCLUDED).collect()
    assert {(r.uid, r.name): r.reason for r in rows} == {("TOMATO_1__IMG_1", "SETVE"): None, ("TOMATO_1__IMG_1", "NR"): "excluded:NR", ("TOMATO_1__IMG_1", "CYPRO"): "degenerate_box", ("TOMATO_1__b", "SETVE"): "no_size"}
    assert next(r for r in rows if r.name == "SETVE" and r.reason is None).x2 == 100


def test_yolo_and_images(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "p_t3.txt").write_text("1 0.5 0.5 0.1 0.2\n2 0.1 0.1 0.1\n3 0.1 0.2 0.3 0.4 0.9\n\n")
    assert an.read_yolo(spark, str(tmp_path)).count() == 1 and an.read_yolo(spark, str(tmp_path), strict=False).count() == 2
    for n in ("A.png", "a.JPG", "b.jpeg"):
        (tmp_path / n).write_bytes(b"x")
    images = an.list_images(spark, str(tmp_path))
    a = spark.createDataFrame([("u", "a.JPG"), ("v", "B.JPG"), ("w", "c.JPG")], "uid string, filename string")
    found = {r.uid: r.path and r.path.rsplit("/", 1)[1] for r in an.find_images(a, images).collect()}
    assert found == {"u": "a.JPG", "v": "b.jpeg", "w": None}
    tiles = spark.createDataFrame([("/x/p_t3.png",), ("/x/p_t4.png",), ("/x/q_t1.png",)], "image string")
    there = spark.createDataFrame([("/x/images/labels/a.txt",), ("/y/labels/train/b.txt",)], "path string")
    pictures = spark.createDataFrame([("/x/images/images/a.png",), ("/y/images/train/b.jpg",), ("/y/images/train/c.jpg",)], "image string")
    assert sorted(r.image for r in an.labelled(pictures, there).collect()) == ["/x/images/images/a.png", "/y/images/train/b.jpg"]
    photos, missing = an.source_photos(tiles, spark.createDataFrame([("p",)], "uid string"))
    assert photos.count() == 2 and [r.uid for r in missing.collect()] == ["q"]


def test_metrics(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for k in range(2):
        (tmp_path / "m" / f"r{k}.csv").write_text(f"run_name,split,precision,recall,f1,map50,map50_95\nrealonly_yolo11_seed{k},test,0.5,0.5,0.5,{'nan' if k else 0.5},0.3\n")
    rows = ex.read_metrics(spark, str(tmp_path / "m"))
    (tmp_path / "m" / "odd.csv").write_text("run_name,split,precision,recall,f1,map50,map50_95\nx_seed0,val,NaN, nan ,NAN,,0.25\n\n")
    assert rows.count() == 2 and rows.filter("map50 is null").count() == 1
    odd = ex.read_metrics(spark, str(tmp_path / "m")).filter("split = 'val'").collect()
    assert [(r.precision, r.recall, r.f1, r.map50, r.map50_95) for r in odd] == [(None, None, None, None, 0.25)]
    (tmp_path / "m" / "odd.csv").unlink()
    assert ex.families(rows).first().seeds == 2
    q = running_means(ex.stream_metrics(spark, str(tmp_path / "m"))).writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select n, mean from means").first().asDict() == {"n": 1, "mean": 0.5}
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "results.csv").write_text("epoch,  lr/pg0 ,x\n1, 0.01,1\n2,0.02,1\n")
    log = ex.read_train_log(spark, str(tmp_path / "runs"))
    assert [(r.run, r.epoch, r.lr) for r in log.orderBy("epoch").collect()] == [("r1", 1, 0.01), ("r1", 2, 0.02)]


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nb: 3\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.yaml").write_text("extends: ../base.yaml\na: {y: 5}\n")
    assert ex.load_config(tmp_path / "sub" / "e.yaml") == {"a": {"x": 1, "y": 5}, "b": 3}
    (tmp_path / "c.yaml").write_text("extends: sub/e.yaml\na: 7\nc: {z: [1]}\n")
    assert ex.load_config(tmp_path / "c.yaml") == {"a": 7, "b": 3, "c": {"z": [1]}}
    (tmp_path / "base.yaml").write_text("extends: c.yaml\n")
    with pytest.raises(ValueError, match="extends itself"):
        ex.load_config(tmp_path / "c.yaml")


def test_sinks(spark, tmp_path):
    (tmp_path / "regions.json").write_text(json.dumps({"i": {"mode": "poly", "polys": [[[0, 0], [1, 0], [1, 1]]]}, "j": {"mode": "none"}}))
    r = {x.image: x for x in an.read_regions(spark, str(tmp_path / "regions.json")).collect()}
    assert r["i"].polys == [[[0, 0], [1, 0], [1, 1]]] and r["j"].polys is None
    b = spark.createDataFrame([("i", 1, 0.5, 0.5, 0.1, 0.1, 2, 9.0, "val"), ("i", 0, 0.25, 0.5, 0.1, 0.1, 0, 9.0, "val"), ("j.k", 3, 0.5, 0.5, 0.1, 0.1, 0, 9.0, "train"), ("z", 3, 0.5, 0.5, 0.1, 0.1, 0, 1.0, "train")], "image string, cls int, cx double, cy double, w double, h double, line int, area double, split string")
    assert {(r.image, r.n) for r in sinks.write_yolo(b, str(tmp_path / "y"), 2.0, "split").collect()} == {("i", 2), ("j.k", 1)}
    assert (tmp_path / "y" / "val" / "i.txt").read_text() == "0 0.250000 0.500000 0.100000 0.100000\n1 0.500000 0.500000 0.100000 0.100000\n"
    assert {(r.image, r.line, r.cls, r.cx) for r in an.read_yolo(spark, str(tmp_path / "y")).collect()} == {("i", 0, 0, 0.25), ("i", 1, 1, 0.5), ("j.k", 0, 3, 0.5)}
    sinks.purge(spark, str(tmp_path / "y"))
    assert not (tmp_path / "y").exists()
    target = f"file://{tmp_path}/pool"
    assert sinks.swap_in(spark.range(3), target) == 3
    with pytest.raises(ValueError, match="nothing"):
        sinks.swap_in(spark.range(0), target)
    assert spark.read.parquet(target).count() == 3
    assert sinks.pending(spark.range(5), spark.range(3), ["id"]).count() == 2
    m, missing = sinks.merge_pools({"a": spark.range(2), "b": spark.range(1).withColumn("x", F.lit(1)), "c": None, "d": spark.range(0)})
    assert m.filter("provenance = 'a' and x is null").count() == 2 and missing == ["c", "d"]
    with pytest.raises(ValueError, match="nothing in"):
        sinks.merge_pools({"c": None})
    sinks.write_detections(spark.createDataFrame([("r", "test", 1)], "run string, split string, n int"), str(tmp_path / "d"))
    assert (tmp_path / "d" / "run=r" / "split=test").exists()
    rows = spark.createDataFrame([("p", 1)], "image string, pos int")
    sinks.write_manifest(rows.unionByName(rows), str(tmp_path / "man"))
    assert an.read_manifest(spark, str(tmp_path / "man")).count() == 2
    frames = spark.createDataFrame([(1, "a", "train", 2021), (2, "a", "train", 2021), (3, "b", "test", 2022)], "frame long, field string, split string, year int")
    sinks.write_split(frames, str(tmp_path / "split"), protocol="holdout")
    text = spark.read.text(str(tmp_path / "split" / "fields")).first()[0]
    assert json.loads(text) == {"protocol": "holdout", "plot_to_split": {"a": "train", "b": "test"}, "field_year": {"a": 2021, "b": 2022}, "n_images": 3}
    assert spark.read.parquet(str(tmp_path / "split" / "frames")).count() == 3


def test_reports_and_descriptors(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, [0.5])], "k string, n int, q array<double>")
    sinks.write_json(rows, str(tmp_path / "r" / "one.json"), key="k")
    assert json.loads((tmp_path / "r" / "one.json").read_text()) == {"a": {"n": 1, "q": None}, "b": {"n": 2, "q": [0.5]}}
    sinks.write_jsonl(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    (tmp_path / "set" / "images" / "val").mkdir(parents=True)
    for n in ("x.png", "y.jpg"):
        (tmp_path / "set" / "images" / "val" / n).write_bytes(b"x")
    (tmp_path / "set" / "train.txt").write_text("a.png\n\n/b.png\na.png\n")
    sinks.write_descriptor(str(tmp_path / "set" / "dataset.yaml"), str(tmp_path / "set"), ["p", "q"], {"train": "train.txt", "val": "images/val"}, {"seed": 1})
    one = str(tmp_path / "set" / "dataset.yaml")
    assert sorted(r.image for r in an.dataset_images(spark, one, "train").collect()) == sorted([f"{tmp_path}/set/a.png"] * 2 + ["/b.png"])
    assert an.dataset_images(spark, one, "val").count() == 2
    with pytest.raises(ValueError, match="no 'test' entry"):
        an.dataset_images(spark, one, "test")
    (tmp_path / "split.json").write_text(json.dumps({"plot_to_split": {"f": "val"}, "field_year": {"f": 2022}, "uid_to_split": {"u": "val", "v": "train"}}))
    frames, fields = ex.read_split(spark, str(tmp_path / "split.json"))
    assert {tuple(r) for r in frames.collect()} == {("u", "val"), ("v", "train")} and [tuple(r) for r in fields.collect()] == [("f", "val", 2022)]
    for n, text in (("a", {"real": {"fol_s": {"n": 3, "p10": 1, "p50": 2.5, "p90": 4}}, "pool": 1}), ("b", {"fol_s": {"n": 3, "p10": 1, "p50": 2.5, "p90": 4}})):
        (tmp_path / f"{n}.json").write_text(json.dumps(text, indent=2))
        assert [(r.stat, r.p50) for r in ex.read_appearance_prior(spark, str(tmp_path / f"{n}.json")).collect()] == [("fol_s", 2.5)]
    (tmp_path / "nested.json").write_text(json.dumps({"regions": {"i": {"mode": "all"}}, "meta": {"tool": "t"}}, indent=2))
    assert [(r.image, r["mode"]) for r in an.read_regions(spark, str(tmp_path / "nested.json")).collect()] == [("i", "all")]


def test_sidecars_that_are_cut_off_are_not_done(spark):
    whole = json.dumps({"width": 3, "instances": [{"id": 1, "class": "SETVE", "gt_box": [0, 0, 1, 1], "mask_box": [0, 0, 1, 1], "iou": 0.5, "area": 4}]})
    cars = spark.createDataFrame([("/m/a.json", whole), ("/m/b.json", whole[:-9]), ("/m/c.json", ""), ("/m/d.json", "{}")], "path string, value string")
    done = {r.uid: len(r.instances) for r in an.completed(cars).collect()}
    assert done == {"a": 1, "d": 0}
    todo = spark.createDataFrame([(x,) for x in "abcde"], "uid string")
    assert sorted(r.uid for r in sinks.pending(todo, an.completed(cars), ["uid"]).collect()) == ["b", "c", "e"]


def test_odd_annotations(spark):
    files = [("/x/TOMATO_1/p9/Annotations/q.xml", "<annotation>\n<folder>Images</folder><size><width>12.0</width></size><object><name>setve</name><bndbox><xmin>1.9</xmin><ymax>4</ymax></bndbox></object></annotation>"), ("/x/bad.xml", "no xml"), ("/x/e.xml", "<annotation></annotation>")]
    table = spark.createDataFrame(files, "path string, value string")
    got = {r.uid: r for r in an.parse_voc(table, "TOMATO_1", True, 2).collect()}
    q = got["TOMATO_1__q"]
    assert set(got) == {"TOMATO_1__q", "TOMATO_1__e"} and q.plot == "p9/Annotations" and (q.width, q.height) == (12, 0)
    assert [tuple(o) for o in q.objects] == [("SETVE", 1.9, 0.0, 0.0, 4.0)]
    photos = spark.createDataFrame([("q", files[0][0]), ("n", None), ("e", "/x/e.xml")], "uid string, xml string")
    boxes = {r.uid: r.boxes for r in an.photo_boxes(photos, table).collect()}
    assert boxes == {"q": [], "n": None, "e": []}


def test_tiled_label_files(spark, tmp_path):
    from quadrat.functions.geometry import box, to_yolo
    from quadrat.operators import splits as sp

    frames = spark.createDataFrame([(1, 100, 60)], "frame long, width long, height long")
    boxes = spark.createDataFrame([(1, 2, 10, 10, 30, 20), (1, 4, 62, 30, 98, 50)], "frame long, cls int, x1 long, y1 long, x2 long, y2 long")
    cut = sp.tile_boxes(frames, boxes, 60, 40, 0.4).withColumn("image", F.format_string("u%d_t%d", "frame", "ti"))
    rows = cut.withColumn("y", to_yolo(box(), F.lit(60), F.lit(60))).select("image", "cls", "y.*", F.lit("train").alias("split"))
    sinks.write_yolo(rows, str(tmp_path / "labels"), split="split")
    assert sorted(x.name for x in (tmp_path / "labels" / "train").iterdir()) == ["u1_t0.txt", "u1_t1.txt"]
    assert (tmp_path / "labels" / "train" / "u1_t0.txt").read_text().startswith("2 0.333333 0.250000")
