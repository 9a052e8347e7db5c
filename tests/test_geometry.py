import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.functions import names, polygons


def lit_box(*v):
    return tuple(F.lit(float(x)) for x in v)


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


@pytest.mark.parametrize(("a", "b", "iou"), [((0, 0, 2, 2), (2, 0, 4, 2), 0), ((0, 0, 2, 2), (0, 0, 2, 2), 1), ((0, 0, 2, 2), (1, 0, 3, 2), 1 / 3), ((0, 0, 0, 0), (0, 0, 1, 1), 0)])
def test_iou(spark, a, b, iou):
    assert value(spark, g.iou(lit_box(*a), lit_box(*b))) == pytest.approx(iou)


def test_other_overlaps(spark):
    a, b = lit_box(0, 0, 4, 4), lit_box(2, 0, 4, 2)
    assert value(spark, g.ioa(a, b)) == 1
    assert value(spark, g.overlap_of_smaller(a, b)) == 1
    assert value(spark, g.match_score(a, b, "max")) == 1


def test_clamp_and_yolo_round_trip(spark):
    c = g.clamp(lit_box(-5, 2, 30, 40), F.lit(20), F.lit(30))
    assert value(spark, F.array(*c)) == [0, 2, 20, 30]
    y = g.to_yolo(lit_box(2, 4, 8, 10), F.lit(100), F.lit(50))
    assert value(spark, g.yolo_line(F.lit(3), y)) == "3 0.050000 0.140000 0.060000 0.120000"
    back = g.from_yolo(y["cx"], y["cy"], y["w"], y["h"], F.lit(100), F.lit(50))
    assert value(spark, F.array(*back)) == pytest.approx([2, 4, 8, 10])


@pytest.mark.parametrize(("length", "origins"), [(3703, [0, 1024, 2048, 2167]), (1000, [0]), (1536, [0]), (2560, [0, 1024]), (2561, [0, 1024, 1025])])
def test_tile_origins(spark, length, origins):
    assert value(spark, g.tile_origins(F.lit(length), 1536, 1024)) == origins


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 9000))
def test_tiles_cover_a_side(spark, length):
    o = value(spark, g.tile_origins(F.lit(length), 1536, 1024))
    covered = set()
    for x in o:
        covered |= set(range(x, min(x + 1536, length)))
    assert covered == set(range(length))


def test_polygons(spark):
    concave = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    assert value(spark, polygons.contains(concave, F.lit(2.0), F.lit(0.5)))
    assert not value(spark, polygons.contains(concave, F.lit(2.0), F.lit(3.0)))
    assert value(spark, polygons.shoelace(concave)) == pytest.approx(10)
    clipped = polygons.clip(concave, F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(1.0))
    assert value(spark, polygons.shoelace(clipped)) == pytest.approx(4)
    assert value(spark, F.size(polygons.clip(concave, F.lit(10.0), F.lit(10.0), F.lit(12.0), F.lit(12.0)))) == 0
    whole = polygons.clip(concave, F.lit(-1.0), F.lit(-1.0), F.lit(9.0), F.lit(9.0))
    assert value(spark, polygons.shoelace(whole)) == pytest.approx(10)


def test_regions(spark):
    polys = F.array(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]))
    for mode, x, inside in (("all", 9.0, True), ("none", 1.0, False), ("poly", 1.0, True), ("poly", 3.0, False)):
        assert value(spark, polygons.in_region(F.lit(mode), polys, F.lit(x), F.lit(1.0))) is inside


def test_run_names(spark):
    rows = {r[0]: r for r in spark.createDataFrame([(x,) for x in ("realonly_yolo11_real_x50_seed2", "hybrid_yolo26_sd35cut_v2_r125_seed0", "matched_rtdetrv2_v8_r75_x30_seed1", "annotred_T_v2_yolo11_seed2", "other")], "n string").select("n", names.parse_run(F.col("n")).alias("r")).collect()}
    assert tuple(rows["realonly_yolo11_real_x50_seed2"].r) == ("real", "yolo11", None, None, 50, 2)
    assert tuple(rows["hybrid_yolo26_sd35cut_v2_r125_seed0"].r) == ("hybrid", "yolo26", "sd35cut_v2", 125, None, 0)
    assert tuple(rows["matched_rtdetrv2_v8_r75_x30_seed1"].r) == ("matched", "rtdetrv2", "v8", 75, 30, 1)
    assert tuple(rows["annotred_T_v2_yolo11_seed2"].r) == ("arm", "yolo11", "T_v2", None, None, 2)
    assert rows["other"].r is None


def test_small_functions(spark):
    assert value(spark, names.recipe(F.lit(0.02))) == "AdamW_lr0.00111" and value(spark, names.recipe(F.lit(None).cast("double"))) == "unknown"
    assert value(spark, names.f1(F.lit(0.0), F.lit(0.0))) == 0
    assert value(spark, names.label_path(F.lit("/d/images/train/images/a.b.JPG"))) == "/d/images/train/labels/a.b.txt"
    assert value(spark, names.source_photo(F.lit("P__IMG_1_t12"))) == "P__IMG_1"
