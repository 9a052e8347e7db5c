import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from quadrat.llm.queries import vocabulary


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns, name
        if name in ("toxicity", "exact_dedup", "near_dedup"):
            assert 0 < docs.count() <= seen
            seen = docs.count()
    assert docs.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, _at string, _text string, _copies int, rank int"


def test_stages_with_nulls_clashing_columns_and_nothing(spark, tmp_path):
    long = " ".join(f"w{i * i % 997}" for i in range(5000))
    rows = [(None, None, None, None, None, "x", None, 1, 1), (1, "", "en", "a", 0, None, "y", None, None), (2, long, None, None, None, "x", "y", 1, 1), (2, long, None, None, None, "x", "y", 1, 1), (3, long + " end", "de", "b", 1, "x", "y", 1, 1)]
    for n, some in (("odd", rows), ("none", [])):
        sf = tmp_path / n
        spark.createDataFrame(some, ODD).write.parquet(str(sf / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality long, toxic long").write.parquet(str(sf / "labels.parquet"))
        docs = spark.read.parquet(str(sf / "documents.parquet"))
        for k, (name, stage) in enumerate(cp.STAGES):
            stage(spark, docs, str(sf)).write.parquet(str(sf / str(k)))
            docs = spark.read.parquet(str(sf / str(k)))
            if k < len(cp.STAGES) - 1:
                assert docs.columns == [c.split()[0] for c in ODD.split(", ")], name
        if n == "none":
            assert docs.count() == 0


def test_python_workers_keep_nothing_for_other_operators():
    from quadrat.llm import packing, toxicity
    from quadrat.llm.common import kept, lean

    docs = pa.record_batch([pa.array([1]), pa.array(["one two"])], names=["doc_id", "text"])
    first = lean(packing._first_round(vocabulary(), 1024, 2, 3), "packing")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "_ids", lambda round_: 0)
        assert sum(b.num_rows for b in first(iter([docs]))) == 1 and kept("packing")
        assert sum(b.num_rows for b in first(iter([docs]))) == 1 and kept("packing")
    assert sum(b.num_rows for b in lean(toxicity._features)(iter([docs]))) == 1 and not kept("packing")


def test_toxicity_takes_texts_once_and_gives_small_batches(spark):
    from quadrat.llm import toxicity

    docs = spark.range(2500).selectExpr("id as doc_id", "cast(id as string) as text", "'x' as more")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    node = toxicity.drop_toxic(docs, labels)._jdf.queryExecution().analyzed()
    assert [node.children().apply(0).output().apply(k).name() for k in range(node.children().apply(0).output().size())] == docs.columns
    model = toxicity.fit(docs, labels)
    batch = pa.record_batch([pa.array(range(2500)), pa.array(["a"] * 2500)], names=["doc_id", "text"])
    out = list(toxicity._clean(type("shared", (), {"value": model}), 1, 2)(iter([batch])))
    assert [b.num_rows for b in out] == [1000, 1000, 500] and pa.Table.from_batches(out).equals(pa.Table.from_batches([batch]))


def test_filter_tables_agree_with_one_product():
    from quadrat.llm import toxicity

    model = toxicity.Model.fresh()
    for table, f in zip(model.tables(), model.filters):
        assert np.array_equal(table, np.einsum("vd,wdf->wvf", model.embedding, f).astype(np.float32))
