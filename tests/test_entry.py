import duckdb
import pandas as pd
import pytest

import __spark_entry__ as e
from quadrat.plans import datasets, detection, experiments, ingest

CORE = {k: v for p in (ingest, detection, experiments, datasets) for k, v in p.QUERIES.items()}
SF = "/root/testdata/sf0.001"
SOME = ["class_split_counts", "tile_boxes", "region_to_tiles", "greedy_match_50", "error_taxonomy", "ap50_by_class_size", "sweep_readout", "recipe_disagreement", "hybrid_assembly", "scale_prior_quantiles", "hamming_pairs"]


def test_registry():
    q, sql = e.queries(), e.oracle_sql()
    assert set(CORE) <= set(q) and set(sql) <= set(q)


def test_entry(spark):
    assert e.entry(spark).count() == 5


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("~" if pd.isna(v) else f"{float(v):.6g}" if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "events", "documents", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows_of(CORE[name](spark, SF).toPandas()) == rows_of(con.execute(e.oracle_sql()[name]).df())
