"""The queries that SQL can express give DuckDB's rows; the others run over the whole tables."""

import pandas as pd
import pytest

from prismframe.llm import queries as Q

KEYS = {"op1_chat_formatting": ["conv_id"], "op2_decontamination": ["doc_id", "item_id"], "op3_mixing": ["doc_id", "epoch"], "op10_embedding_dedup": ["vec_id"]}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, duck, sf, name):
    got, want = Q.queries()[name](spark, sf).toPandas(), duck.execute(Q.oracle_sql()[name]).df()
    got, want = (x[sorted(x.columns)].sort_values(KEYS.get(name, ["doc_id"])).reset_index(drop=True) for x in (got, want))
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        a, b = ([None if pd.isna(v) else v for v in x[c].tolist()] for x in (got, want))
        assert a == b, c


def test_all_ten_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op3_mixing"])
def test_mixing_of_uneven_sources(spark, tmp_path, name):
    """A source with most rows and two that must be repeated: the SQL bisects the exponent too."""
    import duckdb

    rows = [(i, "w " * (1 + i % 50) + "end", "en", "big" if i < 900 else "mid" if i < 960 else "small", 1) for i in range(980)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = Q.queries()[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(Q.oracle_sql()[name]).df()
    got, want = (x[sorted(x.columns)].sort_values(["doc_id", "epoch"]).reset_index(drop=True) for x in (got, want))
    assert got.epoch.max() == 4 and (got.values == want.values).all()
