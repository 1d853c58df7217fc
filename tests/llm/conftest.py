import random
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("the driver's tables aren't here")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns whose names operators use."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["the", "apple", "der", "haus", "una", "casa", "x1"]) for _ in range(60_000))
    rows = [
        (1, "hello world of words", "en", "a", 20), (2, None, "en", "a", None), (None, "text without an id at all here", None, None, 3), (4, "", "de", None, 0),
        (5, "hello world of words", "en", "b", 20), (5, "hello world of words", "en", "b", 20), (5, "another text of the same id", "en", "b", 1),
        (7, long, "en", "a", len(long)), (8, long + " tail", "en", "a", 5), (9, "\n\n \n", None, "b", 4), (10, "9 8 7 +-", "de", "b", 8), (11, "one\r\ntwo\tthree \x00 é ß 漢字", "de", "", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("d", "t", "c", "x", "h", "pos", "score", "labels", "spans", "epoch", "run", "n_lines", "__text", "v", "lang_pred"):
        df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
