import duckdb
import pytest

#: Columns that the operators use for themselves, as extra columns of the input.
CLASH = "1 AS id, 'x' AS fp, 2 AS key, 3 AS tag, 'y' AS score, 4 AS n_words, 'z' AS spans, 5 AS shard, 6 AS size, " \
        "'w' AS sketch, 7 AS label, 8 AS range, 9 AS __others, 'v' AS kept_text, 10 AS contaminated"
LONG = ("the thinor erntha rely enhaer thestion of from to to. " * 900
        + "Released under the MIT License. idiot moron " + "".join(f"wd{i} " for i in range(4000)))
PASSAGE = " ".join(f"passage{i}" for i in range(30))
TEXTS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two"), (5, LONG), (6, "a" * 5000), (7, "a" * 5000),
    (8, f"Start {PASSAGE} end."), (9, f"Other {PASSAGE} tail."), (10, f"Start {PASSAGE} end."),
    (11, f"Other {PASSAGE} tail."), (11, f"Other {PASSAGE} tail."), (11, "another text of the same id"),
    (None, "text without id, gnu general public license"), (None, "text without id, gnu general public license"),
    (12, "Licensed under CC BY-NC 4.0. APACHE LICENSE, Version 2.0; cc by"), (13, "日本語 テキスト é ñ 😀 don't we'll"),
    (14, "x" * 99), (15, "x" * 100 + "y"), (16, "z" + "x" * 101), (17, "ab" * 300), (18, "ab" * 200 + "c"),
    (19, "the 'Kelvin' K license, İ mit İ license"), (20, "!!! ??? ---"),
]


def real_texts(n=120):
    return duckdb.sql("SELECT doc_id + 100, text FROM '/root/testdata/sf0.001/documents.parquet' "
                      f"ORDER BY doc_id LIMIT {n}").fetchall()


def as_docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", *CLASH.split(", "))


@pytest.fixture(scope="session")
def messy_rows():
    return TEXTS + real_texts()


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return as_docs(spark, messy_rows).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return as_docs(spark, [])
