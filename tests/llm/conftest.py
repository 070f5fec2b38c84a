import pytest

SF = "/root/testdata/sf0.001"

#: Rows every operator must bear: nulls, empty and blank texts, repeated ids and rows, marks, long lines.
ODD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \t\n ", "en", "a", 4),
    (None, "no id at all here", "en", "a", 17),
    (4, "same text twice " * 40, "en", "a", 1),
    (5, "same text twice " * 40, "en", "a", 1),
    (5, "same text twice " * 40, "en", "a", 1),
    (5, "another text under the same id " * 20, "en", "b", 1),
    (6, "x" * 5000 + " " + "1" * 3000, "en", "a", 8001),
    (7, "MIT License and the Apache  License, cc-by; GNU General\nPublic License", "en", "a", 1),
    (8, "mail a.b@c.example.org or 10.0.0.1, 4111 1111 1111 1111, +1 (319) 555-5132 ok", "en", "a", 1),
    (9, "ünïcödé 😀 <|endoftext|> " + " ".join("ab") + "\n\n\nline\nline\nline", "de", "a", 1),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with the odd rows as documents (with columns whose names clash with results), and small side tables."""
    path = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 as score", "'x' as spans", "0L as start", "'y' as class_id")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 0, None), (7, 1, 1), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "same text twice " * 8), (2, None), (3, ""), (4, "too short")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a/", None), (2, None, ""), (None, "http://b/", "<p>x"), (3, "http://a/", "<p>" * 300), (3, "http://a/", "<p>y")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


def texts(spark, path):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
