import pytest

#: Edge cases that every operator meets: nulls, empty and long texts, repeated rows, names that operators use themselves.
LONG = "The quick brown fox jumps over the lazy dog again. " * 30_000
ROWS = [
    (1, "one two three four five six seven\n\none two three four five six seven", "en", "a", 0, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, "x"),
    (3, "", "en", "a", 0, "x"),
    (None, " \n\t ", None, "b", 0, None),
    (5, "Größe und Straße, überall.\nNoch eine Zeile hier unten.", "de", "b", 0, "y"),
    (6, LONG, "en", "b", 0, "z"),
    (7, "one two three four five six seven\n\none two three four five six seven", "en", "c", 0, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string"
#: Further columns, whose names operators might use.
CLASHES = ["node", "bucket", "shard", "size", "block", "salt", "k1", "t", "id", "score", "tokens", "key"]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
