import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = ["score", "predicted", "component_id", "fp", "id", "tag", "row", "key", "shard", "bin", "domain", "tokens", "h", "y"]


@pytest.fixture(scope="session")
def plain_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def docs(spark, plain_docs):
    """The documents with rows that break naive code, and columns with names that operators use."""
    line = "the same seven words stand in here"
    long = " ".join(f"w{i % 977} x{i}" for i in range(40_000))
    odd = [
        (None, None, None, None), (None, "no id, but a text of some words", "en", None), (None, "no id either", "en", "src1"),
        (10**9, "", "en", "src0"), (10**9 + 1, None, "de", "src0"), (10**9 + 2, " \n\t\n ", None, "src0"),
        (10**9 + 3, long, "en", "src0"), (10**9 + 4, long + " tail", "en", "src2"),
        (10**9 + 5, f"{line}\n{line}\n\n{line} again", "fr", "src3"), (10**9 + 5, f"{line}\n{line}\n\n{line} again", "fr", "src3"),
        (10**9 + 6, "one id", "en", "src4"), (10**9 + 6, "with two different texts in its rows", "en", "src5"),
        (10**9 + 7, "é" * 500 + "  ñ ß", "es", "src6"), (10**9 + 8, "A b\x0bC\x0cd\x1cE\xa0f", "es", "src6"),
    ]
    extra = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string")
    extra = extra.withColumn("n_chars", F.length("text").cast("long")).select(*plain_docs.columns)
    out = plain_docs.unionByName(extra)
    return out.withColumns({name: F.lit("clash") for name in CLASHING}).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    odd = [(None, 1, 1), (10**9, None, None), (10**9 + 3, 1, 0), (10**9 + 3, 0, 0), (77_777_777, 1, 1)]
    return known.unionByName(spark.createDataFrame(odd, "doc_id long, quality int, toxic int"))
