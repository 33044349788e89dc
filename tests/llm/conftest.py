import pytest

SF001 = "/root/testdata/sf0.001"
CLASHING = ("score", "held_out", "predicted", "lang_pred", "fp", "fingerprint", "component_id", "root", "node", "length",
            "start", "offset", "ids", "tier", "kept", "distance", "cell", "bin", "words", "x0", "m0", "host", "path", "rule",
            "verdict", "rank", "position", "chunk", "entry", "exit", "q", "key", "tile", "shard", "job", "model", "n_chars")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text, lang, source) rows, with columns that clash."""
    from pyspark.sql import functions as F

    def make(rows, clashing=True):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING]) if clashing else df

    return make


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF001}/{name}.parquet")
