import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture
def documents(spark):
    """Makes a documents table from texts or (doc_id, text) pairs, with columns that clash."""

    def make(rows, **more):
        rows = [(i, r) if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        rows = [(i, t, "en" if i is None or i % 3 else None, f"s{(i or 0) % 2}", len(t) if t else 0) for i, t in rows]
        df = spark.createDataFrame(rows, DOCS)
        for name, value in more.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return make
