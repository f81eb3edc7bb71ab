from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Texts that every operator of documents has a defined result for.
EDGES = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "one"), (-5, "one"), (-6, "1234 !!! 5678"), (-7, "word " * 30_000), (-8, "naïve café 東京 " * 40), (-9, "a" * 5000), (None, "a row without id")]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows, one of them twice, with columns whose names operators also use."""
    df = spark.createDataFrame([*EDGES, EDGES[4]], "doc_id long, text string")
    clash = ("node", "keys", "score", "value", "kind", "entities", "leaks", "row", "low")
    return df.select("*", F.lit("en").alias("lang"), F.lit("edge").alias("source"), F.lit(1).alias("n_chars"), *(F.lit("x").alias(c) for c in clash)).cache()


@pytest.fixture(scope="session")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def edged(spark, sf_dir, tmp_path_factory):
    """The small tables with the edge rows (those with an id) among the documents."""
    import os

    out = tmp_path_factory.mktemp("edged")
    for name in os.listdir(sf_dir):
        if name != "documents.parquet":
            os.symlink(f"{sf_dir}/{name}", out / name)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in EDGES if i is not None], docs.schema)
    docs.unionByName(extra).write.parquet(str(out / "documents.parquet"))
    return str(out)
