"""Array and format functions on values that the small tables do not have."""

from __future__ import annotations

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loquent.functions import arrays as N
from loquent.functions import timefmt as E
from loquent.plans import catalog


def test_zscores_of_long_vectors_take_linear_time(spark):
    """Mean and deviation once a vector: by element, a vector of 5,000 would take 10^11 steps."""
    x = [math.sin(k) for k in range(5000)]
    got, p = spark.createDataFrame([(x,)], "x array<double>").select(N.zscores(F.col("x")), N.softmax(F.col("x"))).first()
    assert np.allclose(got, (np.array(x) - np.mean(x)) / np.std(x)) and np.allclose(p, np.exp(x) / np.exp(x).sum())


def test_zscores_of_nulls_and_equal_values(spark):
    rows = spark.createDataFrame([([1.0, None, 3.0],), ([2.0, 2.0],), ([],), (None,)], "x array<double>").select(N.zscores(F.col("x")).alias("z")).collect()
    assert rows[0].z == [-1.0, None, 1.0] and all(map(math.isnan, rows[1].z)) and rows[2].z == [] and rows[3].z is None


def test_formats_of_ids_above_a_million_equal_their_sql(spark, tmp_path):
    """Ids from 2^20 on, which the larger tables have, by the SQL of n16_formats and of n16_file_sizes."""
    ids = [0, 1, 1023, 1024, 1536, 2**20 - 1, 2**20, 2**20 + 5120, 6_000_000, 36_000_000, 2**31]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("n16_formats", "n16_file_sizes"):
        got = catalog.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.execute(catalog.oracle_sql()[name]).fetchall()), name


def test_file_sizes_of_all_units(spark):
    sizes = {0: "0 Bytes", 1536: "1.5 KB", 2**20: "1 MB", 5 * 2**30 // 2: "2.5 GB", 2**40: "1 TB", 2**50: "1024 TB"}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", E.file_size(F.col("n")).alias("size")).collect()
    assert {r.n: r["size"] for r in rows} == sizes
