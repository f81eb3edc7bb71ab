"""Every registered query on the small tables: equal to its SQL where there is some, else with rows.

Queries without SQL are compared with plain Python in test_plain_queries and test_folds_queries.
"""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from loquent.plans import catalog

#: Queries without SQL: machine, text and alignment work that test_plain_queries and test_folds_queries hold against plain Python.
ELSEWHERE = {
    "n9_time_warp", "s1_confident_agreement", "s1_local_agreement", "s27_silence_policies", "s3_buffer_trimming", "s5_end_of_stream", "t19_cue_layout", "t1_diacritics", "t23_common_substring", "t2_symbols",
    "t3_basic_normalizer", "t4_graphemes", "t5_english_contractions", "t6_number_words", "t7_english_normalizer", "t9_compression_ratio", "w18_merge_marks", "w7_lines_without_speakers", "w7_speaker_lines",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, pd.Timestamp):
        return str(v).removesuffix(" 00:00:00")
    return f"{float(v):.9g}" if isinstance(v, (float, np.floating)) else str(v)


def rows(table: pd.DataFrame) -> list:
    return sorted(str(tuple(plain(v) for v in r)) for r in table[sorted(table.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert name in ELSEWHERE and len(got) and len(got.columns)


def test_entry_without_the_training_operators(spark, sf_dir, monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("loquent.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("loquent.llm", "loquent.llm.queries", "loquent.llm.oracles", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)
    left = importlib.reload(__spark_entry__)
    assert "pipeline" not in left.queries() and not any(n.startswith("op1") for n in left.queries())
    assert left.entry(spark).columns
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
