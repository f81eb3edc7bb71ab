"""Folds over words that lie in order already: the same rows as plain Python gives, without a sort of words."""

from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import pytest

from loquent.operators import machines as M
from loquent.plans import catalog
from loquent.plans.intervals_queries import TOKENS, tokens
from loquent.plans.registry import Tables

FOLDS = "t19_cue_layout w3_fill_silence s27_silence_policies w7_lines_without_speakers w7_speaker_lines w6_silences s1_confident_agreement s1_local_agreement s5_end_of_stream s3_buffer_trimming w5_blank_to_silence w7_lines w9_monotonic w16_sentences w19_truncate_words".split()


@pytest.mark.parametrize("name", FOLDS)
def test_only_turns_are_sorted(spark, sf_dir, name):
    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    planned = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    sorts = re.findall(r"Sort \[(.*?)\]", plan + planned)
    assert sorts and all(set(re.findall(r"(\w+)#", s)) <= {"stream_id", "hyp_id", "turn"} for s in sorts)
    assert "collect_list(struct" not in plan


@pytest.fixture(scope="module")
def spoken(spark, sf_dir):
    """turn, start, end and text of each conversation's words."""
    out = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        for word in r.text.split(" "):
            start = len(out[r.conv_id]) * 300 + r.turn * 1500
            out[r.conv_id].append((r.turn, start / 1000, (start + 250) / 1000, word))
    return out


def test_silence_policies_from_words(spark, sf_dir, spoken):
    want = []
    for policy in ("pad", "offset", "flush"):
        for conv, words in spoken.items():
            machine, out = M.Agreement(None, policy), []
            for hyp in range(1, 5):
                later = 0 if policy == "pad" else (hyp - 1) * 6
                seen = [(k, *w) for k, w in enumerate(words) if k * 4 < len(words) * hyp]
                for k, _, start, end, text in seen:
                    out += machine.push((hyp, k, start + later, end + later, text + "~" * (hyp < 4 and k == seen[-1][0]), 0.5))
                out += machine.push((hyp, 1 << 40, seen[-1][3] + later, seen[-1][3] + 6 + later, None, None))
            want += [(conv, *r, policy) for r in out + machine.close()]
    assert sorted(map(tuple, catalog.queries()["s27_silence_policies"](spark, sf_dir).collect())) == sorted(want)


def test_trimming_from_words(spark, sf_dir, spoken):
    want = []
    for conv, words in spoken.items():
        machine = M.Trim(15.0, "sentence")
        for k, (turn, _, end, text) in enumerate(words):
            want += [(conv, *r) for r in machine.push((turn, "token", end, text))]
            if k + 1 == len(words) or words[k + 1][0] != turn:
                want += [(conv, *r) for r in machine.push((turn, "upto", end + 0.5, ""))]
    assert sorted(map(tuple, catalog.queries()["s3_buffer_trimming"](spark, sf_dir).collect())) == sorted(want)


def test_words_of_turns_that_occur_twice(spark, tmp_path):
    """Numbers go by turn and place, as in the SQL; empty and null texts, and a null stream, as well."""
    rows = [(1, 1, "u", "a b c"), (1, 1, "u", "a b"), (1, 0, "u", ""), (1, 2, "u", None), (1, 3, "u", "x  y "), (None, 0, "u", "n o"), (2, 5, "u", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(f"WITH {TOKENS} SELECT stream_id, seq, turn, text, start_ms, end_ms, speaker FROM timed").fetchall()
    got = tokens(Tables(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    filled = catalog.queries()["w3_fill_silence"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, filled), key=str) == sorted(con.execute(catalog.oracle_sql()["w3_fill_silence"]).fetchall(), key=str)
