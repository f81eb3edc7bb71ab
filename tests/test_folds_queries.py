"""Queries on whole texts and arrays against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from loquent.operators import machines as M
from loquent.operators import sequences as Q
from loquent.plans import catalog


@pytest.fixture(scope="module")
def turns(spark, sf_dir):
    return {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}


def result(spark, sf_dir, name, column):
    return {(r.conv_id, r.turn): r[column] for r in catalog.queries()[name](spark, sf_dir).collect()}


def table(a, b):
    """The longest common substring by the table of all pairs of places."""
    best, at, row = 0, 0, [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        fresh = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                fresh[j] = row[j - 1] + 1
                if fresh[j] > best:
                    best, at = fresh[j], i
        row = fresh
    return a[at - best : at]


def test_common_substring_equals_the_whole_table():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(40))) for _ in "ab")
        assert Q.common_substring(a, b) == table(a, b)


def test_common_substring_takes_whole_texts(spark, sf_dir, turns):
    got = result(spark, sf_dir, "t23_common_substring", "common")
    last = {}
    for conv, turn in sorted(turns):
        before = last.get(conv)
        assert got[conv, turn] == (None if before is None else table(turns[conv, turn], before))
        last[conv] = turns[conv, turn]
    assert got.keys() == turns.keys()


def test_trim_tail_takes_whole_turns(spark, sf_dir, turns):
    got = result(spark, sf_dir, "w10_trim_tail", "words")
    assert {k: list(v) for k, v in got.items()} == {k: Q.trim_tail(t.split(" ")) for k, t in turns.items()}
    assert any(len(v) > 26 for v in got.values())


def test_merge_marks_takes_whole_turns(spark, sf_dir, turns):
    got = result(spark, sf_dir, "w18_merge_marks", "words")
    for k, text in turns.items():
        words = [x for w in text.split(" ") for x in (" " + w.rstrip("."), "." if w.endswith(".") else " x")]
        assert list(got[k]) == Q.merge_marks(words), k


def test_time_warp_takes_whole_vectors(spark, sf_dir):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = {r.vec_id: r.path for r in catalog.queries()["n9_time_warp"](spark, sf_dir).collect()}
    for k, e in rows.items():
        e = np.asarray(e, float)
        assert [tuple(p) for p in got[k]] == [tuple(p) for p in Q.warp(np.abs(e[:, None] - e[None, 2:])).tolist()], k


def agreed(turns, sure=None, mark=lambda pos: 0.5):
    """The rows of the agreement machine over four hypotheses of each whole conversation."""
    streams, out = defaultdict(list), []
    for conv, turn in sorted(turns):
        for word in turns[conv, turn].split(" "):
            seq = len(streams[conv])
            start = seq * 300 + turn * 1500
            streams[conv].append((seq, start / 1000, (start + 250) / 1000, word))
    for conv, words in streams.items():
        machine = M.Agreement(sure)
        for hyp in range(1, 5):
            seen = [w for w in words if w[0] * 4 < len(words) * hyp]
            for seq, start, end, word in seen:
                wrong = hyp < 4 and (seq + 1) * 4 >= len(words) * hyp
                out += [(conv, *r) for r in machine.push((hyp, seq, start, end, word + "~" * wrong, mark(seq)))]
        out += [(conv, *r) for r in machine.close()]
    return sorted(out)


def test_agreement_takes_all_turns(spark, sf_dir, turns):
    assert max(turn for _, turn in turns) > 1
    rows = {name: sorted(tuple(r) for r in catalog.queries()[name](spark, sf_dir).collect()) for name in ("s1_local_agreement", "s1_confident_agreement", "s5_end_of_stream")}
    want = agreed(turns)
    assert rows["s1_local_agreement"] == want
    assert rows["s5_end_of_stream"] == [r for r in want if not r[-1]]
    assert rows["s1_confident_agreement"] == agreed(turns, 0.95, lambda pos: 0.99 if pos % 3 == 0 else 0.5)
    words = {(conv, pos) for conv, turn in turns for pos in range(sum(len(turns[c, t].split(" ")) for c, t in turns if c == conv))}
    assert {(r[0], r[2]) for r in want} == words
