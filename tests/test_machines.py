"""State machines and sequence helpers on small cases with known results."""

from __future__ import annotations

import numpy as np
import pytest

from loquent.operators import machines as M
from loquent.operators import sequences as Q


def fed(machine, rows):
    return [out for row in rows for out in machine.push(row)] + machine.close()


def hyp(k, *words, p=0.5):
    return [(k, i, float(i), float(i + 1), w, p) for i, w in enumerate(words)]


def test_agreement_commits_what_two_hypotheses_share():
    out = fed(M.Agreement(), hyp(1, "a", "b", "x") + hyp(2, "a", "b", "c") + hyp(3, "a", "b", "c", "d"))
    assert [(r[4], r[6]) for r in out] == [("a", True), ("b", True), ("c", True), ("d", False)]


@pytest.mark.parametrize("p, committed", [(0.95, []), (0.96, ["a"])])
def test_agreement_takes_sure_tokens_above_the_limit(p, committed):
    out = fed(M.Agreement(0.95), hyp(1, "a", p=p))
    assert [r[4] for r in out if r[6]] == committed


def test_voice_activity_pads_both_ends():
    rows = [(512 * k, 0.9 if 4 <= k < 8 else 0.1) for k in range(40)]
    assert fed(M.VoiceActivity(quiet=2048), rows) == [("start", 2048 - 1600), ("end", 4096 + 1600)]


def test_breaker_opens_and_closes():
    rows = [(0.0, False), (1.0, False), (2.0, True), (12.0, True), (13.0, True)]
    assert [x[1:] for x in fed(M.Breaker(failures=2, rest=10), rows)] == [("closed", True), ("closed", True), ("open", False), ("half_open", True), ("closed", True)]


def test_denied_restarts_do_not_count():
    assert [ok for _, ok in fed(M.Restarts(2, 10), [(0,), (1,), (2,), (10,), (10.5,)])] == [True, True, False, True, False]


def test_blanks_of_exactly_the_limit_are_silence():
    assert fed(M.Blanks(4.0), [(0, 0.0, 2.0, "[BLANK_AUDIO]"), (1, 2.0, 4.0, "[BLANK_AUDIO]"), (2, 4.0, 5.0, "hi")]) == [(0, 0.0, 4.0, "", -2), (2, 4.0, 5.0, "hi", -1)]


def test_sequences():
    assert Q.trim_tail(list("xyababab")) == list("xyab")
    assert Q.common_substring("abcdef", "zcdez") == "cde"
    assert Q.warp(np.abs(np.subtract.outer([1.0, 2, 3], [1.0, 2, 2, 3]))).tolist() == [[0, 0], [1, 1], [1, 2], [2, 3]]


def test_folds_of_null_and_large_keys(spark):
    """Rows of the null stream share one machine, and ids beyond 2**53 stay apart."""
    from loquent.operators import folds as D

    big = 2**53
    rows = [(None, 0, 0.0, 1.0), (None, 1, 0.5, 2.0), (big, 0, 0.0, 3.0), (big, 1, 1.0, 4.0), (big + 1, 0, 0.2, 0.4)]
    got = D.monotonic(spark.createDataFrame(rows, "stream_id long, seq long, start double, end double")).collect()
    assert sorted(((r.stream_id, r.seq, r.start) for r in got), key=str) == sorted([(None, 0, 0.0), (None, 1, 1.01), (big, 0, 0.0), (big, 1, 3.01), (big + 1, 0, 0.2)], key=str)
