"""Rounding of every event, ties included, against Python's round."""

from __future__ import annotations

from loquent.plans import catalog


def test_two_places_of_all_events(spark, sf_dir):
    got = {r.event_id: r.r for r in catalog.queries()["n19_round_half_even_two_places"](spark, sf_dir).collect()}
    ids = [r.event_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").collect()]
    assert got == {i: round(i * 7 / 8, 2) for i in ids}
    assert {i % 4 for i in ids} == {0, 1, 2, 3} and got[1] == 0.88 and got[3] == 2.62
