"""Streams over several micro-batches, stopped and started again, against plain Python and batch results."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loquent.operators import folds as D
from loquent.operators import machines as M
from loquent.plans import catalog
from loquent.plans import flows_queries as P
from loquent.plans.registry import Tables
from loquent.streaming import flows as W
from loquent.streaming import streams as S

BEGIN = datetime.datetime(2024, 1, 1)


def at(seconds):
    return BEGIN + datetime.timedelta(seconds=seconds)


@pytest.fixture
def put(spark, tmp_path):
    """Appends rows to the folder of a stream, in one file."""

    def write(rows, schema, name="in"):
        folder = W.landing(spark, f"{tmp_path}/{name}")
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return folder

    return write


def test_order_does_not_depend_on_batches(spark, put, tmp_path):
    """Rows up to 30 seconds late, in five micro-batches, give what the fold over the sorted table gives."""
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 2, None, 2**53 + 1]), at(i * 4), float(i * 4), rng.random() < 0.4) for i in range(200)]
    arriving = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=rng.uniform(0, 30)))
    schema = "id long, service long, ts timestamp, at double, ok boolean"
    machine = lambda: M.Breaker(failures=3, rest=40.0)
    out = "at double, state string, passed boolean"
    folder = put(arriving[:0], schema)
    stream = S.read_table(spark, folder, spark.createDataFrame([], schema).schema)
    for k in range(0, 200, 40):
        put(arriving[k : k + 40], schema)
        S.run_all(W.in_order(stream, "service", ["id"], ["at", "ok"], machine, out, "30 seconds"), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    W.end(spark, folder, stream.schema)
    S.run_all(W.in_order(stream, "service", ["id"], ["at", "ok"], machine, out, "30 seconds"), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    want = D.fold(spark.createDataFrame(rows, schema), "service", ["at", "id"], ["at", "ok"], machine, out)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_keys_that_share_a_group_keep_their_own_state(spark, put, tmp_path):
    """Many keys in two groups of state, over two micro-batches, each with its own machine."""
    rows = [(i, i % 50, at(i * 4), float(i * 4), i % 3 == 0) for i in range(200)]
    schema = "id long, service long, ts timestamp, at double, ok boolean"
    machine = lambda: M.Breaker(failures=2, rest=40.0)
    out = "at double, state string, passed boolean"
    folder = put(rows[:100], schema)
    stream = S.read_table(spark, folder, spark.createDataFrame([], schema).schema)
    run = lambda: S.run_all(W.in_order(stream, "service", ["id"], ["at", "ok"], machine, out, "30 seconds", buckets=2), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    run()
    put(rows[100:], schema)
    W.end(spark, folder, stream.schema)
    run()
    want = D.fold(spark.createDataFrame(rows, schema), "service", ["at", "id"], ["at", "ok"], machine, out)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


def test_rows_behind_the_watermark_drop(spark, put, tmp_path):
    schema = "id long, user_id long, ts timestamp"
    stream = S.read_table(spark, put([(1, 1, at(0)), (2, 1, at(500))], schema), spark.createDataFrame([], schema).schema)
    run = lambda: S.run_all(W.in_order(stream, "user_id", ["id"], ["ts_ms"], lambda: M.Idle(200_000, timed=True), "last_ms long, noticed_ms long", "10 seconds", patience=200), f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    run()
    put([(3, 1, at(100))], schema)  # would have filled the silence, but comes after it was told
    run()
    W.end(spark, f"{tmp_path}/in", stream.schema)
    run()
    last = [(r.last_ms - int(BEGIN.timestamp() * 1000)) // 1000 for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(last) == [0, 500]


def test_timers_equal_the_fold(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = P.timed(t).withColumn("ts_ms", F.unix_millis("ts"))
    want = D.fold(rows, "user_id", ["ts_ms", "event_id"], ["ts_ms"], lambda: M.Idle(P._PATIENCE * 1000), "last_ms long, noticed_ms long").collect()
    got = catalog.queries()["s19_idle_watchdog"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_resets_follow_from_their_rule(spark, sf_dir):
    """A buffer ends at the first event that is neither output nor within half a day of its begin or of output since."""
    users = defaultdict(list)
    for r in P.resets(Tables(spark, sf_dir)).orderBy("ts", "event_id").collect():
        users[r.user_id].append((r.at, r.output))
    want = []
    for user, events in users.items():
        begin = 0
        while begin < len(events):
            said = [k for k in range(begin + (begin > 0), len(events)) if events[k][1]]
            late = lambda k: events[k][0] - events[begin][0] > 43_200 and all(j > k or events[k][0] - events[j][0] > 43_200 for j in said)  # noqa: E731, B023
            ends = [k for k in range(begin + 1, len(events)) if not events[k][1] and late(k)]
            if not ends:
                break
            want.append((user, events[ends[0]][0], events[begin][0]))
            begin = ends[0]
    got = catalog.queries()["s4_no_output_resets"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_correlation_drops_late_rows_and_empties_its_state(spark, put, tmp_path):
    schema = "id long, ts timestamp"
    asked, answers = put([(i, at(i * 10)) for i in range(20)], schema, "asked"), put([(i, at(i * 10 + i)) for i in range(0, 20, 2)], schema, "answers")
    kind = spark.createDataFrame([], schema).schema
    joined = W.correlate(S.read_table(spark, asked, kind), S.read_table(spark, answers, kind), "id", "12 seconds", "30 seconds")

    def run():
        query = joined.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        query.awaitTermination()
        return [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]

    first = run()
    put([(1, at(11))], schema, "answers")  # request 1 is told as unanswered by then
    put([(99, at(2))], schema, "asked")  # far behind the watermark
    assert sum(o["numRowsDroppedByWatermark"] for o in run()) == 2
    for name in ("asked", "answers"):
        W.end(spark, f"{tmp_path}/{name}", kind)
    last = run()
    # Of 30 rows those that can still meet stay; in the end none.
    assert [o["numRowsTotal"] for o in (*first, last[-1])] == [30, 7, 0]
    got = {r.id: r.answer_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: i if i % 2 == 0 and i <= 12 else None for i in range(20)}


def messages(*ids, kind="view", seconds=0):
    import json

    return [json.dumps({"event_id": str(i), "event_type": kind, "ts": int(at(i + seconds).timestamp() * 1_000_000), "payload": f"p{i}", "reply_to": "r" if i % 2 else None}) for i in ids]


def test_redelivered_messages_are_handled_once(spark, tmp_path):
    folder = W.landing(spark, f"{tmp_path}/queue")
    lines = S.read_lines(spark, folder)
    sink = W.acknowledge(lambda rows: rows.withColumn("response", F.upper("body")), f"{tmp_path}/read")
    deliveries = [messages(1, 2, 3) + messages(4, kind="other"), messages(2, 3, 4, 5, 400), messages(1, 5), messages(401) + messages(1)]
    for texts in deliveries:
        spark.createDataFrame([(x,) for x in texts], "value string").coalesce(1).write.mode("append").text(folder)
        S.run_all(W.consume(lines, ["view"], "60 seconds"), f"{tmp_path}/checkpoint", sink)
    ledger = spark.read.parquet(f"{tmp_path}/read/ledger").collect()
    assert sorted((r.id, r.state) for r in ledger) == [("1", "processed"), ("2", "processed"), ("3", "processed"), ("4", "failed"), ("400", "processed"), ("401", "processed"), ("5", "processed")]
    by = {r.id: r.batch for r in ledger}
    assert by["1"] == by["4"] < by["5"] == by["400"] < by["401"]
    replies = spark.read.parquet(f"{tmp_path}/read/replies").collect()
    assert sorted((r.id, r.response) for r in replies) == [("1", "P1"), ("3", "P3"), ("401", "P401"), ("5", "P5")]


def test_unreadable_lines(spark):
    lines = spark.createDataFrame([("{",), ("[1]",), ("",), (None,), ('{"event_id":"1","ts":5}',), ('{"event_id":null,"ts":5}',)], "value string")
    assert W.unreadable(lines).count() == 5


class Stopped(Exception):
    pass


def boxed(spark, folder, send=None, **more):
    return W.Outbox(spark, folder, "id", "queue", [F.col("id")], send or (lambda rows: rows.withColumn("ok", F.lit(True))), **more)


@pytest.mark.parametrize("phase", ["log", "tried", "sent", "kept", "dropped", "waiting"])
def test_outbox_goes_on_after_a_stop_in_any_phase(spark, put, tmp_path, monkeypatch, phase):
    """The stream is stopped right after it wrote one of its tables; the next run loses and repeats nothing."""
    schema = "id long, queue string"
    folder = put([(i, "q") for i in range(6)], schema)
    stream, sends = S.read_table(spark, folder, spark.createDataFrame([], schema).schema), []

    def send(rows):
        sends.append(sorted(r.id for r in rows.collect()))
        return rows.withColumn("ok", F.lit(True))

    box = boxed(spark, f"{tmp_path}/box", send, rate=2, keep=3, newest=[F.col("id").desc()])
    S.run_all(stream, f"{tmp_path}/checkpoint", box)
    put([(i, "q") for i in range(6, 9)], schema)
    write = W.Outbox._write

    def stop(self, rows, name, number):
        out = write(self, rows, name, number)
        if name == phase:
            raise Stopped
        return out

    monkeypatch.setattr(W.Outbox, "_write", stop)
    with pytest.raises(Exception):  # noqa: B017
        S.run_all(stream, f"{tmp_path}/checkpoint", box)
    monkeypatch.setattr(W.Outbox, "_write", write)
    S.run_all(stream, f"{tmp_path}/checkpoint", box)
    assert box.drain(2) == 4
    sent = {r.id: r.batch for r in box.rows("sent").collect()}
    assert sent == {0: 0, 1: 0, 3: 1, 4: 1, 6: 2, 7: 2, 8: 3} and box.rows("sent").count() == 7
    assert {r.id for r in box.rows("dropped").collect()} == {2, 5}
    assert [s for s in sends if s] == [[0, 1], [3, 4], [6, 7], [8]] or phase == "log"


def test_outbox_tries_again_and_keeps_what_failed(spark, tmp_path):
    need = spark.createDataFrame([(1, "q", 1), (2, "q", 2), (3, "q", 5), (4, "q", 99)], "id long, queue string, need int")
    box = boxed(spark, f"{tmp_path}/box", lambda rows: rows.withColumn("ok", F.col("attempts") >= F.col("need")), most=2)
    box(need, 0)
    assert sorted((r.id, r.attempts) for r in box.rows("sent").collect()) == [(1, 1), (2, 2)]
    box.drain(1)
    assert {r.id: (r.batch, r.attempts) for r in box.rows("sent").collect()} == {1: (0, 1), 2: (0, 2)}
    box(need.limit(0), 2)
    assert {r.id: (r.batch, r.attempts) for r in box.rows("sent").collect()}[3] == (2, 5)
    assert [(r.id, r.attempts) for r in spark.read.parquet(f"{tmp_path}/box/waiting/batch=2").collect()] == [(4, 6)]


def test_priorities_grow_with_age(spark, tmp_path):
    """An old message overtakes a new one of higher priority once it has waited for the difference."""
    box = W.Outbox(spark, f"{tmp_path}/box", "id", "queue", [F.col("arrived") - F.col("priority")], lambda rows: rows.withColumn("ok", F.lit(True)), rate=1)
    for number in range(5):
        rows = [(10 * number + p, "q", p) for p in ((0, 2) if not number else (2,))]
        box(spark.createDataFrame(rows, "id long, queue string, priority int"), number)
    order = [r.id for r in box.rows("sent").orderBy("batch").collect()]
    assert order == [2, 12, 0, 22, 32]


def test_fan_out_reads_once_and_repeats_itself(spark, put, tmp_path):
    schema = "id long, ts timestamp"
    stream = S.read_table(spark, put([(i, at(i)) for i in range(10)], schema), spark.createDataFrame([], schema).schema)
    broken = [True]

    def second(rows):
        if broken[0]:
            raise Stopped
        return rows.filter("id % 2 = 0").select("id")

    each = W.fan_out({"a": lambda rows: rows.select("id"), "b": second}, f"{tmp_path}/out")
    start = lambda: stream.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    with pytest.raises(Exception):  # noqa: B017
        start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/sink=a").count() == 10
    broken[0] = False
    query = start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("sink").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()
    assert sorted(map(tuple, got)) == [("a", 10, 10), ("b", 5, 5)]
    assert sum(p["numInputRows"] for p in query.recentProgress) == 10


def test_merging_leaves_other_parts_alone(spark, tmp_path):
    table = W.Merged(spark, f"{tmp_path}/table", "day", ["user", "day"])
    schema = "user string, n int, day string"
    batches = [[("a", 1, "x"), ("b", 1, "x"), (None, 1, "y")], [("a", 2, "x")], [(None, 3, "y"), ("c", 1, "z")], [("b", 5, "x")]]
    for number, rows in enumerate(batches):
        table(spark.createDataFrame(rows, schema), number)
        if number == 1:
            table(spark.createDataFrame(rows, schema), number)  # run again
            assert table.versions() == {"day=x": [0, 1], "day=y": [0]}
    assert table.versions() == {"day=x": [1, 3], "day=y": [2], "day=z": [2]}
    got = table.read(spark.createDataFrame([], schema).schema).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 2, "x"), ("b", 5, "x"), (None, 3, "y"), ("c", 1, "z")], key=str)
    assert table.read(spark.createDataFrame([], schema).schema, ["day=none"]).count() == 0


def test_counters_come_without_a_second_read(spark, put, tmp_path):
    schema = "id long, ok boolean"
    stream = S.read_table(spark, put([(i, i % 3 > 0) for i in range(9)], schema), spark.createDataFrame([], schema).schema)
    counters = W.Counters("mine")
    run = lambda df: S.run_all(df, f"{tmp_path}/checkpoint", f"{tmp_path}/out")
    counts = {"good": F.count_if("ok"), "bad": F.count_if(~F.col("ok"))}
    counters.run(spark, stream, counts, run)
    put([(10, False)], schema)
    told = counters.run(spark, stream, counts, run)
    assert [(h["batch"], h["input_rows"], h["good"], h["bad"]) for h in told] == [(0, 9, 6, 3), (1, 1, 0, 1)]
    assert counters.failed is None


def test_steps_of_equal_spans(spark):
    rows = spark.createDataFrame([(None,), (0,), (9,), (10,), (29,)], "us long")
    assert [r[0] for r in rows.select(W.steps(rows, F.col("us"), 3)).collect()] == [0, 0, 0, 1, 2]
    assert [r[0] for r in rows.select(W.steps(rows.limit(0), F.col("us"), 3)).distinct().collect()] == [0]
