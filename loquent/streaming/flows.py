"""Flows over several micro-batches and restarts: event-time order, timers, correlation, acknowledged consumption, an outbox
with priorities, fan-out, merged totals, and counters.

Sinks are foreachBatch functions whose results depend only on the batch, its number and what the batch before it left
behind, so a batch that is run again after a stop replaces itself. Streams end with a row of the time END: it moves the
watermark past everything, so state is emptied and timers fire.
"""

from __future__ import annotations

import datetime
import pickle
import threading
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

#: The time of the row that ends a stream.
END = datetime.datetime(9000, 1, 1)


def steps(rows: DataFrame, by: Column, many: int) -> Column:
    """Of each row the step, from 0, in which it arrives: equal spans of `by` (a time in microseconds, nulls first)."""
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None:
        return F.lit(0)
    step = F.floor((by - F.lit(low)) * many / F.lit(high - low + 1)).cast("int")
    return F.when(by.isNull(), 0).otherwise(F.least(step, F.lit(many - 1)))


def landing(spark: SparkSession, folder: str) -> str:
    """`folder`, made if need be: streams want it before the first rows come."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return folder


def arrive(rows: DataFrame, folder: str, step: Column, many: int) -> Iterator[int]:
    """Append the rows of each step to `folder`; between two steps the caller may run its stream."""
    for k in range(many):
        rows.filter(step == k).write.mode("append").parquet(folder)
        yield k


def end(spark: SparkSession, folder: str, schema: StructType, ts: str = "ts") -> None:
    """Append the row that ends a stream. Its other columns are zero or empty where their type has such a value: a null might
    be filtered away before the watermark sees the row, as joins ask for keys."""
    some = {"string": "", "boolean": False} | dict.fromkeys(("byte", "short", "integer", "long", "float", "double"), 0)
    values = [F.lit(END if f.name == ts else some.get(f.dataType.typeName())).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*values).coalesce(1).write.mode("append").parquet(folder)


def watermarked(rows: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    """`rows` with a watermark and without the row that ends the stream, which still moves it. Rows without a time drop."""
    return rows.withWatermark(ts, late).filter(F.col(ts) < F.lit(END))


# Order and timers


class _InOrder(StatefulProcessor):
    """Rows wait until the watermark has passed them and then go to their key's machine in order; silence is a timer's business.

    A group is a bucket of keys: what state costs by call is shared by all of them. Rows wait as they came, in Arrow blocks;
    machines are kept together. `columns` are the key, the time in milliseconds, and what is kept of a row.
    """

    def __init__(self, machine, columns, order, inputs, names, patience):
        self.make, self.columns, self.order, self.inputs, self.names, self.patience = machine, columns, [columns.index(c) for c in order], [columns.index(c) for c in inputs], names, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "rows binary")
        self.machines = handle.getListState("machines", "machines binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, blocks = None, []
        for part in rows:
            columns = [part[c].astype(object).where(part[c].notna(), None) for c in self.columns]
            # The key has a value even where it is null: whole numbers of a column with nulls would come as floating point.
            # Columns of PySpark's frames lose names that begin with an underscore.
            columns[0] = part["filled_key"].astype(object).where(~part["null_key"], None)
            block = list(zip(*columns, strict=True))
            blocks.append((pickle.dumps(block),))
            least = min(r[1] for r in block)
            first = least if first is None else min(first, least)
        if blocks:
            self.pending.appendList(blocks)
            self.handle.registerTimer(first)
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due: dict[object, list] = defaultdict(list)
        rest: list[tuple] = []
        for (block,) in self.pending.get() if self.pending.exists() else ():
            for row in pickle.loads(bytes(block)):
                if row[1] <= now:
                    due[row[0]].append(row)
                else:
                    rest.append(row)
        #: Of each key its machine and the time of its last row, none if its silence was told.
        known: dict[object, tuple] = {}
        for (block,) in self.machines.get() if self.machines.exists() else ():
            known.update(pickle.loads(bytes(block)))
        out: list[tuple] = []
        ended = now >= int(END.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) - 366 * 86_400_000
        for k in [*known, *(k for k in due if k not in known)]:
            own, last = known.get(k) or (self.make(), None)
            said: list[tuple] = []
            for row in sorted(due.get(k, ()), key=lambda r: tuple((r[p] is not None, r[p]) for p in self.order)):
                if self.patience is not None and last is not None and row[1] - last > self.patience:
                    said += own.quiet(last, last + self.patience)
                said += own.push(tuple(row[p] for p in self.inputs))
                last = row[1]
            if self.patience is not None and last is not None and now >= last + self.patience:
                said += own.quiet(last, last + self.patience)
                last = None
            if ended:
                said += own.close()
            known[k] = own, last
            out += [(k, *r) for r in said]
        if ended or not known:
            self.machines.clear()
        else:
            kept = list(known.items())
            self.machines.put([(pickle.dumps(kept[i : i + 1000]),) for i in range(0, len(kept), 1000)])
        if rest:
            self.pending.put([(pickle.dumps(rest[i : i + 10_000]),) for i in range(0, len(rest), 10_000)])
        else:
            self.pending.clear()
        times = [r[1] for r in rest]
        if self.patience is not None and not ended:
            times += [last + self.patience for _, last in known.values() if last is not None]
        if times:
            self.handle.registerTimer(min(times))
        yield pd.DataFrame(dict(zip(self.names, map(list, zip(*out, strict=True)), strict=True)) if out else {}, columns=self.names, dtype=object)


def in_order(rows: DataFrame, key: str, order: Sequence[str], inputs: Sequence[str], machine: Callable[[], object], outputs: str, late: str, ts: str = "ts", patience: float | None = None, buckets: int = 1024) -> DataFrame:
    """A machine for each key over a stream whose rows may come up to `late` out of order (S1, S8, S13; S4 and S19 by timer).

    Rows are held until the watermark passes them and pushed by (ts, *order), so the result equals a fold over the whole
    table, however rows are dealt to micro-batches; rows that come later than that drop. With `patience` (seconds) a key
    without rows for so long is told by `quiet(last_ms, noticed_ms)`, at the time of a timer. At the end of the stream
    machines are closed. State is a machine and the rows of the last `late` for each key; keys share `buckets` groups, whose
    number must stay as it is while a checkpoint is used.
    """
    # The one provider that has timers; a batch writes what changed, not whole files.
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own = list(dict.fromkeys([key, ts + "_ms", *order, *inputs]))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("__bucket")
    some = F.lit("" if rows.schema[key].dataType.typeName() == "string" else 0).cast(rows.schema[key].dataType)
    slim = watermarked(rows, late, ts).withColumn(ts + "_ms", F.unix_millis(ts)).select(bucket, ts, F.coalesce(key, some).alias("filled_key"), F.col(key).isNull().alias("null_key"), *own)
    schema = StructType([StructField(key, rows.schema[key].dataType), *StructType.fromDDL(outputs).fields])
    processor = _InOrder(machine, own, [ts + "_ms", *order], list(inputs), schema.names, None if patience is None else int(patience * 1000))
    return slim.groupBy("__bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


# Correlation


def correlate(requests: DataFrame, responses: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Each request with its responses that come `within` it, or with none once the watermark has passed that time.

    Both streams have `ts`; state holds what is younger than `within` and `late` together. Columns of responses are renamed
    to `answer_...`. Null keys have no answer.
    """
    a = watermarked(requests, late)
    b = watermarked(responses.select(*(F.col(c).alias(f"answer_{c}") for c in responses.columns)), late, "answer_ts")
    near = F.expr(f"answer_ts >= ts AND answer_ts <= ts + INTERVAL {within}")
    return a.join(b, (F.col(key) == F.col(f"answer_{key}")) & near, "left_outer")


# Sinks


def _done(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_MESSAGE = "event_id string, event_type string, ts long, reply_to string, payload string, _bad string"


def _read(lines: DataFrame) -> tuple[DataFrame, Column]:
    told = lines.select("value", F.from_json("value", _MESSAGE, {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    return told, F.col("m._bad").isNull() & F.col("m.event_id").isNotNull() & F.col("m.ts").isNotNull()


def consume(lines: DataFrame, kinds: Sequence[str], late: str) -> DataFrame:
    """Messages of a queue, each once however often it is delivered (A13): id, ts, kind, reply_to, body, state.

    `lines` has `value`, JSON with event_id, event_type, ts (microseconds), reply_to and payload. A message is processed,
    or failed if its type has no handler; it is acknowledged all the same. Redelivered ones are told by their id within
    `late`; older ones are behind the watermark and drop too. How many are fetched at once is the source's
    maxFilesPerTrigger.
    """
    told, readable = _read(lines)
    state = F.when(F.col("m.event_type").isin(*kinds), "processed").otherwise("failed")
    rows = told.filter(readable).select(F.col("m.event_id").alias("id"), F.timestamp_micros("m.ts").alias("ts"), F.col("m.event_type").alias("kind"), F.col("m.reply_to").alias("reply_to"), F.col("m.payload").alias("body"), state.alias("state"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def unreadable(lines: DataFrame) -> DataFrame:
    """Lines that are no messages, acknowledged as failed: id, a digest of the text, and state. They have no time to be told
    apart by, so a line that is delivered again is a row again."""
    told, readable = _read(lines)
    return told.filter(~readable).select(F.sha2("value", 256).alias("id"), F.lit("failed").alias("state"))


def acknowledge(handle: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """Sink of `consume`: `handle` gives processed messages a `response`; replies (id, reply_to, response) and the ledger of
    acknowledgements (id, state) are written by batch."""

    def each(batch: DataFrame, number: int) -> None:
        told = batch.persist()
        handled = handle(told.filter("state = 'processed'"))
        handled.filter("reply_to is not null and response is not null").select("id", "reply_to", "response").write.mode("overwrite").parquet(f"{folder}/replies/batch={number}")
        told.select("id", "state").write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")
        told.unpersist()

    return each


class Outbox:
    """A write-ahead log, a bounded buffer of what waits, and publishing in order.

    Each batch is logged first. To be sent are the rows that the batch before left and the new ones: while
    `link(batch number)` is up, the first `rate` of each queue by `order`. `send` gives rows with `ok`, and sees `attempts`;
    in a batch a row is tried `most` times, then it waits for the next. Of what is left in a queue the newest `keep` wait,
    the others are dropped. Results by batch: log, sent (with their `place` in the queue), dropped and, written last,
    waiting. A batch that is run again reads what the batch before it left and takes over its own tries if they were written
    whole, so nothing is lost, and nothing is sent twice unless the stop came in the middle of sending.

    `order` may use `arrived`, the number of the batch: by `arrived - priority` a row's priority grows with its age, one a
    batch. Ties go by `id`.
    """

    def __init__(self, spark: SparkSession, folder: str, id: str, queue: str, order: Sequence[Column], send: Callable[[DataFrame], DataFrame], link: Callable[[int], bool] = lambda _: True, keep: int | None = None, newest: Sequence[Column] = (), rate: int | None = None, most: int = 1):
        self.spark, self.folder, self.id, self.queue, self.order, self.newest = spark, folder, id, queue, [*order, F.col(id)], [*newest, F.col(id).desc()]
        self.send, self.link, self.keep, self.rate, self.most = send, link, keep, rate, most

    def _write(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        path = f"{self.folder}/{name}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _first(self, rows: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
        """The first n rows of each queue, with `place`; Spark takes the first n of each task before the shuffle."""
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(self.queue).orderBy(*order))).filter(F.col("place") <= n)

    def _without(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        return rows.join(others.select(self.id), self.id, "left_anti").select(*rows.columns)

    def _tried(self, rows: DataFrame, number: int) -> DataFrame:
        """`rows` with `ok` after at most `most` tries; each try is a table, so a lost executor does not send again."""
        out, left = [], rows
        for turn in range(self.most):
            told = self._write(self.send(left.withColumn("attempts", F.col("attempts") + 1)), f"tries-{turn}", number)
            out.append(told.filter("ok"))
            left = told.filter("not ok")
            if turn + 1 < self.most:
                left = left.drop("ok")
        out.append(left)
        whole = out[0]
        for more in out[1:]:
            whole = whole.unionByName(more)
        return whole

    def __call__(self, batch: DataFrame, number: int) -> None:
        new = self._write(batch.withColumn("arrived", F.lit(number)).withColumn("attempts", F.lit(0)), "log", number)
        waiting = new.unionByName(self.spark.read.schema(new.schema).parquet(f"{self.folder}/waiting/batch={number - 1}")) if number else new
        tried = waiting.limit(0).select("*", F.lit(0).alias("place"), F.lit(True).alias("ok"))
        if self.link(number):
            path = f"{self.folder}/tried/batch={number}"
            if not _done(self.spark, path):
                chosen = self._first(waiting, self.order, 2**31 - 1 if self.rate is None else self.rate)
                self._write(self._tried(chosen, number).select(*tried.columns), "tried", number)
            tried = self.spark.read.schema(tried.schema).parquet(path)
        self._write(tried.filter("ok").drop("ok"), "sent", number)
        left = self._without(waiting, tried).unionByName(tried.filter("not ok").drop("ok", "place"))
        if self.keep is not None:
            kept = self._write(self._first(left, self.newest, self.keep).drop("place"), "kept", number)
            self._write(self._without(left, kept), "dropped", number)
            left = kept
        self._write(left, "waiting", number)

    def drain(self, number: int) -> int:
        """Publish what waits after the last batch, `rate` a round, while that gets less; the number of the next batch."""
        empty = self.spark.read.parquet(f"{self.folder}/log/batch=0").drop("arrived", "attempts").limit(0)
        left = self.spark.read.parquet(f"{self.folder}/waiting/batch={number - 1}").count()
        while left:
            self(empty, number)
            now = self.spark.read.parquet(f"{self.folder}/waiting/batch={number}").count()
            number, left = number + 1, now if now < left else 0
        return number

    def rows(self, name: str) -> DataFrame:
        """All rows of log, sent or dropped, with `batch`."""
        return self.spark.read.option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")


def fan_out(sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str) -> Callable[[DataFrame, int], None]:
    """One source to several sinks (S17): a batch is read once, and each sink's part of it replaces itself when run again."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for name, made in sinks.items():
            made(held).write.mode("overwrite").parquet(f"{folder}/sink={name}/batch={number}")
        held.unpersist()

    return each


class Merged:
    """A table kept up to date from a stream in update mode (S26): only the parts that a batch touches are written again.

    A part is a value of `part` (no null). Each batch writes the touched parts into a folder of its own, the rows of the
    batch and those of the part that it does not have; of each part the newest counts. Other parts are neither read nor
    written.
    """

    def __init__(self, spark: SparkSession, folder: str, part: str, keys: Sequence[str]):
        self.spark, self.folder, self.part, self.keys = spark, folder, part, list(keys)

    def versions(self) -> dict[str, list[int]]:
        """Of each part the batches that wrote it, from the names of folders alone."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {}
        for folder in files.listStatus(root) if files.exists(root) else ():
            name = folder.getPath().getName()
            if name.startswith("batch=") and _done(self.spark, str(folder.getPath())):
                for part in files.listStatus(folder.getPath()):
                    if part.getPath().getName().startswith(f"{self.part}="):
                        found.setdefault(part.getPath().getName(), []).append(int(name[6:]))
        return {p: sorted(b) for p, b in found.items()}

    def read(self, schema: StructType, only: Sequence[str] | None = None, before: int = 1 << 62) -> DataFrame:
        """The newest rows of each part, of those in `only`, as batches before `before` left them."""
        paths = [f"{self.folder}/batch={max(b for b in batches if b < before)}/{p}" for p, batches in sorted(self.versions().items()) if (only is None or p in only) and min(batches) < before]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(*paths).select(*schema.names)

    def __call__(self, batch: DataFrame, number: int) -> None:
        held = batch.persist()
        # As many values as the batch touches parts.
        touched = [f"{self.part}={r[0]}" for r in held.select(F.col(self.part).cast("string")).distinct().toLocalIterator()]
        before = self.read(batch.schema, touched, number)
        new = held.select(*(F.col(k).alias(f"new_{k}") for k in self.keys))
        same = F.lit(True)
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"new_{k}"))
        before.join(new, same, "left_anti").unionByName(held).write.mode("overwrite").partitionBy(self.part).parquet(f"{self.folder}/batch={number}")
        held.unpersist()
        # The version before this one stays, in case this batch is run again.
        for part, batches in self.versions().items():
            for old in [b for b in batches if b < number][:-1]:
                _remove(self.spark, f"{self.folder}/batch={old}/{part}")


# Counters


class Counters(StreamingQueryListener):
    """Counts that streams give with `observe` (G26), and one health row for each of their batches.

    Nothing is read a second time: Spark collects the counts in the tasks that run anyway.
    """

    def __init__(self, name: str):
        self.name, self.health, self.ended, self.failed = name, [], threading.Event(), None

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        if told is not None:
            self.health.append({"batch": event.progress.batchId, "input_rows": event.progress.numInputRows, **told.asDict()})

    def onQueryTerminated(self, event) -> None:
        self.failed = event.exception
        self.ended.set()

    def run(self, spark: SparkSession, df: DataFrame, counts: dict[str, Column], run: Callable[[DataFrame], None]) -> list[dict]:
        """Run a stream to its end and give its health rows."""
        spark.streams.addListener(self)
        try:
            run(df.observe(self.name, *(c.alias(n) for n, c in counts.items())))
            self.ended.wait(60)
        finally:
            spark.streams.removeListener(self)
        return self.health
