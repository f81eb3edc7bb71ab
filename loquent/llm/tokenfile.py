"""Token-id files: whole texts as ids in ascending doc_id order, coded by a static range asymmetric numeral system.

A file set is a folder of Parquet rows, one for each block: `part` and `seq` give the order, `doc_ids` and `lengths` the
documents that begin and end in the block, `block` the coded ids; a second folder holds the frequency table that all
blocks share. Blocks are decoded independently of each other.

Defined results: a null text counts as empty; every document ends with the id 0, so an empty one has that id alone;
repeated doc_ids are separate documents that stand next to each other, by a checksum of their ids; a null doc_id comes first; an
empty table gives files without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loquent.llm import rans
from loquent.llm import textbuf as tb
from loquent.llm.scratch import Scratch
from loquent.llm.tokens import encoder

#: Ids of a block; one document is never cut, so a longer one has a block to itself.
BLOCK = 1 << 18
_BLOCKS = "part int, seq int, doc_ids array<long>, lengths array<long>, block binary"


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, tie, n and ids of every text, and after the rows of each task one row with how often each id occurs there.

    Ids have 16 bits where the vocabulary allows that, which is less to move than the text; tie orders equal doc_ids.
    """
    names = ["doc_id", "tie", "n", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, short=True)
        total = np.zeros(enc.size, np.int64)
        for batch in tb.slices(batches):
            ids = enc.ids(batch.column("text").to_pylist())
            total += np.bincount(np.frombuffer(b"".join(ids), enc.kind), minlength=enc.size)
            n = np.array([len(x) for x in ids]) // enc.kind.itemsize
            tie = pa.array([zlib.crc32(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tie, pa.array(n), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([0]), pa.array([b""]), pa.array([total.tobytes()])], names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, tie long, n long, ids binary, counts binary")


def frequencies(ids: DataFrame) -> DataFrame:
    """id and n over all texts: the counts of all tasks, summed. As many rows as ids occur, at most the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("counts"):
                total = np.frombuffer(raw.as_buffer(), np.int64) + (total if len(total) else 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return ids.select("counts").filter("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _coded(ids: DataFrame, shared) -> DataFrame:
    """Coded blocks. Tasks hold ranges of doc_id (and tie), in order."""
    ordered = ids.filter("counts is null").select("doc_id", "tie", "n", "ids").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        docs, lengths, raw, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            kind = np.dtype("<u2" if len(raw[0]) == 2 * lengths[0] else "<u4")
            coded = rans.encode(shared.value, np.frombuffer(b"".join(raw), kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([coded], pa.binary())],
                ["part", "seq", "doc_ids", "lengths", "block"],
            )

        for batch in batches:
            for doc, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True):
                if docs and size + n > BLOCK:
                    yield block()
                    docs, lengths, raw, size, seq = [], [], [], 0, seq + 1
                docs.append(doc)
                lengths.append(n)
                raw.append(ids.as_buffer())
                size += n
        if docs:
            yield block()

    return ordered.mapInArrow(run, _BLOCKS)


def _table(spark: SparkSession, path: str) -> rans.Table:
    got = spark.read.schema("id long, n long").parquet(path).orderBy("id").toPandas()  # at most the vocabulary
    return rans.Table(got["id"].to_numpy(), got["n"].to_numpy())


def write(docs: DataFrame, spark: SparkSession, path: str, out: str) -> None:
    """Tokenise `docs` with the tokenizers file `path` and write the coded files to the folder `out`.

    Texts are tokenised where they are read; what is shuffled is their ids.
    """
    scratch = Scratch(spark)
    ids = scratch.table(tokenised(docs, path), "ids")
    frequencies(ids).coalesce(1).write.parquet(f"{out}/frequencies")
    shared = spark.sparkContext.broadcast(_table(spark, f"{out}/frequencies"))
    _coded(ids, shared).write.option("compression", "none").parquet(f"{out}/blocks")
    scratch.drop(ids)


def read(spark: SparkSession, out: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids (32-bit little-endian) of each document,
    from the files at `out`."""
    shared = spark.sparkContext.broadcast(_table(spark, f"{out}/frequencies"))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{out}/blocks")
    # Ids before each block: sums of the parts, then within a part. A row for each block, and no ids.
    sizes = blocks.select("part", "seq", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size"))
    before = parts.withColumn("base", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "base")
    within = F.sum("size").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("within", within).join(before, "part").select("part", "seq", (F.coalesce("base", F.lit(0)) + F.coalesce("within", F.lit(0))).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                raw = memoryview(rans.decode(shared.value, one.column("block")[0].as_buffer()).tobytes())
                docs, lengths = one.column("doc_ids")[0].values, one.column("lengths")[0].values.to_numpy()
                ends = np.cumsum(lengths)
                raws = [raw[(e - n) * 4 : e * 4] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                many = len(docs)
                columns = [pa.array(np.full(many, one.column(k)[0].as_py(), np.int32)) for k in range(2)] + [docs, pa.array(ends - lengths), pa.array(lengths), pa.array([zlib.crc32(r) for r in raws], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raws, pa.binary())] if ids else columns, names)

    names = ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32", "ids"][: 7 if ids else 6]
    schema = "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    rows = blocks.mapInArrow(run, schema).join(starts, ["part", "seq"])
    return rows.select("doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
