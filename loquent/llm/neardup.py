"""MinHash near-duplicates with SuperMinHash signatures.

A document is the set of its distinct 5-word shingles (words [^\\x20\\x09-\\x0D]+, A-Z as a-z; with fewer words the
whole sequence is its only shingle). SuperMinHash gives each shingle a random permutation of the signature's slots and
writes its j-th rank j + random there; a slot keeps its least value. Ranks of a shingle are correlated, so signatures
vary less than independent ones, and once all slots hold values below j, later ranks can be skipped.

Bands of slots give candidates. Shingles that a set shares with no other candidate bound its similarity to all of them,
so most sets that only look alike drop out before any pair is made. In each bucket the members that share most, its hubs,
are compared with those of other components that sizes and own shingles still allow; what no hub reached is compared last
under the same bounds, on full shingle sets. So no link between different texts is lost, and a bucket's pairs are not
all emitted. Equal sets are one class from the start. Components are found by star contraction.

Defined results: null and wordless texts have no shingles, and are linked with nothing; ties are settled by doc_id;
repeated rows belong to one component, as equal texts do; a row without doc_id links others, but its id is no component
(a component of such rows alone has none), and is kept if its component has no id; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loquent.llm import textbuf as tb
from loquent.llm.components import components
from loquent.llm.scratch import Scratch, small_batches

#: A pair that is just similar enough shares no bucket with at most this probability; a band of it agrees at most so often.
MISSED, AGREES = 1e-6, 0.325
SHINGLE = 5
#: Rows handed to Python at once: texts, or pairs of sets.
BATCH = 1000
#: Buckets are finished at once when the pairs in them are at most so many, or 20 for each of their rows; only pairs that
#: may still link leave the join.
PAIRS = 50_000_000


def superminhash(shingles: np.ndarray, slots: int) -> np.ndarray:
    """The signature of a set of distinct hashes. Rank j of all elements is done at once; slots filled by a lower rank stay."""
    out = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    n = len(shingles)
    if not n:
        return out
    place = None
    rows = np.arange(n)
    for j in range(slots):
        x = tb.mix(shingles + np.uint64((j + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
        swap = j + ((x >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if place is None and j == 0:
            slot, first = swap, swap
        else:
            if place is None:
                place = np.broadcast_to(np.arange(slots, dtype=np.int16), (n, slots)).copy()
                place[rows, first] = 0
                place[:, 0] = first
            slot = place[rows, swap].astype(np.int64)
            place[rows, swap] = place[:, j]
            place[:, j] = slot
        np.minimum.at(out, slot, (x & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32))
        if out.max() < np.uint64((j + 1) << 32):
            break
    return out


def banding(percent: int) -> tuple[int, int]:
    """Bands and slots a band for links at `percent`: 36 of 7 at 85, 46 of 6 at 80."""
    like = min(percent, 99) / 100
    rows = math.ceil(math.log(AGREES) / math.log(like))
    return math.ceil(math.log(MISSED) / math.log1p(-(like**rows))), rows


def bands(signature: np.ndarray, many: int, rows: int) -> np.ndarray:
    weights = tb.powers(rows + 1, 0x8CB92BA72F3D8DD7)[1:]
    return tb.mix((signature.reshape(many, rows) * weights).sum(1, dtype=np.uint64) + np.arange(many, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, text_digest, n_shingles, node (a digest of the shingle set) and the band keys of each document."""
    many, slots = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            sizes, nodes, keys = [], [], []
            for shingles in tb.shingle_sets(*tb.buffers(part.column("text")), SHINGLE):
                sizes.append(len(shingles))
                nodes.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                keys.append(bands(superminhash(shingles, many * slots), many, slots) if len(shingles) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_digest"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), lists], ["doc_id", "text_digest", "n_shingles", "node", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_digest"), "text").mapInArrow(run, "doc_id long, text_digest long, n_shingles long, node binary, keys array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v), how many shingles `both` full sets have, and whether that links them: 100 * both >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("a"), batch.column("b")
            both, keep = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
                small, big = (a, b) if len(a) < len(b) else (b, a)
                at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                both[i] = (big[at] == small).sum()
                keep[i] = 100 * both[i] >= percent * (len(a) + len(b) - both[i])
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(both), pa.array(keep)], ["u", "v", "both", "linked"])

    a = sets.select(F.col("node").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary, both long, linked boolean")


def near_duplicates(docs: DataFrame, spark: SparkSession, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is that) and text_digest of each row."""
    with small_batches(spark, BATCH):
        return _near_duplicates(docs, spark, percent)


def _near_duplicates(docs: DataFrame, spark: SparkSession, percent: int) -> DataFrame:
    scratch = Scratch(spark)
    rows = scratch.table(signed(docs, percent), "signed")
    # One row a class of equal sets: partial aggregation takes copies together before the shuffle.
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.coalesce(F.min_by("text_digest", "doc_id"), F.min("text_digest")).alias("text_digest"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = scratch.table(classes, "classes")
    member = classes.select(F.explode("keys").alias("bucket"), "node", "n")
    shared = member.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1").select("bucket")
    member = scratch.table(member.join(shared, "bucket"), "members")  # of buckets with more than one class

    # Texts are shuffled once, for one row of each class that has a candidate.
    need = member.select("node").distinct()
    texts = classes.join(need, "node", "left_semi").select("node", "id", "text_digest")
    with_text = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("digest"))
    with_text = with_text.join(texts, (F.col("digest") == F.col("text_digest")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = scratch.table(_checked(with_text).dropDuplicates(["node"]), "sets")

    # What a class shares with no other candidate bounds its similarity to any of them; see _may_link.
    member = member.join(_own(sets), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    member = member.filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    live = scratch.table(member.select("bucket", "node", "n", "own", F.col("node").alias("root"), (F.col("own") / F.col("n")).alias("rank"), F.lit(None).cast("long").alias("both")), "live")
    edges, labels, hubs = None, None, 1
    while True:
        size = live.groupBy("bucket").agg(F.count("*").alias("many"), F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
        work, total = size.agg(F.sum(F.col("many").cast("double") ** 2), F.sum("many")).first()
        if work is None:
            break
        last = hubs > 16 or (hubs > 1 and work <= max(PAIRS, 20 * total))
        if last:
            hub = live
        else:
            # The next hubs of each bucket are its members that share most. Ranks are of the class, not of the bucket, so
            # that many buckets share hubs. The filter on row_number keeps `hubs` rows a bucket before the shuffle.
            order = Window.partitionBy("bucket").orderBy("rank", "node")
            hub = scratch.table(live.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= hubs).drop("nth"), "hubs")
        hub = hub.select(F.col("bucket").alias("at"), *(F.col(c).alias(f"hub_{c}") for c in ("node", "n", "own", "root", "both")))
        link = (F.col("bucket") == F.col("at")) & (F.col("root") != F.col("hub_root")) & _may_link(percent)
        if last:
            link = link & (F.col("node") < F.col("hub_node"))
        pairs = live.join(hub, link).select(F.least("node", "hub_node").alias("u"), F.greatest("node", "hub_node").alias("v")).distinct()
        found = scratch.table(_compared(pairs, sets, percent), "links")
        linked = found.filter("linked").select("u", "v")
        edges = linked if edges is None else edges.unionByName(linked)
        labels = components(edges, scratch).withColumnRenamed("root", "to")
        if last:
            break
        # Hubs are done with: they were compared with all of their bucket that they may link to.
        rest = live.drop("root").join(hub.select(F.col("at").alias("bucket"), F.col("hub_node").alias("node")), ["bucket", "node"], "left_anti")
        if hubs == 1:
            # What a member has in common with its bucket's first hub bounds what two members can have in common.
            one = hub.select(F.col("at").alias("bucket"), "hub_node")
            rest = rest.drop("both").join(one, "bucket").withColumn("u", F.least("node", "hub_node")).withColumn("v", F.greatest("node", "hub_node"))
            rest = rest.join(found.select("u", "v", "both"), ["u", "v"], "left").drop("u", "v", "hub_node")
        rest = rest.join(labels, "node", "left").withColumn("root", F.coalesce("to", "node")).drop("to")
        following = scratch.table(rest.select("bucket", "node", "n", "own", "root", "rank", "both"), "live")
        scratch.drop(live)
        live, hubs = following, hubs * 4
    if labels is None:
        labels = classes.select("node", F.col("node").alias("to")).limit(0)

    of_class = classes.select("node", "id").join(labels.withColumnRenamed("to", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of_class.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = of_class.join(least, "root").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node", "text_digest").join(of_class, "node", "left")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return scratch.finish(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_digest").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_digest"))


def _own(sets: DataFrame) -> DataFrame:
    """node and `own`: how many of its shingles stand in no other of these sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("set")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(data)), pa.array(np.repeat(part.column("id").to_numpy(), [len(x) for x in data]))], ["shingle", "id"])

    each = sets.select(F.xxhash64("node").alias("id"), "set").mapInArrow(run, "shingle long, id long")
    single = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return sets.select("node", F.xxhash64("node").alias("id")).join(single.groupBy("id").agg(F.count("*").alias("own")), "id").select("node", "own")


def _may_link(percent: int):
    """Whether sizes leave room for the similarity. At most n - own of either set can be common; and if both sets were
    compared with one hub, at most what each kept of it and what both may have gained."""
    most = F.least(F.col("n") - F.col("own"), F.col("hub_n") - F.col("hub_own"), F.col("n"), F.col("hub_n"))
    kept = F.least("both", "hub_both")
    gained = F.least(F.col("n") - F.col("both") - F.col("own"), F.col("hub_n") - F.col("hub_both") - F.col("hub_own"))
    most = F.when(F.col("both").isNotNull() & F.col("hub_both").isNotNull(), F.least(most, kept + gained)).otherwise(most)
    return 100 * most >= percent * (F.col("n") + F.col("hub_n") - most)


def _checked(with_text: DataFrame) -> DataFrame:
    """Sets of the texts that have the node they were joined with (an id may stand for several texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            nodes = part.column("node").to_pylist()
            own, sets = [], []
            for node, shingles in zip(nodes, tb.shingle_sets(*tb.buffers(part.column("text")), SHINGLE), strict=True):
                raw = shingles.tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() == node:
                    own.append(node)
                    sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(sets, pa.binary())], ["node", "set"])

    return with_text.select("node", "text").mapInArrow(run, "node binary, set binary")
