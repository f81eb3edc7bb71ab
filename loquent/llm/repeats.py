"""Removal of long repeated byte strings by a common-prefix interval tree over a sparse enhanced suffix array.

A byte is removed if a string of LENGTH bytes covers it that also starts anywhere else. Suffixes are taken at anchors
only: of every LENGTH bytes, the first place where the hash of GRAM bytes is smallest. Equal strings of LENGTH bytes have
equal anchors at equal places, so every repeat shows as a group of anchors with the same bytes there. Each anchor has a
context, the bytes that a string of LENGTH over it can reach. Equal contexts are one entry of a group and repeat as a
whole. Different ones are sorted by what follows the anchor; a scan over their common prefixes with a stack gives the
tree of intervals. Where two subtrees meet, the common extensions to the left of their members, kept in order, tell
which occurrences repeat although they go on differently to both sides, and how far: each gets its span.

Groups of more than HOT different contexts are not gathered. They are split by what strings have in common that begin
within BLOCK neighbouring places (their core): two contexts that share a string share its core, so the tree runs inside
each part, over what stands next to the core. Parts that are still too large are split by the strings themselves.

Defined results: a null text counts as empty; texts shorter than LENGTH keep all; repeated rows repeat each other, so
all their strings of LENGTH bytes go; strings are judged on the input, not on what is left; matches never cross
documents; other columns of the input do not matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loquent.llm import textbuf as tb
from loquent.llm.scratch import Scratch

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM
#: More different contexts than this in a group are split further; a task holds no more of one group at once.
HOT = 1 << 14
#: Places of strings that share a core; divides REACH + 1.
BLOCK = 13
#: Bits of the fixed-size filters that tell scans of the texts which anchors matter. When they fill up, more rows pass; nothing is lost.
FILTER_BITS = 26
#: Parts of a filter that are made apart.
PARTS = 64

_LOW = np.uint64(0xFFFFFFFF)
_COVER = "context long, low int, high int"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by minima of 1, 2, 4, ... of them."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors(sums: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (from `begin`) and hashes of the anchors of one document, whose bytes are [begin, end)."""
    n = end - begin
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = sums[begin + GRAM : end + 1] - sums[begin : end - GRAM + 1]
    h *= tb.inverse_powers(end)[begin : end - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    # The high half of a hash with its place below: the first of the smallest of each window.
    least = _sliding_min(h & ~_LOW | np.arange(len(h), dtype=np.uint64), REACH + 1)
    first = np.flatnonzero(least[1:] != least[:-1]) + 1
    chosen = (np.concatenate((least[:1], least[first])) & _LOW).astype(np.int64)
    return chosen, h[chosen]


def _occurrences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all anchors of a batch: document, place in it, anchor hash, context hash, bytes of context before and after the place."""
    sums = tb.prefix_hash(raw, fold=False)
    rows, places, hashes = [], [], []
    for i in np.flatnonzero(np.diff(offsets) >= LENGTH).tolist():
        place, h = anchors(sums, int(offsets[i]), int(offsets[i + 1]))
        rows.append(np.full(len(place), i))
        places.append(place)
        hashes.append(h)
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none, none
    row, place, h = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
    begin = offsets[row]
    left, right = np.minimum(place, REACH), np.minimum(offsets[row + 1] - begin - place, LENGTH)
    context = tb.range_hash(sums, begin + place - left, begin + place + right)
    return row, place, h, tb.mix(context + left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h), left, right


def _filter(spark: SparkSession, hashes: DataFrame):
    """A broadcast bit table of the column h, of fixed size: tasks make its parts, the driver joins them."""
    size = 1 << (FILTER_BITS - 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = _bit(batch.column("h").to_numpy().view(np.uint64))
            for part in np.unique(batch.column("part").to_numpy()).tolist():
                own = parts.setdefault(part, np.zeros(size // PARTS * 8, bool))
                own[bit[bit // len(own) == part] % len(own)] = True
        for part, own in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()])], ["part", "bits"])

    each = hashes.select("h", F.shiftrightunsigned("h", 64 - 6).cast("int").alias("part"))
    table = np.zeros(size, np.uint8)
    for row in each.repartition(PARTS, "part").mapInArrow(run, "part int, bits binary").collect():  # the table, once
        table[row.part * (size // PARTS) :][: size // PARTS] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(table)


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set."""
    bit = _bit(h)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").filter(F.octet_length("text") >= LENGTH)


def common(table: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the rows a and b of a padded byte table."""
    if not table.shape[1]:
        return np.zeros(len(a), np.int64)
    same = table[a] == table[b]
    first = same.argmin(1)
    first[same[np.arange(len(a)), first]] = table.shape[1]
    return np.minimum(first, np.minimum(sizes[a], sizes[b]))


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as a table with a row of bytes for each value, and the values' sizes."""
    raw, offsets = tb.buffers(column.cast(pa.large_binary()))
    sizes = np.diff(offsets)
    table = np.zeros((len(sizes), int(sizes.max(initial=0))), np.uint8)
    table[np.arange(table.shape[1]) < sizes[:, None]] = raw
    return table, sizes


def repeats(rights: list[int], ranks: list[int], lefts: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(member, bytes to the left, bytes to the right) of what repeats among the members of a group, at least `least` bytes.

    Members are in the order of their suffixes; rights[i] is the common prefix of i - 1 and i. ranks tells each member's
    place in the order of what stands before, lefts[k] the common extension of places k - 1 and k there. The scan keeps
    the open intervals of the tree on a stack, each with its members' places in order. When an interval closes it joins
    the one around it, the smaller into the larger; next to each other there, two members share just what their
    interval and the extensions between them give, and differ to both sides.
    """
    member = [0] * len(ranks)
    for i, k in enumerate(ranks):
        member[k] = i

    def joined(one: list[int], two: list[int], right: int) -> Iterator[tuple[int, int, int]]:
        if len(one) < len(two):
            one, two = two, one
        for k in two:
            at = bisect_left(one, k)
            if at and (left := min(lefts[one[at - 1] + 1 : k + 1])) + right >= least:
                yield member[k], left, right
                yield member[one[at - 1]], left, right
            if at < len(one) and (left := min(lefts[k + 1 : one[at] + 1])) + right >= least:
                yield member[k], left, right
                yield member[one[at]], left, right
            one.insert(at, k)
        open_.append((right, one))

    open_: list[tuple[int, list[int]]] = []
    own = [ranks[0]]
    for i in range(1, len(ranks) + 1):
        value = rights[i] if i < len(ranks) else -1
        while open_ and open_[-1][0] > value:
            right, around = open_.pop()
            yield from joined(around, own, right)
            own = open_.pop()[1]
        if i == len(ranks):
            return
        if open_ and open_[-1][0] == value:
            yield from joined(open_.pop()[1], own, value)
        else:
            open_.append((value, own))
        own = [ranks[i]]


def merged(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each key, those that touch made one; keys are small whole numbers."""
    order = np.lexsort((low, keys))
    keys, low, high = keys[order], low[order].astype(np.int64), high[order].astype(np.int64)
    # Shifted by key, so that one running maximum serves all keys.
    shift = keys * (1 << 40)
    reach = np.maximum.accumulate(high + shift) if len(high) else high
    new = np.concatenate(([True], (low + shift)[1:] > reach[:-1])) if len(low) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return keys[start], low[start], (reach[np.append(start[1:], len(low)) - 1] - shift[start]) if len(start) else high


def _tree(shared: int):
    """A function for rows (key, entry, left, right) sorted by key, right and entry: the spans of each entry that repeat
    in another entry of its key. `left` runs backwards; `shared` bytes between the two are the same for all of a key."""
    least = LENGTH - shared

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, entry = rows.column("key").to_numpy(), rows.column("entry").to_numpy()
        once = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (entry[1:] != entry[:-1]))))
        rows, key, entry = rows.take(pa.array(once)), key[once], entry[once]
        (left, left_size), (right, right_size) = padded(rows.column("left")), padded(rows.column("right"))
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        at = np.arange(1, len(key))
        after = np.concatenate(([0], common(right, right_size, at - 1, at)))
        # Pairs need no tree.
        pair = starts[sizes == 2]
        before = common(left, left_size, pair, pair + 1)
        some = before + after[pair + 1] >= least
        own = [np.concatenate((pair[some], pair[some] + 1))]
        lows, highs = [np.tile(-before[some], 2)], [np.tile(shared + after[pair[some] + 1], 2)]
        found: list[tuple[int, int, int]] = []
        text, after = rows.column("left").to_pylist(), after.tolist()
        for begin, many in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            order = np.array(sorted(range(begin, begin + many), key=text.__getitem__))
            ranks = np.empty(many, np.int64)
            ranks[order - begin] = np.arange(many)
            lefts = [0, *common(left, left_size, order[:-1], order[1:]).tolist()]
            found += [(begin + i, a, b) for i, a, b in repeats(after[begin : begin + many], ranks.tolist(), lefts, least)]
        if found:
            more = np.array(found, np.int64)
            own.append(more[:, 0])
            lows.append(-more[:, 1])
            highs.append(shared + more[:, 2])
        who, low, high = merged(np.concatenate(own), np.concatenate(lows), np.concatenate(highs))
        return pa.RecordBatch.from_arrays([pa.array(entry[who]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["context", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the rows of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if kept and (last or key[0] != kept[-1].column("key")[0].as_py()):
                yield solve(pa.concat_batches([*kept, batch.slice(0, last)]))
                kept = []
            elif last:
                yield solve(batch.slice(0, last))
            kept.append(batch.slice(last))
        if kept:
            yield solve(pa.concat_batches(kept))

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.select("key", "entry", "left", "right").repartition("key").sortWithinPartitions("key", "right", "entry")


def covered(docs: DataFrame, spark: SparkSession, scratch: Scratch) -> DataFrame:
    """doc_id, digest and spans (low, high bytes) that repeat, for each text that has some."""
    texts = _key(docs)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            row, place, h, context, left, right = _occurrences(*tb.buffers(part.column("text")))
            one = _one(context, part.column("digest").to_numpy().view(np.uint64)[row], place)
            _, at, n = np.unique(context, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in (h, context, one)), pa.array((left << 16 | right)[at].astype(np.int32)), pa.array(n)], ["h", "context", "one", "size", "n"])

    # Of each context: how often it occurs, its size, and one occurrence. Copies are taken together before the shuffle.
    seen = texts.mapInArrow(contexts, "h long, context long, one long, size int, n long")
    seen = scratch.table(seen.groupBy("h", "context").agg(F.sum("n").alias("n"), F.min("size").alias("size"), F.min("one").alias("one")), "contexts")
    groups = seen.groupBy("h").agg(F.count("*").alias("many"), F.sum("n").alias("total")).filter("total > 1")
    wanted = scratch.table(seen.join(groups, "h").select("h", "context", "n", "size", "one", "many"), "wanted")
    scratch.drop(seen)
    repeated = _filter(spark, wanted.select(F.col("context").alias("h")))
    chosen = _filter(spark, wanted.filter("many > 1").select(F.col("one").alias("h")))
    hot = _filter(spark, wanted.filter(F.col("many") > HOT).select("h").distinct())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            raw, offsets = tb.buffers(part.column("text"))
            found = _occurrences(raw, offsets)
            row, place, h, context, left, right = (x[_passes(repeated.value, found[3])] for x in found)
            shown = _passes(chosen.value, _one(context, part.column("digest").to_numpy().view(np.uint64)[row], place))
            at, data, back = (offsets[row] + place).tolist(), raw.tobytes(), raw[::-1].tobytes()
            lefts, rights = [None] * len(row), [None] * len(row)
            for k in np.flatnonzero(shown).tolist():
                p = at[k]
                lefts[k], rights[k] = back[len(back) - p : len(back) - p + int(left[k])], data[p + GRAM : p + int(right[k])]
            columns = [part.column("doc_id").take(pa.array(row)), part.column("digest").take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(context.view(np.int64))]
            more = [pa.array(h.view(np.int64), mask=~shown), pa.array(_passes(hot.value, h)), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + more, ["doc_id", "digest", "place", "context", "key", "hot", "left", "right"])

    placed = scratch.table(texts.mapInArrow(places, "doc_id long, digest long, place int, context long, key long, hot boolean, left binary, right binary"), "places")
    shown = placed.filter("key is not null").select("key", F.col("context").alias("entry"), "hot", "left", "right")
    # Contexts that occur twice repeat as a whole.
    whole = wanted.filter("n > 1").select("context", (-F.shiftright("size", 16)).alias("low"), F.col("size").bitwiseAND(0xFFFF).alias("high"))
    by_tree = _sorted(shown.filter("not hot")).mapInArrow(_tree(GRAM), _COVER)
    cover = scratch.table(whole.unionByName(by_tree).unionByName(_split(shown.filter("hot"), scratch)), "cover")
    spans = placed.select("doc_id", "digest", "place", "context").join(cover, "context")
    return spans.groupBy("doc_id", "digest").agg(F.collect_list(F.struct((F.col("place") + F.col("low")).alias("low"), (F.col("place") + F.col("high")).alias("high"))).alias("spans"))


def _one(context: np.ndarray, digest: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Tells occurrences apart; context and digest are hashes already, so their bits may be combined as they are."""
    return context ^ digest ^ (place.astype(np.uint64) << np.uint64(40))


def _split(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans of the contexts of hot groups: the tree inside each set of contexts that share a core.

    A context is taken apart into what stands around the core of every BLOCK of places where strings begin. Contexts with
    the same bytes there are one entry. Equal strings have equal anchors at equal places, so contexts that share a string
    share its core at the same distance from the anchor; without the distance, contexts of one text that overlap would
    count one occurrence twice. The last step is for cores with more than HOT entries: an entry's strings are at most BLOCK.
    """
    core_size = LENGTH - BLOCK + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(k).to_pylist() for k in ("left", "right"))
            before = np.array([len(x) for x in left], np.int64)
            # The bytes before the anchor and those after its GRAM; the GRAM itself is the same for all of a key.
            data = np.frombuffer(b"".join(a[::-1] + b for a, b in zip(left, right, strict=True)), np.uint8)
            sizes = before + [len(x) for x in right]
            begin = np.cumsum(sizes) - sizes
            sums = tb.prefix_hash(data, fold=False)
            low = np.arange(-REACH, 1, BLOCK)[None]
            # Of the core, from the anchor: where it begins and ends; without the GRAM, which lies in it.
            first, end = low + BLOCK - 1, low + LENGTH - GRAM
            least, most = -before[:, None], (sizes - before)[:, None]
            back, ahead = np.minimum(first - least, BLOCK - 1), np.minimum(most - end, BLOCK - 1)
            own, block = np.nonzero((back >= 0) & (ahead >= 0) & (back + ahead >= BLOCK - 1))
            first, end, back, ahead = first[0][block], end[0][block], back[own, block], ahead[own, block]
            at = begin[own] + before[own]
            key = batch.column("key").to_numpy().view(np.uint64)[own]
            core = tb.mix(tb.range_hash(sums, at + first, at + end) + key + block.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            entry = tb.mix(tb.range_hash(sums, at + first - back, at + end + ahead) + core + back.astype(np.uint64))
            raw = data.tobytes()
            cut = zip((at + first - back).tolist(), (at + first).tolist(), (at + end).tolist(), (at + end + ahead).tolist(), strict=True)
            lefts, rights = zip(*((raw[a:b][::-1], raw[c:d]) for a, b, c, d in cut), strict=True) if len(at) else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("entry").take(pa.array(own)), pa.array(first.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(entry.view(np.int64)), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())],
                ["context", "first", "key", "entry", "left", "right"],
            )

    each = scratch.table(rows.dropDuplicates(["key", "entry"]).mapInArrow(blocks, "context long, first int, key long, entry long, left binary, right binary"), "blocks")
    entries = scratch.table(each.groupBy("key", "entry").agg(F.count("*").alias("n"), F.first("left").alias("left"), F.first("right").alias("right")), "entries")
    # The same bytes around a core in two contexts: all of them repeat.
    whole = entries.filter("n > 1").select(F.col("entry").alias("context"), (-F.octet_length("left")).alias("low"), (F.octet_length("right") + core_size).alias("high"))
    many = entries.groupBy("key").agg(F.count("*").alias("many")).filter("many > 1")
    parts = scratch.table(entries.join(many, "key").select("key", "entry", "left", "right", "many"), "parts")
    by_tree = _sorted(parts.filter(F.col("many") <= HOT)).mapInArrow(_tree(core_size), _COVER)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, entry, left, right in zip(*(batch.column(k).to_pylist() for k in ("key", "entry", "left", "right")), strict=True):
                for back in range(max(0, BLOCK - 1 - len(right)), len(left) + 1):
                    out.append((key, entry, back, left[:back] + b"|" + right[: BLOCK - 1 - back]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ((),) * 4, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["key", "entry", "back", "string"])

    single = scratch.table(parts.filter(F.col("many") > HOT).mapInArrow(strings, "key long, entry long, back int, string binary"), "strings")
    twice = single.groupBy("key", "back", "string").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    by_string = single.join(twice, ["key", "back", "string"]).select(F.col("entry").alias("context"), (-F.col("back")).alias("low"), (F.lit(core_size + BLOCK - 1) - F.col("back")).alias("high"))
    # At most BLOCK strings of an entry, and some entries of a context.
    cover = whole.unionByName(by_tree).unionByName(by_string).groupBy(F.col("context").alias("entry")).agg(F.collect_set(F.struct("low", "high")).alias("spans"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            own = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
            shift, flat = batch.column("first").to_numpy()[own], spans.flatten()
            contexts, key = np.unique(batch.column("context").to_numpy(), return_inverse=True)
            key, low, high = merged(key[own], flat.field("low").to_numpy() + shift, flat.field("high").to_numpy() + shift)
            yield pa.RecordBatch.from_arrays([pa.array(contexts[key]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["context", "low", "high"])

    rows = each.select("context", "first", "entry").join(cover, "entry").select("context", "first", "spans")
    return rows.repartition("context").sortWithinPartitions("context").mapInArrow(gathered, _COVER)


def remove(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans removed (low, high), and the bytes kept, of every row of `docs`."""
    scratch = Scratch(spark)
    # What is needed of all that: one row for each text that has repeats.
    spans = scratch.finish(covered(docs, spark, scratch)).withColumnRenamed("doc_id", "other")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    rows = rows.join(spans, (rows["digest"] == spans["digest"]) & rows["doc_id"].eqNullSafe(spans["other"]), "left").select("doc_id", "text", F.col("spans.low").alias("low"), F.col("spans.high").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches):
            raw, offsets = tb.buffers(part.column("text"))
            lows, highs = part.column("low").fill_null([]), part.column("high").fill_null([])
            many = np.diff(lows.offsets.to_numpy())
            own, low, high = merged(np.repeat(np.arange(part.num_rows), many), lows.flatten().to_numpy(), highs.flatten().to_numpy())
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, offsets[own] + low, 1)
            np.add.at(edge, offsets[own] + high, -1)
            stay = np.cumsum(edge[:-1]) == 0
            left = np.concatenate(([0], np.cumsum(stay)))
            sizes, ends, data = np.diff(offsets), left[offsets].tolist(), raw[stay].tobytes()
            kept = pa.array([data[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
            struct = pa.StructArray.from_arrays([pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["low", "high"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32)), struct)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(sizes - np.diff(left[offsets])), lists, kept], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<low: int, high: int>>, kept binary")
