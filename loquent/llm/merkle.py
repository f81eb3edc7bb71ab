"""A dataset manifest: a tree of digests for each source and one over the sources, with proofs of every row.

Only every `step`-th level of a tree is kept. A proof needs the levels between as well: those of one aligned subtree are
made again from the stored nodes under it, give their siblings and are not written anywhere.

Places of leaves come from a sort by range, so a source of any size is spread over all tasks; a subtree has at most
3**step stored nodes, and it is the largest group that is ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loquent.llm.scratch import Scratch

#: Children of a node, and levels from one stored level to the next.
WIDTH, STEP = 3, 4
SIBLINGS = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values one after the other: `-` for null, else UTF-8 byte count, `:`, value."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(proof, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def _joined(nodes: Column, start: Column, many: Column) -> Column:
    return F.array_join(F.slice(nodes, start, many), "")


def _parents(nodes: Column) -> Column:
    """The digests of every WIDTH consecutive nodes; the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / WIDTH).cast("int"))
    return F.transform(runs, lambda i: F.sha2(_joined(nodes, i * WIDTH + 1, F.lit(WIDTH)), 256))


def _times(n: Column) -> Column:
    return F.array_repeat(F.lit(0), n)


def _height(leaves: Column) -> Column:
    """Levels from the leaves to the last node: the least h with WIDTH**h >= leaves."""
    powers = F.array(*(F.lit(WIDTH**h) for h in range(40)))
    return F.size(F.filter(powers, lambda p: p < leaves))


def _placed(spark: SparkSession, scratch: Scratch, rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """`rows` with `place` (from 0, ascending by `order`, nulls first) and `leaves`, the number of rows of its tree."""
    keys = [tree, *order]
    # Ids ascend over the sorted partitions; written, they stay as they are if an executor is lost.
    sorted_rows = scratch.table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33)), "sorted")
    counts = sorted_rows.groupBy(tree, "part").agg(F.count("*").alias("many"), F.min("id").alias("first_id"))
    # As many rows as partitions and trees together.
    whole = Window.partitionBy(tree)
    before = F.coalesce(F.sum("many").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.table(counts.withColumn("before", before).withColumn("leaves", F.sum("many").over(whole)).withColumnRenamed(tree, "own_tree").withColumnRenamed("part", "own_part"), "starts")
    joined = sorted_rows.join(starts, (F.col("part") == F.col("own_part")) & F.col(tree).eqNullSafe(F.col("own_tree")))
    return joined.withColumn("place", F.col("id") - F.col("first_id") + F.col("before")).drop("id", "part", "own_tree", "own_part", "first_id", "before", "many")


def _blocks(level: DataFrame, tree: str, base: int, step: int, also: Sequence[str] = ()) -> DataFrame:
    """The aligned subtrees over a stored level: their nodes in order, and how many levels they rise (less at the top)."""
    held = F.struct("place", "node", *also)
    rows = level.groupBy(tree, "leaves", F.floor(F.col("place") / WIDTH**step).alias("block")).agg(F.sort_array(F.collect_list(held)).alias("held"))
    rise = F.least(F.lit(step), F.greatest(_height(F.col("leaves")) - base, F.lit(0)))
    return rows.withColumn("nodes", F.col("held.node")).withColumn("rise", rise)


class Trees:
    """The stored levels of all trees of one table: level 0, `step`, 2 * `step`, ... and the last nodes, `tops`."""

    def __init__(self, spark: SparkSession, scratch: Scratch, rows: DataFrame, tree: str, order: Sequence[str], also: Sequence[str] = (), step: int = STEP):
        self.spark, self.scratch, self.tree, self.step, self.also = spark, scratch, tree, step, list(also)
        level = scratch.table(_placed(spark, scratch, rows, tree, order), "level-0")
        self.levels = [level]
        height = level.agg(F.max(_height(F.col("leaves")))).first()[0] or 0
        for base in range(0, height, step):
            rising = _blocks(level.filter(_height(F.col("leaves")) > base).select(tree, "leaves", "place", "node"), tree, base, step)
            tops = F.aggregate(_times(F.col("rise")), F.col("nodes"), lambda nodes, _: _parents(nodes))
            level = scratch.table(rising.select(tree, "leaves", F.col("block").alias("place"), tops[0].alias("node")), f"level-{base + step}")
            self.levels.append(level)

    def tops(self) -> DataFrame:
        """The last node of each tree: tree, top."""
        out = None
        for k, level in enumerate(self.levels):
            # A tree ends in the first stored level at or above its height.
            height = F.ceil(_height(F.col("leaves")) / self.step)
            rows = level.filter(height == k).select(self.tree, F.col("node").alias("top"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """Level 0 with `proof`, an array of (left, right): the siblings before and after, joined, from the leaf upwards.

        `above` (tree, proof, and what else all leaves of a tree shall get) continues the proofs of a tree's top. Each
        level from the top down takes what its parent level was given, one row for each subtree.
        """
        tree, given = self.tree, above
        shared = [c for c in above.columns if c not in (tree, "proof")] if above is not None else []
        if given is None:
            given = self.tops().select(tree, F.array().cast(SIBLINGS).alias("proof"))
        given = given.select(F.col(tree).alias("up_tree"), F.col("proof").alias("up_proof"), *shared)
        higher: DataFrame | None = None
        for k in range(len(self.levels) - 1, -1, -1):
            base, also = k * self.step, self.also if k == 0 else []
            blocks = _blocks(self.levels[k], tree, base, self.step, also)
            # A subtree that holds its tree's top gets what comes above the tree, any other what its parent was given.
            top = F.col("rise") + base >= _height(F.col("leaves"))
            from_above = blocks.filter(top).join(given, F.col(tree).eqNullSafe(F.col("up_tree"))).drop("up_tree")
            if higher is not None:
                up = higher.select(F.col(tree).alias("up_tree"), F.col("place").alias("up_place"), F.col("proof").alias("up_proof"), *shared)
                rest = blocks.filter(~top).join(up, F.col(tree).eqNullSafe(F.col("up_tree")) & (F.col("block") == F.col("up_place"))).drop("up_tree", "up_place")
                from_above = from_above.unionByName(rest)
            # The levels of the subtree, made again from its stored nodes; each gives siblings to every stored node.
            start = F.array(F.col("nodes"))
            again = F.aggregate(_times(F.col("rise") - 1), start, lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))))
            found = from_above.withColumn("again", F.when(F.col("rise") > 0, again).otherwise(F.array().cast("array<array<string>>")))
            rows = found.select(tree, "leaves", "up_proof", "again", *shared, F.posexplode("held").alias("at", "one"))
            own = F.transform("again", self._siblings)
            out = rows.select(tree, "leaves", F.col("one.place").alias("place"), F.col("one.node").alias("node"), *(F.col(f"one.{c}").alias(c) for c in also), *shared, F.concat(own, F.col("up_proof")).alias("proof"))
            if not k:
                return out
            higher = self.scratch.table(out, f"proofs-{base}")
        raise AssertionError("a tree has level 0")

    @staticmethod
    def _siblings(nodes: Column, level: Column) -> Column:
        """The others of the run in which the node `at` of the subtree stands at a level of it."""
        own = F.floor(F.col("at") / F.pow(F.lit(float(WIDTH)), level)).cast("int")
        first = own - own % WIDTH
        return F.struct(_joined(nodes, first + 1, own - first).alias("left"), _joined(nodes, own + 2, F.lit(WIDTH - 1) - (own - first)).alias("right"))


def prove(docs: DataFrame, spark: SparkSession, fields: Sequence[str], order: str = "doc_id", tree: str = "source", tampered: Column | None = None, step: int = STEP) -> DataFrame:
    """Every row of `docs` as a leaf: `order`, leaf, subroot, root, proof, n_leaves and, if asked for, `tampered`.

    A leaf is the digest of `fields`. The leaves of each `tree` value ascend by `order` (nulls first; equal ones by their
    digest, so repeated rows stand next to each other and each has its own proof) and lead to a subroot; subroots by the
    tree value (null first, bytewise) lead to the root. proof holds the siblings from the leaf to the root. `tampered`
    is an expression over `docs`, such as the digest of changed fields. An empty table gives an empty one; of `docs`, only
    the columns named are read, so others may have any names. Texts are read once and never shuffled.
    """
    scratch = Scratch(spark)
    changed = (F.lit(None).cast("string") if tampered is None else tampered).alias("changed")
    leaves = docs.select(F.col(f"`{tree}`").alias("tree"), F.col(f"`{order}`").alias("sort_key"), digest(*(F.col(f"`{c}`") for c in fields)).alias("node"), changed)
    trees = Trees(spark, scratch, scratch.table(leaves, "leaves"), "tree", ["sort_key", "node"], ["sort_key", "changed"], step)
    subroots = scratch.table(trees.tops().select(F.lit(0).alias("all"), "tree", F.col("top").alias("node")), "subroots")
    over = Trees(spark, scratch, subroots, "all", ["tree"], ["tree"], step)
    root = over.tops().select("all", F.col("top").alias("root"), F.array().cast(SIBLINGS).alias("proof"))
    above = scratch.table(over.proofs(root).select("tree", F.col("node").alias("subroot"), "root", "proof"), "above")
    out = trees.proofs(above)
    names = {"sort_key": order, "node": "leaf", "subroot": "subroot", "root": "root", "proof": "proof", "leaves": "n_leaves"} | ({"changed": "tampered"} if tampered is not None else {})
    return scratch.finish(out.select(*(F.col(a).alias(b) for a, b in names.items())))
