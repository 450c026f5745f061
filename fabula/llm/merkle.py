"""Merkle manifest of a dataset: a tree of hashes for each group of rows, one over their roots, and a proof for every row.

Levels are built from the bottom up, each written as a table: a node holds its
children, which the level below put together by their parent's place. Proofs
are pushed from the top down: a parent's proof joins its node, and each child
takes it over behind a step of its own, the siblings before and after it. A
level is one shuffle of single keys (tree, place), so a group that holds most
rows is spread as evenly as any other, and no task sees more than one run of
children at once. Places come from a range sort: a row's number within its
partition, and the rows of its tree in earlier partitions.

Defined results: a null field is ``-``; a null group is a tree of its own,
before all others; null ids come first; rows of equal id are ordered by their
leaf, and equal rows have equal leaves, so that their order makes no
difference. An empty table gives an empty manifest. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Children of a node.
FAN = 2
_STEPS = "array<struct<before:binary,after:binary>>"


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its UTF-8 bytes' count, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """sha256 of the parts in order, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def tree_key(group: Column) -> Column:
    """A group as a key that is never null and sorts as groups do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _placed(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` (tree, order, digest, ...) with their place ``pos`` in their tree, from 0, and the tree's number of rows ``n``.

    Hashes are written before the sort, which reads its input twice, and the
    sorted rows before they are counted, since a second sort could cut its
    partitions elsewhere."""
    by = ["tree", "order", "digest"]
    hashed = scratch.save(rows, "hashed")
    run = scratch.save(hashed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("id", 33))
    parts = run.groupBy("tree", "part").agg(F.min("id").alias("first"), F.count("*").alias("own"))  # as many rows as partitions and trees at most
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("own").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("own").over(tree).alias("n"))
    out = scratch.save(run.join(starts, ["tree", "part"]).select("tree", "n", (F.col("id") + F.col("shift")).alias("pos"), *(c for c in rows.columns if c != "tree")), "placed")
    scratch.drop(hashed)
    return out


def _step(children: Column, i: Column) -> Column:
    """Child i's siblings: digests before and after it."""
    joined = lambda xs: F.aggregate(xs, F.expr("X''"), lambda a, x: F.concat(a, x["digest"]))
    return F.struct(joined(F.slice(children, F.lit(1), i)).alias("before"), joined(F.slice(children, i + 2, F.lit(FAN))).alias("after"))


class Forest:
    """Trees over placed rows; each level is a table."""

    def __init__(self, scratch: Scratch, leaves: DataFrame):
        """leaves: (tree, order, digest, ...), the other columns staying with their leaf."""
        self.scratch, self.leaves = scratch, _placed(scratch, leaves)
        self.levels: list[DataFrame] = []
        level, most = self.leaves, self.leaves.agg(F.max("n")).first()[0] or 0
        while FAN ** len(self.levels) < most:  # a tree of n leaves has more than one node in level k if n > FAN ** k
            child = F.struct("pos", *(c for c in level.columns if c not in ("tree", "n", "pos", "children")))
            runs = level.where(F.col("n") > FAN ** len(self.levels)).groupBy("tree", "n", F.floor(F.col("pos") / FAN).alias("up")).agg(F.collect_list(child).alias("children"))
            runs = runs.withColumn("children", F.array_sort("children", lambda a, b: (a["pos"] - b["pos"]).cast("int")))
            joined = F.aggregate("children", F.lit(""), lambda a, x: F.concat(a, as_hex(x["digest"])))
            level = scratch.save(runs.select("tree", "n", F.col("up").alias("pos"), digest(joined).alias("digest"), "children"), "level")
            self.levels.append(level)

    def roots(self) -> DataFrame:
        """(tree, n, digest): each tree's root and number of leaves."""
        return self._all_tops().select("tree", "n", "digest")

    def _all_tops(self) -> DataFrame:
        out = self._tops(0, self.leaves)
        for k, level in enumerate(self.levels, 1):
            out = out.unionAll(self._tops(k, level))
        return out

    @staticmethod
    def _tops(k: int, level: DataFrame) -> DataFrame:
        return level.where(F.col("n") <= FAN**k).select("tree", "n", "digest")

    def proofs(self, tails: DataFrame) -> DataFrame:
        """The leaves with the steps from each to the top as ``proof``.

        tails: (tree, n, digest, proof, ...), each tree's root with its own proof; other columns go down to all leaves."""
        down = [c for c in tails.columns if c not in ("tree", "n", "digest", "proof")]
        above = None
        for k in range(len(self.levels), -1, -1):
            ends = tails.where((F.col("n") <= FAN**k) & (F.col("n") > (FAN ** (k - 1) if k else 0)))
            if not k:  # a lone leaf is its tree's root
                ends = self.leaves.where("n = 1").join(ends.drop("n", "digest"), "tree")
            else:
                ends = ends.withColumn("pos", F.lit(0).cast("long"))
            if above is not None:
                pushed = above.select("tree", "n", "proof", *down, "children", F.posexplode("children").alias("i", "child"))
                step = F.array(_step(F.col("children"), F.col("i")))
                own = [c for c in (self.leaves if not k else self.levels[k - 1]).columns if c not in ("tree", "n", "children")]
                pushed = pushed.select("tree", "n", *(F.col("child")[c].alias(c) for c in own), *down, F.concat(step, "proof").alias("proof"))
                ends = pushed.unionByName(ends.select(pushed.columns))
            if not k:
                return ends
            found = self.scratch.save(ends.drop("digest").join(self.levels[k - 1].select("tree", "pos", "children"), ["tree", "pos"]), "proofs")
            if above is not None:
                self.scratch.drop(above)
            above = found
        raise AssertionError


def manifest(rows: DataFrame, fields: list[Column], group: Column, order: Column, keep: dict[str, Column] | None = None) -> DataFrame:
    """Each row's ``order``, ``leaf``, ``subroot`` and ``root`` (32 bytes each) and ``proof``, an array of (before, after).

    fields: what a leaf is made of, in order. keep: further columns of the result."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    keep = {f"keep_{k}": v for k, v in (keep or {}).items()}
    forest = Forest(scratch, rows.select(tree_key(group).alias("tree"), order.alias("order"), digest(*map(field, fields)).alias("digest"), *(v.alias(k) for k, v in keep.items())))
    roots = forest.roots()
    upper = Forest(scratch, roots.select(F.lit("").alias("tree"), F.col("tree").alias("order"), "digest", F.col("n").alias("leaves")))
    top = upper.roots().first()  # one row
    root = F.lit(bytearray(top["digest"]) if top else None).cast("binary")
    bare = upper.roots().withColumn("proof", F.array().cast(_STEPS))
    tails = scratch.save(upper.proofs(bare).select(F.col("order").alias("tree"), F.col("leaves").alias("n"), "digest", "proof", F.col("digest").alias("subroot")), "tails")
    out = forest.proofs(tails)
    return out.select("order", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof", *(F.col(k).alias(k.removeprefix("keep_")) for k in keep))


def folded(leaf: Column, proof: Column) -> Column:
    """The root, in hex, that a leaf's digest and its proof give."""
    return F.aggregate(proof, as_hex(leaf), lambda h, s: F.sha2(F.concat(as_hex(s["before"]), h, as_hex(s["after"])).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """sha256 of all siblings in order, in hex."""
    return F.sha2(F.aggregate(proof, F.lit(""), lambda a, s: F.concat(a, as_hex(s["before"]), as_hex(s["after"]))).cast("binary"), 256)
