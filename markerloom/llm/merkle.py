"""Merkle manifest of a table by nested-interval labels (operator 12).

The rows of a tree are its leaves, by rank. Every node carries the interval of
leaf ranks ``[lo, hi)`` that it covers, so a node is an ancestor of a leaf if its
interval contains the leaf's, and the siblings on the way up are what is left of
a parent's interval without that of the child.

Containment is an equality once levels are bucketed: ``LEVELS`` levels form a
band, and all nodes of a band below the same node of the next band share a
bucket, the leading part of their ranks. A bucket is one row, with at most
``2 ** LEVELS`` nodes at its foot. Going up, only the top of each bucket is
passed on, one for 256; going down, each bucket is joined with the path of its
top. So a table of any size takes a few rounds, and each shuffles less.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markerloom.llm.common import stored

ARITY = 2
#: Levels of a band; a bucket has ``ARITY ** LEVELS`` nodes at its foot.
LEVELS = 8
BUCKET = ARITY**LEVELS
#: What marks a null in a leaf; other values begin with their length.
NULL = "-"
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of a text."""
    return F.sha2(text, 256)


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value with its length in bytes, so that no two rows read alike."""
    values = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.when(v.isNull(), F.lit(NULL)).otherwise(F.concat(F.octet_length(v), F.lit(":"), v)) for v in values)))


def tree_key(name: Column) -> Column:
    """A name that is never null, in the order of the names, null first."""
    return F.when(name.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), name.cast("string")))


def ranked(leaves: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 0, by ``key`` then ``digest``) and ``size`` inside each ``tree``.

    Rows are sorted by ranges of (tree, key, digest), written, and numbered in
    place; what lies before a range is summed over (range, tree). No tree has
    to fit in a task. Rows equal in all three can trade places without effect; a
    number of their own lets many of them be dealt to several ranges.
    """
    order = ["tree", "key", "digest", "tie"]
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())
    placed = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    placed = stored(placed.withColumn("at", F.monotonically_increasing_id()), "leaves").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        "tree", "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    return placed.join(shifts, ["tree", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift", "key")


def _parents(level: Column) -> Column:
    """Nodes above those of a level: each covers the intervals of its run."""

    def joined(i: Column) -> Column:
        run = F.slice(level, i * ARITY + 1, ARITY)
        return F.struct(
            F.element_at(run, 1)["lo"].alias("lo"),
            F.element_at(run, -1)["hi"].alias("hi"),
            digest(F.array_join(F.transform(run, lambda node: node["digest"]), "")).alias("digest"),
        )

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / ARITY).cast("int")), joined)


def _with_levels(buckets: DataFrame) -> DataFrame:
    """Adds ``level0`` to ``level<LEVELS>``; in the last bucket of a tree, levels above its one node stay empty."""
    node = "array<struct<lo:bigint,hi:bigint,digest:string>>"
    bare = F.transform("members", lambda m: F.struct(m["lo"].alias("lo"), m["hi"].alias("hi"), m["digest"].alias("digest")))
    out = buckets.withColumn("level0", bare)
    for i in range(LEVELS):
        below = F.col(f"level{i}")
        done = (F.size(below) == 0) | (F.col("last") & (F.size(below) <= 1))
        out = out.withColumn(f"level{i + 1}", F.when(done, F.array().cast(node)).otherwise(_parents(below)))
    return out


def _at_level(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n["lo"].alias("lo"), n["hi"].alias("hi"), n["digest"].alias("digest")))


def _top() -> Column:
    return F.coalesce(*(F.get(F.col(f"level{i}"), F.lit(0)) for i in range(LEVELS, -1, -1)))


def _step(i: int, place: Column, rank: Column) -> Column:
    """Siblings at level ``i`` of the member at ``place``, which covers ``rank``: its parent's interval without its own."""
    level, run = F.col(f"level{i}"), F.floor(place / ARITY ** (i + 1)).cast("int")
    parent = F.get(F.col(f"level{i + 1}"), run)
    children = F.filter(F.slice(level, run * ARITY + 1, ARITY), lambda c: (c["lo"] >= parent["lo"]) & (c["hi"] <= parent["hi"]))
    told = lambda kept: F.array_join(F.transform(F.filter(children, kept), lambda c: c["digest"]), "")
    return F.struct(told(lambda c: c["hi"] <= rank).alias("left"), told(lambda c: c["lo"] > rank).alias("right"))


def _path(place: Column, rank: Column) -> Column:
    """The steps of a member up to the top of its bucket."""
    steps = F.array(*(F.when(F.size(f"level{i + 1}") > 0, _step(i, place, rank)) for i in range(LEVELS)))
    return F.filter(steps, lambda s: s.isNotNull())


@dataclass(frozen=True)
class Forest:
    """Trees of one kind: their buckets per band, from the leaves up, and their roots."""

    bands: list[DataFrame]  # tree, bucket, last, members (lo, hi, digest and what leaves carry)
    tops: DataFrame  # tree, band, digest

    def nodes(self) -> DataFrame:
        """``tree, level, lo, hi, digest`` of every node: the manifest itself."""
        out = None
        for band, buckets in enumerate(self.bands):
            wide = _with_levels(buckets)
            # The foot of a band is the top of the one below.
            levels = [_at_level(F.col(f"level{i}"), band * LEVELS + i) for i in range(min(band, 1), LEVELS + 1)]
            whole = F.flatten(F.array(*levels))
            rows = wide.select("tree", F.explode(whole).alias("n")).select("tree", "n.level", "n.lo", "n.hi", "n.digest")
            out = rows if out is None else out.unionByName(rows)
        return out

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """The members of the lowest band with ``tree, path``: the siblings of every level up to the root.

        ``above`` (``tree, path``) goes on from each tree's root.
        """
        held = None
        for band in range(len(self.bands) - 1, -1, -1):
            buckets = self.bands[band]
            ends = self.tops.filter(F.col("band") == band).select("tree", F.lit(0).cast("long").alias("bucket"))
            rest = ends.join(above, "tree", "left") if above is not None else ends.withColumn("path", F.lit(None).cast(PATH))
            if held is not None:
                rest = rest.unionByName(held)
            whole = _with_levels(buckets).join(rest, ["tree", "bucket"], "left")
            upper = F.coalesce("path", F.array().cast(PATH))
            found = F.transform("members", lambda m, i: F.struct(m.alias("m"), F.concat(_path(i, m["lo"]), upper).alias("path")))
            rows = whole.select("tree", F.explode(found).alias("f")).select("tree", "f.m.*", "f.path")
            if band:
                # A member here is the top of a bucket of the band below.
                held = stored(rows.select("tree", F.floor(F.col("lo") / BUCKET**band).cast("long").alias("bucket"), "path"), "paths")
        return rows


def forest(leaves: DataFrame) -> Forest:
    """Trees over ``tree, key, digest`` and further columns, which the lowest members carry on.

    ``tree`` is never null. Leaves ascend by key, nulls first, then by digest.
    One number reaches the driver, the size of the largest tree.
    """
    rows = stored(ranked(leaves), "ranks")
    kept = [F.col(c) for c in rows.columns if c not in ("tree", "rank", "size", "digest")]
    largest = rows.agg(F.max("size").alias("n")).first()["n"] or 0
    nodes = rows.select("tree", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", *kept)
    bands, tops, band = [], [], 0
    while band == 0 or BUCKET**band < largest:
        members = F.array_sort(F.collect_list(F.struct(*(c for c in nodes.columns if c not in ("tree", "size")))))
        grouped = nodes.groupBy("tree", F.floor(F.col("lo") / BUCKET ** (band + 1)).cast("long").alias("bucket"))
        buckets = stored(grouped.agg(members.alias("members"), (F.max("size") <= BUCKET ** (band + 1)).alias("last"), F.max("size").alias("size")), "buckets")
        bands.append(buckets)
        topped = _with_levels(buckets).select("tree", "size", "last", _top().alias("t"))
        topped = stored(topped.select("tree", "size", "last", "t.lo", "t.hi", "t.digest"), "tops")
        tops.append(topped.filter("last").select("tree", F.lit(band).alias("band"), "digest"))
        nodes = topped.filter("not last").drop("last")
        band += 1
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return Forest(bands, out)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, start, lambda below, s: digest(F.concat(s["left"], below, s["right"])))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(documents: DataFrame, columns: Sequence[str], tampered: dict[str, Column] | None = None, key: str = "doc_id", tree: str = "lang") -> DataFrame:
    """``doc_id, leaf, subroot, root, path, folded_root, verified`` of every row.

    Rows of a ``tree`` value make a tree, the roots of these by value (null
    first) the tree above. ``tampered`` names changed values of columns: the
    changed row's leaf is folded with the siblings of the unchanged table, and
    ``verified`` tells whether that leads to the root.

    Nulls in any column have a mark of their own, so they differ from empty
    texts; a null key comes first, a null tree value is a tree; texts of any
    length are hashed whole; rows that repeat a key are ordered by their digest,
    and equal rows each are a leaf; no documents give no rows. Columns that
    are not named take no part.
    """
    original = {c: F.col(f"`{c}`") for c in columns}
    changed = original | (tampered or {})
    same = F.lit(True)
    for c in columns:
        same = same & changed[c].eqNullSafe(original[c])
    number = F.col(f"`{key}`").cast("long")
    low = forest(
        documents.select(
            tree_key(F.col(f"`{tree}`")).alias("tree"),
            number.alias("key"),
            leaf(list(original.values())).alias("digest"),
            number.alias("doc_id"),
            F.when(~same, leaf([changed[c] for c in columns])).alias("changed"),
        )
    )
    above = forest(low.tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.col("tree").alias("name")))
    # One row for each tree; whether it is sent to all tasks or dealt by tree is seen from its written size.
    over = stored(above.paths().select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")), "roots")
    root = above.tops.first()
    paths = low.paths(over.select("tree", "path")).join(over.select("tree", "subroot"), "tree")
    start = F.coalesce("changed", "digest")
    whole = paths.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root and root["digest"]).cast("string").alias("root"), "path",
        folded(start, F.col("path")).alias("folded_root"),
    )
    return whole.withColumn("verified", F.col("folded_root") == F.col("root"))
