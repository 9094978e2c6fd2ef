"""Merkle manifest of a dataset: a digest for all rows, and a proof for each.

Each row is a leaf, the digest of its fields. The leaves of a tree are numbered by their ids;
each run of ``fanout`` consecutive nodes becomes a node of the next level, until one is left.
The roots of all trees, in the order of their names, are the leaves of one last tree.

A level is a slot pivot: rows are grouped by the number of their parent, and conditional
aggregates spread its children over one column for each slot. The columns concatenated and
hashed are the parent; without its own slot's column they are the siblings of a child. A block
of leaves that have their ancestor ``levels`` levels above in common is dealt to one task, where
all these levels are worked on after one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilscope.llm.frames import col_of, materialise, small

#: Hexadecimal digits of a digest.
DIGITS = 64
PATH = "array<struct<slot: int, siblings: string>>"


@dataclass(frozen=True)
class Rules:
    """Nodes have ``fanout`` children; ``levels`` of them are worked on after one shuffle, so
    that a block has ``fanout ** levels`` leaves."""

    fanout: int = 2
    levels: int = 7


def digest(*inputs: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the inputs' UTF-8 bytes, concatenated."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it goes into a leaf: its number of bytes, a colon, its text; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")
    )


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def tree_key(name: Column) -> Column:
    """A text for the name of a tree, never null, that sorts as the names do, null first."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``at``, their number in the order of their ``tree``, and its ``size``.

    Rows are sorted by ranges over all trees, so that a tree of any size is spread over the
    tasks. A row's number is its place in its range and the rows of its tree in the ranges
    before; what is counted has a row for each range and tree that meet.
    """
    keys = ["tree", *order]
    # rows that are equal in all keys are spread as well; which is first makes no difference
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    sorted_ = (
        salted.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "salt")
        .drop("salt").withColumn("place", F.monotonically_increasing_id())
    )
    placed = materialise(sorted_.withColumn("range", F.shiftright("place", 33)))
    counted = placed.groupBy("tree", "range").agg(
        F.min("place").alias("first"), F.count("*").alias("n")
    )
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    starts = materialise(
        counted.select(
            "tree", "range", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"),
            F.sum("n").over(Window.partitionBy("tree")).alias("size"),
        )
    )
    starts = F.broadcast(starts) if small(starts, 128) else starts
    return placed.join(starts, ["tree", "range"]).select(
        *rows.columns, (F.col("place") + F.col("shift")).alias("at"), "size"
    )


def pivoted(rows: DataFrame, rules: Rules) -> DataFrame:
    """One level up: ``rows`` have ``tree``, ``block``, ``at``, ``size``, ``digest`` and
    ``below``, the rows of a block that are below them with their paths so far."""
    slot = F.col("at") % rules.fanout
    parents = rows.groupBy(
        "tree", "block", F.expr(f"at div {rules.fanout}").alias("at"), F.col("size").alias("nodes")
    ).agg(
        *[
            F.first(F.when(slot == s, F.struct("digest", "below")), ignorenulls=True).alias(f"slot{s}")
            for s in range(rules.fanout)
        ]
    )
    digests = [F.coalesce(F.col(f"slot{s}")["digest"], F.lit("")) for s in range(rules.fanout)]
    grows = F.col("nodes") > 1  # a single node is the root already

    def below(s: int) -> Column:
        siblings = F.concat(F.lit(""), *[d for i, d in enumerate(digests) if i != s])
        step = F.array(F.struct(F.lit(s).alias("slot"), siblings.alias("siblings")))
        return F.coalesce(
            F.transform(
                F.col(f"slot{s}")["below"],
                lambda x: F.struct(
                    x["row"].alias("row"),
                    F.when(grows, F.concat(x["path"], step)).otherwise(x["path"]).alias("path"),
                ),
            ),
            F.array(),
        )

    return parents.select(
        "tree", "block", "at",
        F.expr(f"(nodes + {rules.fanout - 1}) div {rules.fanout}").alias("size"),
        F.when(grows, digest(*digests)).otherwise(digests[0]).alias("digest"),
        F.concat(*[below(s) for s in range(rules.fanout)]).alias("below"),
    )


def climbed(nodes: DataFrame, rules: Rules) -> DataFrame:
    """``tree``, ``root``, ``row`` and ``path`` for each of the ``nodes``, which have ``tree``,
    ``at``, ``size``, ``digest`` and ``row``. The path has the node's slot and the siblings on
    each level, from below."""
    own = F.struct(F.col("row"), F.array().cast(PATH).alias("path"))
    block = F.expr(f"at div {rules.fanout**rules.levels}")
    rows = nodes.select(
        "tree", block.alias("block"), "at", "size", "digest", F.array(own).alias("below")
    ).repartition("tree", "block")
    for _ in range(rules.levels):
        rows = pivoted(rows, rules)
    blocks = materialise(rows.drop("block"))
    if (blocks.agg(F.max("size")).first()[0] or 1) == 1:
        whole = blocks.select("tree", F.col("digest").alias("root"), F.explode("below").alias("x"))
        return whole.select("tree", "root", "x.row", "x.path")
    above = climbed(
        blocks.select("tree", "at", "size", "digest", F.col("at").alias("row")), rules
    ).select("tree", "root", F.col("row").alias("at"), F.col("path").alias("above"))
    whole = blocks.join(above, ["tree", "at"]).select("tree", "root", "above", F.explode("below").alias("x"))
    return whole.select("tree", "root", "x.row", F.concat("x.path", "above").alias("path"))


def folded(own: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""

    def step(node: Column, p: Column) -> Column:
        left = p["slot"] * DIGITS
        return digest(
            F.substring(p["siblings"], F.lit(1), left), node,
            F.substring(p["siblings"], left + 1, F.length(p["siblings"])),
        )

    return F.aggregate(path, own, step)


def siblings(path: Column) -> Column:
    """All siblings on a path, from below, as one text."""
    return F.array_join(F.transform(path, lambda p: p["siblings"]), "")


def manifest(
    docs: DataFrame,
    id: str = "doc_id",
    tree: str = "lang",
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    more: Sequence[Column] = (),
    rules: Rules = Rules(),
) -> DataFrame:
    """``id``, ``leaf``, ``subroot`` (the root of the row's tree), ``root`` and ``path`` of each
    row, and the columns ``more``, which are worked out on the rows of ``docs``.

    A leaf is the digest of the ``fields``; other columns take no part. Rows without a value of
    ``tree`` are a tree of their own, the first. Within a tree rows ascend by id, null first,
    then by leaf, so that the order of equal rows makes no difference; each has its own path. An
    empty text is not null: its field is ``0:``. An empty table has no root and gives no rows.
    """
    given = docs.select(
        col_of(id).alias("id"), leaf([col_of(f) for f in fields]).alias("digest"),
        tree_key(col_of(tree)).alias("tree"), F.struct(F.lit(0).alias("none"), *more).alias("more"),
    )
    leaves = numbered(materialise(given), ["id", "digest"])
    rows = climbed(
        leaves.select("tree", "at", "size", "digest", F.struct("id", "digest", "more").alias("row")),
        rules,
    )
    rows = materialise(rows)
    subroots = rows.groupBy("tree").agg(F.first("root").alias("digest"))
    named = numbered(
        subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]
    )
    top = climbed(
        named.select("tree", "at", "size", "digest", F.col("name").alias("row")), rules
    ).select(F.col("row").alias("tree"), F.col("root").alias("top"), F.col("path").alias("above"))
    top = materialise(top)
    top = F.broadcast(top) if small(top, 4096) else top
    names = [n for n in given.schema["more"].dataType.names if n != "none"]
    return rows.join(top, "tree").select(
        F.col("row.id").alias(id), F.col("row.digest").alias("leaf"), F.col("root").alias("subroot"),
        F.col("top").alias("root"), F.concat("path", "above").alias("path"),
        *[F.col(f"row.more.{n}").alias(n) for n in names],
    )
