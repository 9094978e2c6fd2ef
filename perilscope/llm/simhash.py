"""Near duplicates by SimHash fingerprints, searched in BK-trees.

A document's fingerprint has the majority of each bit over the hashes of its shingles. Documents
with equal fingerprints form a class. Two fingerprints that differ in at most ``radius`` of 64
bits agree in one of any ``radius + 1`` blocks of bits, so classes are dealt to shards by the
bits of a block: a pair to find has a shard in common. Each shard has a BK-tree, in which the
children of a node are keyed by their Hamming distance to it; a search goes down only the edges
that differ by at most the radius from the distance to the node. Trees of shards that are too
large for one are built of pieces, and each is broadcast to the classes of the other pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.llm.frames import (
    col_of, join_counted, materialise, small, staged, text_or_empty,
)
from perilscope.llm.graph import components

BITS = 64
#: Distances a node's children can have.
EDGES = BITS + 1


@dataclass(frozen=True)
class Rules:
    """Shingles of ``width`` words; fingerprints that differ in ``radius`` bits are linked.

    A piece of a shard has about ``piece`` classes. Where blocks of bits would give shards of
    more than ``expected`` classes on average, there are more blocks, of which more than one
    agrees. ``visits`` pairs of a query and a node are looked at at a time."""

    width: int = 4
    radius: int = 4
    seed: int = 42
    piece: int = 8192
    expected: int = 2048
    visits: int = 1 << 18
    #: Bytes of text whose words are held at a time.
    text: int = 1 << 20


def pieces_of_text(data: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, some ``size`` bytes at a time."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        while end < n and not data[end : end + 1].isspace():
            end += 1
        yield data[at:end].split()
        at = end


def shingle_hashes(data: bytes, rules: Rules) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a lower-cased text, repeats included, part by part.

    ``bytes.split`` splits at ASCII white space. A text of fewer words than ``width`` has one
    shingle of all its words, one without words has none.
    """
    seed, width, held, some = rules.seed, rules.width, [], False
    for words in pieces_of_text(data, rules.text):
        held = held + words
        if len(held) < width:
            continue
        some = True
        joined = b" ".join(held)
        ends = np.cumsum([len(w) + 1 for w in held])
        starts = np.concatenate([[0], ends[: len(held) - width]]).tolist()
        found = [
            xxhash.xxh64_intdigest(joined[s:e], seed)
            for s, e in zip(starts, (ends[width - 1 :] - 1).tolist())
        ]
        yield np.array(found, np.uint64)
        held = held[len(held) - width + 1 :] if width > 1 else []
    if held and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def fingerprint(text: str, rules: Rules = Rules()) -> int:
    """A bit is set if it is in more than half of the hashes. ``bytes.lower`` changes A to Z."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text.encode("utf-8", "surrogatepass").lower(), rules):
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)].astype("<u8")
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str, text: str, rules: Rules) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a long, of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), rules) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"]
            )

    id_type = docs.schema[id].dataType.simpleString()
    return docs.select(col_of(id).alias("id"), text_or_empty(text).alias("text")).mapInArrow(
        run, f"id {id_type}, fp bigint"
    )


def block_masks(count: int, rules: Rules) -> list[int]:
    """Masks of bits, as longs, of which one at least agrees for every pair to find.

    With ``radius + k`` blocks, k of them agree. k is the smallest number with which ``count``
    fingerprints give shards of the expected size.
    """
    for k in range(1, BITS // (rules.radius + 1) + 1):
        blocks = rules.radius + k
        if count >> (BITS // blocks * k) <= rules.expected:
            break
    bounds = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(bounds, bounds[1:])]
    chosen = [sum(c) for c in combinations(masks, k)]
    assert len(chosen) == comb(blocks, k)
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def packs(classes: DataFrame, count: int, rules: Rules) -> DataFrame:
    """The shards with more than one class, in pieces: ``shard`` (the number of a mask),
    ``value`` (its bits), ``pieces``, ``piece``, and ``fps``, the classes, in order."""
    masks = block_masks(count, rules)
    shards = F.array(
        *[
            F.struct(F.lit(i).alias("shard"), F.col("fp").bitwiseAND(F.lit(m)).alias("value"))
            for i, m in enumerate(masks)
        ]
    )
    rows = classes.select("fp", F.explode(shards).alias("x")).select("x.shard", "x.value", "fp")
    large = materialise(
        rows.groupBy("shard", "value").agg(F.count("*").alias("n"))
        .where(F.col("n") > rules.piece)
        .select("shard", "value", F.ceil(F.col("n") / rules.piece).cast("int").alias("split"), "n")
    )
    if large.isEmpty():
        dealt = rows.withColumn("pieces", F.lit(1)).withColumn("piece", F.lit(0))
    else:
        met = join_counted(rows, large, ["shard", "value"], "n")
        dealt = met.withColumn("pieces", F.coalesce("split", F.lit(1))).withColumn(
            "piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
        )
    grouped = dealt.groupBy("shard", "value", "pieces", "piece").agg(
        F.sort_array(F.collect_list("fp")).alias("fps")
    )
    return grouped.where((F.size("fps") > 1) | (F.col("pieces") > 1))


def grown(fps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of groups of different fingerprints, that of group ``i`` from ``first[i]`` on:
    the parent of each node and its distance to it.

    All groups grow together. The first of a group is the root; of the nodes that go down the
    same edge the first one becomes the child, and the others go on from there.
    """
    parent, edge = np.full(len(fps), -1, np.int64), np.zeros(len(fps), np.int64)
    at = np.repeat(first[:-1], np.diff(first))
    open_ = np.setdiff1d(np.arange(len(fps)), first[:-1], assume_unique=True)
    while len(open_):
        apart = np.bitwise_count(fps[open_] ^ fps[at[open_]]).astype(np.int64)
        key, place, child = np.unique(at[open_] * EDGES + apart, return_index=True, return_inverse=True)
        head = open_[place]
        parent[head], edge[head] = key // EDGES, key % EDGES
        at[open_] = head[child]
        rest = np.ones(len(open_), bool)
        rest[place] = False
        open_ = open_[rest]
    return parent, edge


def found_links(
    queries: np.ndarray, roots: np.ndarray, fps: np.ndarray, parent: np.ndarray, edge: np.ndarray,
    rules: Rules,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the queries and the nodes within the radius, query ``i`` from ``roots[i]`` on.

    Pairs of a query and a node wait on a stack; of the children of a node those on edges within
    the radius of its distance to the query are put there.
    """
    inner = np.flatnonzero(parent >= 0)
    key = parent[inner] * EDGES + edge[inner]
    order = np.argsort(key, kind="stable")
    key, child = key[order], inner[order]
    waiting = [
        (np.arange(s, min(s + rules.visits, len(queries))), roots[s : s + rules.visits])
        for s in range(0, len(queries), rules.visits)
    ]
    while waiting:
        q, node = waiting.pop()
        if len(q) > rules.visits:
            waiting.append((q[rules.visits :], node[rules.visits :]))
            q, node = q[: rules.visits], node[: rules.visits]
        apart = np.bitwise_count(queries[q] ^ fps[node]).astype(np.int64)
        hit = apart <= rules.radius
        yield q[hit], node[hit]
        low = np.searchsorted(key, node * EDGES + np.maximum(apart - rules.radius, 0))
        high = np.searchsorted(key, node * EDGES + np.minimum(apart + rules.radius, BITS), "right")
        n = high - low
        if n.any():
            again = np.repeat(np.arange(len(q)), n)
            place = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n) + low[again]
            waiting.append((q[again], child[place]))


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the links ``a``, ``b`` connect the least of their labels, in place."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels[:] = further


TREE = "array<bigint>, parent array<int>, edge array<int>"


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each list begins."""
    column = column.cast(pa.large_list(column.type.value_type))
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def trees(packed: DataFrame) -> DataFrame:
    """The packs with the BK-tree of each, its nodes numbered from 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, len(b), 512)):
            values, first = flat(batch.column("fps"))
            parent, edge = grown(values.view(np.uint64), first)
            start = np.repeat(first[:-1], np.diff(first))
            parent = np.where(parent < 0, -1, parent - start)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], lists(values, first, pa.int64()),
                 lists(parent, first, pa.int32()), lists(edge, first, pa.int32())],
                ["shard", "value", "pieces", "piece", "fps", "parent", "edge"],
            )

    return packed.select("shard", "value", "pieces", "piece", "fps").mapInArrow(
        run, f"shard int, value bigint, pieces int, piece int, fps {TREE}"
    )


def links(searches: DataFrame, rules: Rules) -> DataFrame:
    """``a`` and ``b``: links that connect all that is linked in each row of ``searches``, no
    more than a row has classes. A row has ``queries`` and a tree: ``fps``, ``parent``, ``edge``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, len(b), 512)):
            asked, first = flat(batch.column("queries"))
            nodes, start = flat(batch.column("fps"))
            parent, edge = flat(batch.column("parent"))[0], flat(batch.column("edge"))[0]
            shift = np.repeat(start[:-1], np.diff(start))
            parent = np.where(parent < 0, -1, parent + shift).astype(np.int64)
            roots = np.repeat(start[:-1], np.diff(first))
            queries, fps = asked.view(np.uint64), nodes.view(np.uint64)
            labels = np.arange(len(nodes) + len(asked))
            # a query that is a node of its tree is that node
            for q, node in found_links(queries, roots, fps, parent, edge.astype(np.int64), rules):
                joined(labels, q + len(nodes), node)
            both = np.concatenate([nodes, asked])
            a, b = both, both[labels]
            pair = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)])[a != b], axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"]
            )

    return searches.select("queries", "fps", "parent", "edge").mapInArrow(run, "a bigint, b bigint")


def linked(classes: DataFrame, rules: Rules) -> DataFrame:
    """Links ``a``, ``b`` of the fingerprints ``fp``, which connect all that are within the
    radius, directly or by others."""
    built = staged(trees(packs(classes, classes.count(), rules)))
    within = built.select(F.col("fps").alias("queries"), "fps", "parent", "edge")
    found = links(within, rules)
    parts = built.where("pieces > 1")
    if not parts.isEmpty():
        ask = parts.select(
            "shard", "value", F.col("piece").alias("asking"), F.col("fps").alias("queries")
        )
        held = small(parts, 16 * rules.piece)
        across = ask.join(F.broadcast(parts) if held else parts, ["shard", "value"]).where("asking < piece")
        found = found.union(links(across, rules))
    return found.distinct()


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """``id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of each row.

    Words are split at ASCII white space after A to Z are lower-cased. A text without words, or
    null, has the fingerprint zero, which is linked like any other. ``component_id`` is the
    smallest id of the rows reachable by links, the row itself included; a null id counts as
    larger than any, and stays where no other is reached. Repeated rows each keep their row.
    """
    base = materialise(fingerprints(docs, id, text, rules))
    per_class = materialise(
        base.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    )
    found = materialise(linked(per_class.select("fp"), rules))
    if found.isEmpty():
        named = per_class.where("rows > 1").select("fp", F.col("least").alias("component"), "rows")
    else:
        roots = components(found).withColumnRenamed("node", "fp")
        rooted = materialise(per_class.join(roots, "fp", "left"))
        within = rooted.where("root is not null")
        least = within.groupBy("root").agg(F.min("least").alias("component"))
        named = within.join(least, "root").select("fp", "component", "rows").union(
            rooted.where("root is null and rows > 1").select("fp", F.col("least").alias("component"), "rows")
        )
    named = materialise(named.withColumn("grouped", F.lit(True)))
    out = join_counted(base, named, ["fp"], "rows")
    component: Column = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
    )
