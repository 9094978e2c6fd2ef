"""Near duplicates by an LSH forest over MinHash signatures.

Texts with equal sets of shingles form a class, which takes part once. A signature is cut into
trees, each a sequence of hash values by which the classes are sorted; classes with a long
common prefix are neighbours in that order. A region of the order, the classes that agree in
the first values, is compared pair by pair where it is small. Where it is large it is cut at
the next value, as deep as it takes, and only neighbours are compared across the cuts; families
of candidates that are not connected after that are compared whole, large ones piece by piece.
What is linked is decided on the whole sets, and components are those of the links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.llm.frames import (
    col_of, cols_of, fresh, join_counted, materialise, same, small, staged, text_or_empty,
)
from perilscope.llm.graph import components
from perilscope.llm.words import mix, multipliers, parts, shingles, words


@dataclass(frozen=True)
class Rules:
    """``percent`` of the union of two sets must be shared, of shingles of ``width`` words.

    A pair at that limit agrees in ``min_depth`` values of one of ``trees`` trees with a
    probability of 1 - (1 - 0.8 ** 3) ** 16, which is 0.99999. A region of more than
    ``region`` classes is cut deeper, up to ``depth`` values. ``agree`` of the 32 values of
    the short code must be equal, which a pair at the limit misses once in 20,000 times.
    """

    width: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 8
    min_depth: int = 3
    region: int = 24
    near: int = 6
    agree: int = 16
    #: Trees whose neighbours are verified first.
    first_trees: int = 4
    #: Regions with more than one in so many of all rows are dealt to several tasks.
    share: int = 10_000
    #: Of families of more than ``region`` classes that are not yet connected, all pairs are
    #: compared in groups of so many classes and shingles at most.
    group: int = 4_000
    group_shingles: int = 4_000_000
    #: Families larger than that are first compared by the prefixes of so many trees, so that
    #: few parts are left to compare piece by piece.
    group_trees: int = 6


CODE = 32
#: Rows of one region that are held at a time.
HELD = 50_000


def uid(id: str, text: str) -> Column:
    """128 bits for a document; documents with the same id or none are told apart by their texts."""
    named = col_of(id).cast("string")
    own = F.coalesce(F.concat(F.lit("="), F.octet_length(named).cast("string"), F.lit(":"), named), F.lit("-"))
    return F.unhex(F.md5(F.concat(own, text_or_empty(text)).cast("binary")))


def sets_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where each text's begin."""
    grams, first = shingles(words(texts, lower=True), width)
    each = []
    for lo, hi in zip(first[:-1], first[1:]):
        own = np.sort(grams[lo:hi])
        each.append(own[np.concatenate([[True], own[1:] > own[:-1]])] if len(own) else own)
    sizes = np.array([len(e) for e in each], np.int64)
    return (
        np.concatenate(each) if each else grams, np.concatenate([[0], np.cumsum(sizes)])
    )


def nodes_of(values: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for each set, null for the empty one."""
    out: list[bytes | None] = []
    a, b = mix(values), mix(values ^ np.uint64(0x5851F42D4C957F2D))
    for lo, hi in zip(first[:-1], first[1:]):
        both = np.array([a[lo:hi].sum(dtype=np.uint64), b[lo:hi].sum(dtype=np.uint64)])
        out.append(mix(both + np.uint64(hi - lo)).astype(">u8").tobytes() if hi > lo else None)
    return out


def signatures(values: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """``count`` minimum hashes of 16 bits for each set that is not empty."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(full), count), np.uint16)
    factors = multipliers(2 * count, 41).astype(np.uint32) | np.uint32(1)
    # as many sets at a time as the processor's cache holds
    at = 0
    while at < len(full):
        end = max(int(np.searchsorted(first[full], first[full[at]] + 100_000)), at + 1)
        lo, hi = first[full[at]], first[full[end - 1] + 1]
        low = values[lo:hi].astype(np.uint32)
        high = (values[lo:hi] >> np.uint64(32)).astype(np.uint32)
        starts = first[full[at:end]] - lo
        for i in range(count):
            hashed = low * factors[2 * i] + high * factors[2 * i + 1]
            least = np.minimum.reduceat(hashed, starts)
            out[at:end, i] = (mix(least.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        at = end
    return out


def sketch(docs: DataFrame, id: str, text: str, rules: Rules) -> DataFrame:
    """``id``, ``uid``, ``n_shingles``, ``node``, ``signature`` and ``code`` of each document."""
    count = rules.trees * rules.depth

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 2)):
            values, first = sets_of(batch.column(2), rules.width)
            marks = signatures(values, first, count)
            # the code takes a byte of values from all over the signature
            codes = (marks[:, :: max(count // CODE, 1)][:, :CODE] & 0xFF).astype(np.uint8)
            n = np.diff(first)
            whole, short = [None] * len(n), [None] * len(n)
            for row, at in enumerate(np.flatnonzero(n > 0)):
                whole[at] = marks[row].astype(">u2").tobytes()
                short[at] = codes[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(nodes_of(values, first), pa.binary()),
                 pa.array(whole, pa.binary()), pa.array(short, pa.binary())],
                ["id", "uid", "n_shingles", "node", "signature", "code"],
            )

    id_type = docs.schema[id].dataType.simpleString()
    return docs.select(
        col_of(id).alias("id"), uid(id, text).alias("uid"), text_or_empty(text).alias("text")
    ).mapInArrow(
        run,
        f"id {id_type}, uid binary, n_shingles bigint, node binary, signature binary, code binary",
    )


def forest(classes: DataFrame, rules: Rules) -> DataFrame:
    """A row for each class and tree: ``tree``, ``path``, ``deal``, ``node``, ``code``, ``n``.

    ``deal`` is the prefix by which rows go to tasks. Prefixes that hold a large share of all
    rows are made longer, and split at last; there are at most ``share`` of them.
    """
    size = 2 * rules.depth
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(rules.trees - 1)),
        lambda t: F.struct(
            t.alias("tree"), F.substring(F.col("signature"), t * size + 1, F.lit(size)).alias("path")
        ),
    )
    rows = classes.select(F.explode(trees).alias("x"), "node", "code", "n").select(
        "x.tree", "x.path", "node", "code", "n"
    )
    rows = rows.withColumn("deal", F.substring("path", 1, 2 * rules.min_depth))
    total = classes.count() * rules.trees
    for depth in (rules.min_depth + 2, rules.depth, rules.depth + 1):
        heavy = (
            rows.groupBy("tree", "deal").agg(F.count("*").alias("rows"))
            .where(F.col("rows") > max(HELD // 10, total // rules.share))
        )
        heavy = materialise(heavy)
        if heavy.isEmpty():
            return rows
        longer = F.substring("path", 1, 2 * depth)
        if depth > rules.depth:
            # equal in the whole path: dealt by the code, where close ones are still together
            some = F.ceil(F.log2(F.col("rows") / (HELD // 10))).cast("int")
            pieces = F.call_function("shiftleft", F.lit(1), some)
            longer = F.concat(
                F.col("path"),
                F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(F.substring("code", 1, 8)), pieces)), 8, "0")),
            )
        # by names: a checkpoint keeps the columns it is made of, so a reference to one is ambiguous
        rows = rows.join(F.broadcast(heavy), ["tree", "deal"], "left").select(
            "tree", "path", "node", "code", "n",
            F.when(F.col("rows").isNotNull(), longer).otherwise(F.col("deal")).alias("deal"),
        )
    return rows


def region_pairs(paths: np.ndarray, depth: int, rules: Rules) -> Iterator[tuple[int, int]]:
    """Places of the rows to compare among rows in the order of their paths."""
    m = len(paths)
    if m <= rules.region:
        yield from ((i, j) for i in range(m) for j in range(i + 1, m))
        return
    # neighbours share the longest prefixes, whatever is cut between them
    for step in range(1, rules.near + 1):
        yield from ((i, i + step) for i in range(m - step))
    if depth < rules.depth:
        value = paths[:, 2 * depth].astype(np.int64) << 8 | paths[:, 2 * depth + 1]
        cuts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [m]])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 1:
                for i, j in region_pairs(paths[lo:hi], depth + 1, rules):
                    yield int(lo) + i, int(lo) + j


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def candidates(rows: DataFrame, rules: Rules) -> DataFrame:
    """Pairs ``a < b`` of nodes to compare, each once, with the first tree that has it."""
    ordered = (
        rows.repartition("tree", "deal")
        .sortWithinPartitions("tree", "path", "code", "node")
        .select("tree", "path", "code", "n", "node")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            paths = fixed(table["path"], 2 * rules.depth)
            codes = fixed(table["code"], CODE)
            tree, n = table["tree"].to_numpy(), table["n"].to_numpy()
            key = np.column_stack([tree.astype(np.uint8), paths[:, : 2 * rules.min_depth]])
            new = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            cuts = np.concatenate([[0], new, [len(key)]])
            left, right = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo > 1:
                    for i, j in region_pairs(paths[lo:hi], rules.min_depth, rules):
                        left.append(lo + i)
                        right.append(lo + j)
            i, j = np.array(left, np.int64), np.array(right, np.int64)
            pair = np.unique(i * len(key) + j) if len(i) else i
            i, j = pair // max(len(key), 1), pair % max(len(key), 1)
            # sets of too different sizes share too little of their union
            fit = 100 * np.minimum(n[i], n[j]) >= rules.percent * np.maximum(n[i], n[j])
            i, j = i[fit], j[fit]
            alike = np.concatenate(
                [(codes[i[s : s + HELD]] == codes[j[s : s + HELD]]).sum(1) for s in range(0, len(i), HELD)]
                or [np.zeros(0, np.int64)]
            )
            i, j = i[alike >= rules.agree], j[alike >= rules.agree]
            near = np.where(j == i + 1, tree[i], rules.trees)
            nodes = table["node"].to_pylist()
            ends = [sorted((nodes[x], nodes[y])) for x, y in zip(i, j)]
            return pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in ends], pa.binary()), pa.array([e[1] for e in ends], pa.binary()),
                 pa.array(near, pa.int32())],
                ["a", "b", "near"],
            )

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) >= HELD:
                # the last region may go on; a larger one than can be held is cut in its order
                last = held["path"][len(held) - 1].as_py()[: 2 * rules.min_depth]
                at = len(held)
                while at > 0 and held["path"][at - 1].as_py()[: 2 * rules.min_depth] == last:
                    at -= 1
                at = at or len(held)
                yield pairs(held.slice(0, at))
                held = held.slice(at)
        if held is not None and len(held):
            yield pairs(held)

    found = ordered.mapInArrow(run, "a binary, b binary, near int")
    return found.groupBy("a", "b").agg(F.min("near").alias("near"))


def whole_sets(docs: DataFrame, wanted: DataFrame, id: str, text: str, rules: Rules) -> DataFrame:
    """``node`` and its ``values``, the sorted shingles, for the classes ``wanted``: one
    document of each, found by its ``uid``."""
    given = docs.select(uid(id, text).alias("uid"), text_or_empty(text).alias("text"))
    ids = wanted.select("uid").distinct()
    ids = F.broadcast(ids) if small(ids, 32) else ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 0)):
            values, first = sets_of(batch.column(0), rules.width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes_of(values, first), pa.binary()),
                 pa.array([values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                ["node", "values"],
            )

    texts = given.join(ids, "uid", "left_semi").select("text")
    return texts.mapInArrow(run, "node binary, values binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """The pairs ``a``, ``b`` that share enough of their whole sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                p, q = (p, q) if len(p) >= len(q) else (q, p)
                at = np.searchsorted(p, q)
                shared = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                keep.append(100 * shared >= rules.percent * (len(p) + len(q) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    of_a = sets.select(F.col("node").alias("a"), F.col("values").alias("va"))
    of_b = sets.select(F.col("node").alias("b"), F.col("values").alias("vb"))
    joined = pairs.select("a", "b").join(of_a, "a").join(of_b, "b").select("a", "b", "va", "vb")
    return joined.mapInArrow(run, "a binary, b binary")


def links_within(
    nodes: list[bytes], parts: list[bytes], sets: list[np.ndarray], percent: int
) -> Iterator[tuple[bytes, bytes]]:
    """Links between the classes of a group that connect all of their ``parts`` that are linked.

    Every set that is not of the most frequent part is counted against all others, by lists of
    the sets that hold a shingle: the counts are the sizes of the intersections.
    """
    number = {p: i for i, p in enumerate(dict.fromkeys(parts))}
    part = np.array([number[p] for p in parts])
    size = np.array([len(v) for v in sets])
    first = np.concatenate([[0], np.cumsum(size)])
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(place, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(values)))])
    for i in np.flatnonzero(part != np.bincount(part).argmax()):
        own = place[first[i] : first[i + 1]]
        holders = np.concatenate([owner[begin[v] : begin[v + 1]] for v in own])
        shared = np.bincount(holders, minlength=len(sets))
        linked = 100 * shared >= percent * (size[i] + size - shared)
        linked &= part != part[i]
        others, one = np.unique(part[linked], return_index=True)
        for j in np.flatnonzero(linked)[one]:
            yield (nodes[i], nodes[j]) if nodes[i] < nodes[j] else (nodes[j], nodes[i])
        # from now on they are one part
        part[np.isin(part, others)] = part[i]


def open_families(
    pairs: DataFrame, roots: DataFrame | None, sets: DataFrame, rules: Rules
) -> DataFrame:
    """The classes of families of more than ``rules.region`` classes that are not connected yet:
    ``family``, ``whole`` (whether it fits a group), ``node``, ``part``, ``size``. In the forest,
    their regions were cut. A family is a component of neighbours in the first trees."""
    family = joined_roots(roots, pairs.where(F.col("near") < rules.first_trees).select("a", "b"))
    sizes = sets.select("node", (F.octet_length("values") / 8).cast("bigint").alias("size"))
    if family is None:
        family = sizes.select("node", F.col("node").alias("root"))
    rooted = family.withColumnRenamed("root", "family")
    if roots is not None:
        rooted = rooted.join(roots.withColumnRenamed("root", "part"), "node", "left")
    else:
        rooted = rooted.withColumn("part", F.lit(None).cast("binary"))
    rooted = staged(
        rooted.withColumn("part", F.coalesce("part", "node")).join(sizes, "node")
    )
    stats = rooted.groupBy("family").agg(
        F.count("*").alias("n"), F.count_distinct("part").alias("parts"),
        F.sum("size").alias("shingles"),
    )
    fits = (F.col("n") <= rules.group) & (F.col("shingles") <= rules.group_shingles)
    some = materialise(
        stats.where((F.col("n") > rules.region) & (F.col("parts") > 1))
        .select("family", "n", fits.alias("whole"))
    )
    rows = join_counted(rooted, some, ["family"], "n").where("whole is not null")
    return staged(rows.select("family", "whole", "node", "part", "size"))


def dense_links(
    rows: DataFrame, sets: DataFrame, classes: DataFrame, rules: Rules
) -> DataFrame:
    """Links that connect parts of the families ``rows``: ``family``, ``whole``, ``node``,
    ``part`` and ``size``. A whole family is compared as one group, which finds all of them; a
    larger one in groups that agree in the first values of a tree, as few as make the groups fit,
    for several trees, which leaves some to ``links_between_pieces``."""
    empty = F.lit(b"")
    dealt = rows.where("whole").select(
        "family", F.lit(-1).alias("tree"), empty.alias("deal"), "node", "part", "size"
    )
    if not rows.where("not whole").isEmpty():
        dealt = dealt.union(large_families(rows.where("not whole"), classes, rules))
    return links_of_groups(dealt, sets, rules)


def links_of_groups(dealt: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """The links that connect parts of each group of ``family``, ``tree`` and ``deal``."""
    ordered = (
        dealt.join(sets, "node").repartition("family", "tree", "deal")
        .sortWithinPartitions("family", "tree", "deal", "node")
        .select("family", "tree", "deal", "node", "part", "values")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, [], [], [])

        def links_of() -> pa.RecordBatch:
            out = list(links_within(*held[1:], rules.percent)) if len(held[1]) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"]
            )

        for batch in batches:
            for *key, node, part, values in zip(*(c.to_pylist() for c in batch.columns)):
                if key != held[0]:
                    yield links_of()
                    held = (key, [], [], [])
                held[1].append(node)
                held[2].append(part)
                held[3].append(np.frombuffer(values, np.uint64))
        yield links_of()

    return ordered.mapInArrow(run, "a binary, b binary").distinct()


def large_families(rows: DataFrame, classes: DataFrame, rules: Rules) -> DataFrame:
    """``rows`` of families too large for a group, dealt by prefixes of ``group_trees`` trees. A
    prefix that still holds too many at full depth is split by the nodes."""
    size = 2 * rules.depth
    trees = F.transform(
        F.sequence(F.lit(0), F.lit(rules.group_trees - 1)),
        lambda t: F.struct(
            t.alias("tree"), F.substring(F.col("signature"), t * size + 1, F.lit(size)).alias("path")
        ),
    )
    signed = rows.join(classes.select("node", "signature"), "node")
    dealt = signed.select("family", F.explode(trees).alias("x"), "node", "part", "size").select(
        "family", "x.tree", "x.path", F.substring("x.path", 1, 2).alias("deal"), "node", "part", "size"
    )
    keys = ["family", "tree", "deal"]
    for depth in range(2, rules.depth + 2):
        dealt = staged(dealt)
        heavy = dealt.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").alias("w"))
        over = F.greatest(F.col("n") / rules.group, F.col("w") / rules.group_shingles)
        heavy = materialise(
            heavy.where(over > 1).select(*keys, "n", F.ceil(2 * over).alias("pieces"))
        )
        if heavy.isEmpty():
            break
        longer = F.substring("path", 1, 2 * depth)
        if depth > rules.depth:
            piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("string")
            longer = F.concat("path", F.encode(piece, "utf-8"))
        dealt = join_counted(dealt, heavy, keys, "n").select(
            "family", "tree", "path",
            F.when(F.col("pieces").isNotNull(), longer).otherwise(F.col("deal")).alias("deal"),
            "node", "part", "size",
        )
    return dealt.select("family", "tree", "deal", "node", "part", "size")


def links_between_pieces(
    rows: DataFrame, roots: DataFrame | None, sets: DataFrame, rules: Rules
) -> DataFrame | None:
    """All links that connect parts of the families ``rows``, which are too large for a group;
    None if each is one part by ``roots``.

    The classes of a family are dealt by their nodes to pieces of half a group, and each two
    pieces are compared as one group. The most frequent part has pieces of its own, which are not
    compared with each other: where the others fit one piece, every class of that part is read
    once, and the others once for each of its pieces.
    """
    if roots is not None:
        rows = rows.drop("part").join(roots.withColumnRenamed("root", "part"), "node", "left")
    rows = staged(
        rows.select("family", F.coalesce("part", "node").alias("part"), "node", "size")
    )
    per_part = rows.groupBy("family", "part").agg(
        F.count("*").alias("n"), F.sum("size").alias("w")
    )
    stats = per_part.groupBy("family").agg(
        F.max(F.struct("n", "w", "part")).alias("main"), F.sum("n").alias("n"),
        F.sum("w").alias("w"), F.count("*").alias("parts"),
    )

    def pieces(n: Column, w: Column) -> Column:
        return F.ceil(2 * F.greatest(n / rules.group, w / rules.group_shingles)).cast("int")

    some = materialise(
        stats.where("parts > 1").select(
            "family", "n", F.col("main.part").alias("main"),
            pieces(F.col("main.n"), F.col("main.w")).alias("of_main"),
            pieces(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("of_others"),
        )
    )
    if some.isEmpty():
        return None
    met = join_counted(rows, some, ["family"], "n").where("main is not null")
    # pieces of the others are numbered first
    own = F.when(
        F.col("part") == F.col("main"),
        F.col("of_others") + F.pmod(F.xxhash64("node"), F.col("of_main")),
    ).otherwise(F.pmod(F.xxhash64("node"), F.col("of_others"))).cast("int")
    last = F.when(F.col("part") == F.col("main"), F.col("of_others")).otherwise(
        F.col("of_others") + F.col("of_main")
    )
    others = F.filter(F.sequence(F.lit(0), last - 1), lambda i: i != F.col("own"))
    dealt = met.withColumn("own", own).select("family", "node", "part", "own", F.explode(others).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return links_of_groups(
        dealt.select("family", low.alias("tree"), high.alias("deal"), "node", "part"), sets, rules
    )


def joined_roots(roots: DataFrame | None, more: DataFrame) -> DataFrame | None:
    """Components ``node`` and ``root`` after further links, which are few: the graph of the
    components that they connect is solved on its own."""
    if more.isEmpty():
        return roots
    if roots is None:
        return components(more)
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = more.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")
    )
    merged = components(between).select(F.col("node").alias("old"), F.col("root").alias("new"))
    known = roots.select("node", F.col("root").alias("old"))
    alone = merged.join(roots, F.col("old") == F.col("node"), "left_anti").select(
        F.col("old").alias("node"), "old"
    )
    renamed = known.union(alone).join(merged, "old", "left")
    return staged(renamed.select("node", F.coalesce("new", "old").alias("root")))


def linked_classes(
    docs: DataFrame, sketched: DataFrame, id: str, text: str, rules: Rules
) -> DataFrame | None:
    """``node`` and ``root`` of the classes that have a verified link, by all links found; None
    if there are none.

    Neighbours in the first trees are verified first, then large families whole; of all other
    candidates only those whose ends are not yet connected. What is then not connected of
    families that do not fit a group is compared piece by piece.
    """
    classes = sketched.where("node is not null").groupBy("node").agg(
        F.min("uid").alias("uid"), F.first("n_shingles").alias("n"),
        F.first("signature").alias("signature"), F.first("code").alias("code"),
    )
    pairs = staged(candidates(forest(classes, rules), rules))
    if pairs.isEmpty():
        return None
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialise(
        whole_sets(docs, classes.select("node", "uid").join(ends, "node"), id, text, rules)
    )
    first = materialise(verified(pairs.where(F.col("near") < rules.first_trees), sets, rules))
    roots = joined_roots(None, first)
    dense = open_families(pairs, roots, sets, rules)
    rest = pairs.where(F.col("near") >= rules.first_trees).select("a", "b")
    if not dense.isEmpty():
        roots = joined_roots(roots, materialise(dense_links(dense, sets, classes, rules)))
        of_a = dense.where("whole").select(F.col("node").alias("a"), F.col("family").alias("fa"))
        of_b = dense.where("whole").select(F.col("node").alias("b"), F.col("family").alias("fb"))
        rest = rest.join(of_a, "a", "left").join(of_b, "b", "left").where(
            "fa is null or fb is null or fa <> fb"
        )
        rest = staged(rest.select("a", "b"))
    if roots is not None:
        of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = rest.join(of_a, "a", "left").join(of_b, "b", "left").where(
            "ra is null or rb is null or ra <> rb"
        )
    rest = staged(rest.select("a", "b"))
    roots = joined_roots(roots, materialise(verified(rest, sets, rules)))
    large = dense.where("not whole")
    if not large.isEmpty():
        more = links_between_pieces(large, roots, sets, rules)
        if more is not None:
            roots = joined_roots(roots, materialise(more))
    return roots


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` of each row.

    Words are split at ASCII white space after A to Z are lower-cased; a text of fewer words
    than a shingle has one shingle, an empty or null one has none and is linked with nothing.
    ``component_id`` is the smallest id of the documents that are reachable by links; an id is
    kept if it is that of its component. Rows with a null id come after all others: their
    component has the smallest id that is not null, if any. Repeated rows are one document
    and share their result.
    """
    return judged(docs, id, text, rules).drop("uid").withColumnRenamed("id", id)


def judged(docs: DataFrame, id: str, text: str, rules: Rules) -> DataFrame:
    """The result of ``near_duplicates`` with the ``uid`` of each row and its id as ``id``."""
    sketched = materialise(sketch(docs, id, text, rules))
    roots = linked_classes(docs, sketched, id, text, rules)
    per_class = sketched.where("node is not null").groupBy("node").agg(
        F.min("id").alias("least"), F.count("*").alias("rows")
    )
    if roots is None:
        named = per_class.where("rows > 1").select("node", F.col("least").alias("component"), "rows")
    else:
        rooted = materialise(per_class.join(roots, "node", "left"))
        linked = rooted.where("root is not null")
        least = linked.groupBy("root").agg(F.min("least").alias("component"))
        single = rooted.where("root is null and rows > 1")
        named = linked.join(least, "root").select("node", "component", "rows").union(
            single.select("node", F.col("least").alias("component"), "rows")
        )
    named = materialise(named.withColumn("grouped", F.lit(True)))
    base = sketched.select("id", "uid", "n_shingles", "node")
    joined = join_counted(base, named, ["node"], "rows")
    component = F.when(F.col("grouped"), F.col("component")).otherwise(F.col("id"))
    return joined.select(
        "id", "uid", "n_shingles", component.alias("component_id"),
        same(component, F.col("id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id. A row without
    an id goes if its component has a row with one, and otherwise stays. Rows that agree in id
    and text are one document, and stay or go together."""
    gone = fresh("gone", docs.columns)
    found = judged(docs, id, text, rules).where("not kept")
    removed = materialise(found.select(F.col("uid").alias(gone)).distinct())
    removed = F.broadcast(removed) if small(removed, 32) else removed
    return docs.join(removed, uid(id, text) == col_of(gone), "left_anti").select(
        *cols_of(docs.columns)
    )
