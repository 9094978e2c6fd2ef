"""Removal of byte strings that occur earlier in the corpus, by suffix arrays of shards.

A string of ``length`` bytes is filed under the smallest hash among its short substrings, so
that all its occurrences meet, wherever they are. The strings of a document that are filed
under the same place form a stretch. A stretch that occurs earlier as a whole is repeated. The
stretches that share their place with other ones, and only these, are dealt to shards by it; a
suffix array of each shard tells which of their strings are equal.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from perilscope.llm.frames import (
    col_of, cols_of, fresh, join_counted, materialise, text_or_empty,
)
from perilscope.llm.suffixes import common_prefixes, suffix_array
from perilscope.llm.words import (
    BLOCK, mix, multipliers, parts, prefix_hashes, span_hashes, utf8,
)

REPEATED, OPEN = 0, 1
PLACE_BITS = np.uint64(24)


@dataclass(frozen=True)
class Rules:
    """Strings of ``length`` bytes are filed by substrings of ``gram`` bytes. A shard is about
    ``shard`` bytes; a place whose stretches take more than ``place`` bytes is split into several
    by a longer key. The first ``keys`` longer keys are of further substrings, the next ones of
    growing beginnings of the strings, up to all of them."""

    length: int = 100
    gram: int = 32
    shard: int = BLOCK
    place: int = 2 * BLOCK
    keys: int = 3


def in_order(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row in the order of the ids, named in the result.

    Whole numbers that are unique serve as they are. Otherwise the rows are sorted and
    numbered: null ids last, equal ids by their texts.
    """
    name = fresh("ord", docs.columns)
    if isinstance(docs.schema[id].dataType, (LongType, IntegerType, ShortType, ByteType)):
        per_id = docs.groupBy(col_of(id).alias("i")).count()
        if per_id.where("count > 1 or i is null").isEmpty():
            return docs.withColumn(name, col_of(id).cast("bigint")), name
    ordered = docs.orderBy(col_of(id).asc_nulls_last(), F.xxhash64(text_or_empty(text)), col_of(text))
    return materialise(ordered.withColumn(name, F.monotonically_increasing_id())), name


def stretches(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> Iterator[tuple]:
    """Blocks of ``(text, start, strings, place, content)``: runs of strings filed together, with
    the hash they are filed under and a hash of all their bytes."""
    grams = rules.length - rules.gram + 1
    factors = multipliers(2, 53)
    for lo in range(0, len(data), BLOCK):
        part = data[lo : lo + BLOCK + rules.length - 1]
        count = min(len(part) - rules.length + 1, BLOCK)
        if count <= 0:
            continue
        hashes = prefix_hashes(part)
        at = np.arange(len(part) - rules.gram + 1)
        least = span_hashes(hashes, at, at + rules.gram)
        # the place in the low bits: the first of equal hashes is the smallest
        least = (least >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
        reach = 1
        while 2 * reach <= grams:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < grams:
            least = np.minimum(least[: len(least) - grams + reach], least[grams - reach :])
        least = least[:count]
        # the string must end where its text does, at the latest
        text = np.searchsorted(offsets, np.arange(lo, lo + count), "right") - 1
        whole = np.arange(lo, lo + count) + rules.length <= offsets[text + 1]
        new = np.ones(count, bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
        start = np.flatnonzero(new & whole)
        if not len(start):
            continue
        edge = np.flatnonzero(new | ~whole)
        following = np.append(edge, count)[np.searchsorted(edge, start, "right")]
        strings = following - start
        place = least[start] >> PLACE_BITS
        inside = (least[start] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64) - start
        content = mix(
            span_hashes(hashes, start, start + strings + rules.length - 1)
            + inside.astype(np.uint64) * factors[0] + strings.astype(np.uint64) * factors[1]
        )
        yield text[start], start + lo - offsets[text[start]], strings, place, content


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching ranges of each document as one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(first)
    # the furthest end so far within the document: ends are lifted by a span per document
    span = int(hi.max()) + 1
    furthest = np.maximum.accumulate(hi + group * span) - group * span
    new = first.copy()
    new[1:] |= lo[1:] > furthest[:-1]
    at = np.flatnonzero(new)
    return doc[at], lo[at], furthest[np.append(at[1:], len(doc)) - 1]


FOUND = pa.schema(
    [("place", pa.int64()), ("content", pa.int64()), ("ord", pa.int64()), ("lo", pa.int64()),
     ("strings", pa.int32()), ("kind", pa.int8())]
)
FOUND_DDL = "place bigint, content bigint, ord bigint, lo bigint, strings int, kind tinyint"


def combined(held: list[tuple]) -> pa.RecordBatch:
    """Stretches ``(text, start, strings, place, content)`` as rows of ``FOUND``: OPEN, but for
    those that equal an earlier one of the same call, which are REPEATED, with a place of their
    own that only spreads them."""
    doc, lo, strings, place, content = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((lo, doc, content, place))
    doc, lo, strings, place, content = (c[order] for c in (doc, lo, strings, place, content))
    again = np.zeros(len(doc), bool)
    again[1:] = (content[1:] == content[:-1]) & (place[1:] == place[:-1])
    d, start, end = merged(doc[again], lo[again], lo[again] + strings[again])
    spread = mix(d.astype(np.uint64) + start.astype(np.uint64))
    cols = [
        np.concatenate([place[~again], spread]).view(np.int64),
        np.concatenate([content[~again], np.zeros(len(d), np.uint64)]).view(np.int64),
        np.concatenate([doc[~again], d]), np.concatenate([lo[~again], start]),
        np.concatenate([strings[~again], end - start]),
        np.repeat([OPEN, REPEATED], [int((~again).sum()), len(d)]),
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, FOUND)], schema=FOUND
    )


def filed(texts: DataFrame, rules: Rules, flush: int = 16 * BLOCK) -> DataFrame:
    """The stretches of all texts (``ord``, ``text``), combined within about ``flush`` bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in (part for whole in batches for part in parts(whole, 1)):
            data, offsets = utf8(batch.column(1))
            ords = batch.column(0).to_numpy()
            for text, lo, strings, place, content in stretches(data, offsets, rules):
                held.append((ords[text], lo, strings, place, content))
            size += len(data)
            if size >= flush and held:
                yield combined(held)
                held, size = [], 0
        if held:
            yield combined(held)

    return texts.select("ord", "text").mapInArrow(run, FOUND_DDL)


def compared(found: DataFrame) -> DataFrame:
    """What follows from the stretches alone, rows of ``FOUND`` with any further columns.

    Of equal stretches all but the first are REPEATED. A stretch alone in its place is dropped,
    the others stay OPEN. The rows of a place are read as a stream.
    """
    ordered = found.repartition("place").sortWithinPartitions(
        "place", "kind", "content", "ord", "lo"
    )
    kind_at = found.columns.index("kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None  # the only stretch so far in its place
        last = (None, None)  # place and content of the row before
        for batch in batches:
            place, content = batch.column("place").to_numpy(), batch.column("content").to_numpy()
            kind = batch.column(kind_at).to_numpy().copy()
            if not len(place):
                continue
            rows = np.flatnonzero(kind == OPEN)
            p, c = place[rows], content[rows]
            same_place, equal = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
            same_place[1:] = p[1:] == p[:-1]
            equal[1:] = same_place[1:] & (c[1:] == c[:-1])
            if len(rows):
                same_place[0] = last[0] == p[0]
                equal[0] = last == (p[0], c[0])
                last = (p[-1], c[-1])
            kind[rows[equal]] = REPEATED
            heads = np.flatnonzero(~equal)  # each different stretch once
            # a stretch has company if the one before or after it has the same place
            before = same_place[heads]
            after = np.zeros(len(heads), bool)
            after[:-1] = p[heads[1:]] == p[heads[:-1]]
            if waiting is not None and len(heads):
                if before[0]:
                    yield waiting
                waiting = None
            alone = ~before & ~after
            if len(heads) and alone[-1]:
                waiting = batch.slice(int(rows[heads[-1]]), 1)
            stay = np.ones(len(kind), bool)
            stay[rows[heads[alone]]] = False
            pick = np.flatnonzero(stay)
            columns = [col.take(pa.array(pick)) for col in batch.columns]
            columns[kind_at] = pa.array(kind[pick], pa.int8())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return ordered.mapInArrow(run, found.schema).drop("content")


def bytes_of(texts: DataFrame, wanted: DataFrame, rules: Rules) -> DataFrame:
    """The bytes of stretches: ``place``, ``ord``, ``lo``, ``bytes``."""
    # about a tenth of the texts in size, so this is a shuffle at any scale
    lists = wanted.groupBy("ord").agg(
        F.collect_list(F.struct("lo", "strings", "place")).alias("list")
    )
    joined = texts.join(lists, "ord").select("text", "ord", "list")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 0)):
            data, offsets = utf8(batch.column(0))
            listed = batch.column(2)
            items = listed.flatten()
            row = np.repeat(np.arange(len(batch)), listed.value_lengths().to_numpy())
            lo, strings = (items.field(f).to_numpy() for f in ("lo", "strings"))
            begin = offsets[row] + lo
            end = begin + strings + rules.length - 1
            raw = data.tobytes()
            for s in range(0, len(row), 20_000):
                cut = slice(s, s + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [items.field("place")[cut],
                     batch.column(1).take(pa.array(row[cut])), pa.array(lo[cut]),
                     pa.array([raw[a:b] for a, b in zip(begin[cut], end[cut])], pa.binary())],
                    ["place", "ord", "lo", "bytes"],
                )

    return joined.mapInArrow(run, "place bigint, ord bigint, lo bigint, bytes binary")


RANGES = "ord bigint, lo bigint, strings int"


def ranges(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Strings that follow one another as one range."""
    d, lo, hi = merged(doc, start, start + 1)
    return pa.RecordBatch.from_arrays(
        [pa.array(d), pa.array(lo), pa.array((hi - lo).astype(np.int32))], ["ord", "lo", "strings"]
    )


def equal_in_shard(pieces: list[bytes], doc: np.ndarray, lo: np.ndarray, rules: Rules) -> pa.RecordBatch:
    """The strings of a shard that an earlier string of the shard equals."""
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), size)
    hashes = prefix_hashes(data)
    array = suffix_array(data.astype(np.uint16), hashes, rules.length)
    room = begin[owner + 1] - np.arange(len(data))
    # strings that reach over the end of their stretch are none, but stand between equal ones;
    # of the others, one that shares the whole length with the one before it is the same
    at = array[room[array] >= rules.length]
    equal = common_prefixes(at, data, room, rules.length, hashes)[at] >= rules.length
    group = np.cumsum(~equal)
    several = np.bincount(group)[group] > 1
    at, group = at[several], group[several]
    d, start = doc[owner[at]], lo[owner[at]] + at - begin[owner[at]]
    order = np.lexsort((start, d, group))
    later = order[1:][group[order][1:] == group[order][:-1]]
    return ranges(d[later], start[later])


def in_shards(stretched: DataFrame, rules: Rules) -> DataFrame:
    """Repeated strings among the stretches of the same place, by a suffix array for each shard.

    A place goes to one task, which reads its places one after the other and works on shards of
    whole places.
    """
    ordered = stretched.repartition("place").sortWithinPartitions("place")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        docs: list[np.ndarray] = []
        los: list[np.ndarray] = []
        size, last = 0, None
        for batch in batches:
            place = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b <= a:
                    continue
                if size >= rules.shard and place[a] != last:
                    yield equal_in_shard(pieces, np.concatenate(docs), np.concatenate(los), rules)
                    pieces, docs, los, size = [], [], [], 0
                own = batch.column(3).slice(a, b - a).to_pylist()
                pieces += own
                size += sum(map(len, own))
                docs.append(batch.column(1).slice(a, b - a).to_numpy())
                los.append(batch.column(2).slice(a, b - a).to_numpy())
                last = place[a]
        if pieces:
            yield equal_in_shard(pieces, np.concatenate(docs), np.concatenate(los), rules)

    return ordered.select("place", "ord", "lo", "bytes").mapInArrow(run, RANGES)


def finer(stretched: DataFrame, level: int, rules: Rules) -> DataFrame:
    """The stretches of places that are too large, cut where a longer key changes: rows of
    ``FOUND`` and their ``bytes``. Equal strings have equal keys.

    The key is the smallest hash of a substring in another order of the hashes, which differs
    where what surrounds a passage differs; at later levels it is the hash of the first part of
    the string, of all of it at last.
    """
    reach = min(rules.gram + (level - rules.keys) * rules.gram, rules.length)

    def keys_of(hashes: np.ndarray, n: int) -> np.ndarray:
        """The key of the string that begins at each byte, for those with room for one."""
        count = n - rules.length + 1
        if level >= rules.keys:
            at = np.arange(count)
            return span_hashes(hashes, at, at + reach)
        at = np.arange(n - rules.gram + 1)
        least = mix(span_hashes(hashes, at, at + rules.gram) ^ multipliers(level + 1, 71)[level])
        grams, step = rules.length - rules.gram + 1, 1
        while 2 * step <= grams:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        return np.minimum(least[:count], least[grams - step : grams - step + count])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 2_000) for b in batches for s in range(0, len(b), 2_000)):
            place, ords, los = (batch.column(i).to_numpy() for i in (0, 1, 2))
            pieces = batch.column(3).to_pylist()
            length = np.array([len(x) for x in pieces], np.int64)
            begin = np.cumsum(length) - length
            raw = b"".join(pieces)
            if len(raw) < rules.length:
                continue
            hashes = prefix_hashes(np.frombuffer(raw, np.uint8))
            key = keys_of(hashes, len(raw))
            row = np.repeat(np.arange(len(length)), length)[: len(key)]
            inside = np.arange(len(key)) - begin[row]
            whole = inside + rules.length <= length[row]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            start = np.flatnonzero(new & whole)
            edge = np.flatnonzero(new | ~whole)
            strings = np.append(edge, len(key))[np.searchsorted(edge, start, "right")] - start
            end = start + strings + rules.length - 1
            own = row[start]
            content = mix(span_hashes(hashes, start, end) + strings.astype(np.uint64))
            finer_place = mix(place[own].view(np.uint64) + mix(key[start] + np.uint64(level)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(finer_place.view(np.int64)), pa.array(content.view(np.int64)),
                 pa.array(ords[own]), pa.array(los[own] + inside[start]),
                 pa.array(strings.astype(np.int32)), pa.array(np.full(len(start), OPEN, np.int8)),
                 pa.array([raw[a:b] for a, b in zip(start, end)], pa.binary())],
                [*FOUND.names, "bytes"],
            )

    return stretched.select("place", "ord", "lo", "bytes").mapInArrow(
        run, FOUND_DDL + ", bytes binary"
    )


def repeated_ranges(texts: DataFrame, rules: Rules) -> DataFrame:
    """``ord`` and ``list``, the ranges of bytes to remove in order, of each text that has any;
    ``texts`` has ``ord`` and ``text``.

    Places within ``rules.place`` bytes are dealt to shards. The strings of larger ones are filed
    again by longer keys until all places are, which the last key, the whole string, makes sure.
    """
    found = materialise(compared(filed(texts, rules)))
    ranges_of = [found.where(F.col("kind") == REPEATED).select("ord", "lo", "strings")]
    stretched = materialise(bytes_of(texts, found.where(F.col("kind") == OPEN), rules))
    level = 0
    while True:
        size = F.octet_length("bytes").cast("bigint")
        large = materialise(
            stretched.groupBy("place").agg(F.sum(size).alias("size"), F.count("*").alias("n"))
            .where(F.col("size") > rules.place).select("place", "n", F.lit(True).alias("large"))
        )
        last = level > rules.keys + -(-rules.length // rules.gram)
        if last or large.isEmpty():
            ranges_of.append(in_shards(stretched, rules))
            break
        marked = materialise(join_counted(stretched, large, ["place"], "n"))
        ranges_of.append(in_shards(marked.where("large is null"), rules))
        found = materialise(compared(finer(marked.where("large"), level, rules)))
        ranges_of.append(found.where(F.col("kind") == REPEATED).select("ord", "lo", "strings"))
        stretched = found.where(F.col("kind") == OPEN).select("place", "ord", "lo", "bytes")
        level += 1
    every = ranges_of[0]
    for part in ranges_of[1:]:
        every = every.union(part)
    spans = F.struct(
        F.col("lo"), (F.col("lo") + F.col("strings") + rules.length - 1).alias("hi")
    )

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(1)
            items = listed.flatten()
            row = np.repeat(np.arange(len(batch)), listed.value_lengths().to_numpy())
            d, lo, hi = merged(row, items.field("lo").to_numpy(), items.field("hi").to_numpy())
            cuts = np.searchsorted(d, np.arange(len(batch) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), spans)], ["ord", "list"]
            )

    return materialise(
        every.groupBy("ord").agg(F.collect_list(spans).alias("list")).mapInArrow(
            merge, "ord bigint, list array<struct<lo:bigint,hi:bigint>>"
        )
    )


def with_ranges(docs: DataFrame, id: str, text: str, rules: Rules) -> tuple[DataFrame, str]:
    """``docs`` with the ranges to remove, in a column named in the result, null for none."""
    numbered, name = in_order(docs, id, text)
    texts = numbered.select(col_of(name).alias("ord"), text_or_empty(text).alias("text"))
    ranges = fresh("ranges", numbered.columns)
    lists = repeated_ranges(texts, rules).select(
        F.col("ord").alias(name), F.col("list").alias(ranges)
    )
    return numbered.join(lists, name, "left").drop(name), ranges


def kept_bytes(text: bytes, spans: Iterable[dict]) -> bytes:
    out, at = [], 0
    for span in spans:
        out.append(text[at : span["lo"]])
        at = span["hi"]
    return b"".join(chain(out, [text[at:]]))


def summary(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each row.

    A byte goes if a string of ``rules.length`` bytes around it also starts earlier: in a row
    with a smaller id, or further ahead in the same text. Null ids come last; rows with equal
    ids follow each other by their texts, so the second of two equal rows goes as a whole.
    Null and empty texts, and texts shorter than a string, lose nothing.
    """
    given = docs.select(col_of(id).alias("id"), col_of(text).cast("string").alias("text"))
    joined, ranges = with_ranges(given, "id", "text", rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            rows = []
            for value, spans in zip(batch.column(1), batch.column(2)):
                raw = value.as_buffer().to_pybytes()
                spans = spans.as_py() or []
                rows.append(
                    (len(raw), sum(s["hi"] - s["lo"] for s in spans), len(spans),
                     sha256(kept_bytes(raw, spans)).hexdigest())
                )
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                [id, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    id_type = docs.schema[id].dataType.simpleString()
    return joined.select("id", text_or_empty("text"), ranges).mapInArrow(
        run, f"`{id}` {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = Rules()
) -> DataFrame:
    """``docs`` with the repeated bytes taken out of the texts. A character of which bytes are
    left over is replaced by U+FFFD."""
    names = docs.columns
    joined, ranges = with_ranges(docs, id, text, rules)
    at = names.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if spans is None or t is None
                else kept_bytes(t.encode(), spans).decode("utf-8", "replace")
                for t, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())
            ]
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*cols_of([*names, ranges])).mapInArrow(run, docs.schema)
