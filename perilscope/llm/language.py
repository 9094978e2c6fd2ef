"""Language identification by prediction by partial matching.

For each language a tree of byte contexts, up to three bytes deep, is counted from labelled
texts. A byte that a context has not seen is coded by an escape and then in the next shorter
context, without the bytes that the longer one has seen. The counts are frozen, so the code
length of every byte in every context is known beforehand: the trees of all languages become
one table with a row for each context. A text's language is the one with the shortest code.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perilscope.llm.frames import col_of, cols_of, fresh
from perilscope.llm.words import BLOCK, parts, utf8

UNKNOWN = "und"
ORDER = 3
#: Code lengths are whole multiples of one bit in so many, so that sums are exact.
UNIT = 1 << 16


@dataclass(frozen=True)
class Rules:
    """Bounds of the training: ``per_language`` texts of each language, those with the smallest
    hashes of their ids, and ``max_languages`` languages, more being an error. The table has at
    most ``cells`` code lengths; the contexts seen most often get a row, and the others are
    looked up by their last bytes. ``symbols`` different bytes are told apart."""

    per_language: int = 2_000
    max_languages: int = 64
    cells: int = 4_000_000
    symbols: int = 127


@dataclass(frozen=True)
class Model:
    languages: list[str]
    symbol_of: np.ndarray  # of each byte; 0 is any rare byte, and what is before a text
    row_of: np.ndarray  # of the last three symbols
    lengths: np.ndarray  # rows times symbols, languages


def four_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sequences of four bytes as numbers, and how often each occurs. Three zero
    bytes stand before each text."""
    data, offsets = utf8(texts)
    keys = []
    for start, end in zip(offsets[:-1], offsets[1:]):
        for lo in range(start, end, BLOCK):
            hi = min(lo + BLOCK, end)
            back = min(ORDER, lo - start)
            part = np.zeros(hi - lo + ORDER, np.uint32)
            part[ORDER - back :] = data[lo - back : hi]
            keys.append(part[:-3] << 24 | part[1:-2] << 16 | part[2:-1] << 8 | part[3:])
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (
        np.zeros(0, np.uint32), np.zeros(0, np.int64)
    )


def train(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
    rules: Rules = Rules(),
) -> Model:
    """The frozen model of the languages in ``docs``; rows without id, text or language are
    passed over."""
    named = docs.select(
        col_of(id).alias("id"), col_of(lang).cast("string").alias("lang")
    ).where("id is not null and lang is not null")
    sizes = {
        r["lang"]: r["count"]
        for r in named.groupBy("lang").count().limit(rules.max_languages + 1).collect()
    }
    if len(sizes) > rules.max_languages:
        raise ValueError(f"more than {rules.max_languages} languages")
    # some four times as many as wanted have a hash this small, so the ranking sees few rows
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    near = F.lit(False)
    for name, size in sizes.items():
        share = min(1.0, 4 * rules.per_language / size)
        near |= (F.col("lang") == name) & (draw < int(share * (1 << 30)) + 1)
    first = W.partitionBy("lang").orderBy(draw, "id")
    chosen = (
        named.where(near).withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= rules.per_language).select("id", "lang").distinct()
    )

    names = sorted(sizes, key=lambda s: s.encode())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 0)):
            texts, langs = batch.column(0), batch.column(1)
            for name in pc.unique(langs):
                keys, n = four_grams(texts.filter(pc.equal(langs, name)))
                who = np.full(len(keys), names.index(name.as_py()), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["who", "key", "n"],
                )

    # two numbers for each of a bounded number of texts
    sample = docs.select(
        col_of(id).alias("id"), col_of(lang).cast("string").alias("lang"),
        col_of(text).cast("string").alias("text"),
    ).where("text is not null").join(F.broadcast(chosen), ["id", "lang"], "left_semi")
    counts = (
        sample.select("text", "lang").mapInArrow(count, "who int, key bigint, n bigint")
        .groupBy("who", "key").agg(F.sum("n").alias("n")).toArrow()
    )
    return build(names, *(counts[c].to_numpy() for c in ("who", "key", "n")), rules)


def build(
    languages: list[str], who: np.ndarray, keys: np.ndarray, counts: np.ndarray, rules: Rules
) -> Model:
    """The table of code lengths from counts of four bytes by language (its place in the list)."""
    if not languages or not len(keys):
        return Model([], np.zeros(256, np.int64), np.zeros(1, np.int32), np.zeros((1, 0), np.int32))
    seen = np.bincount(keys & 255, weights=counts, minlength=256)
    common = [b for b in np.argsort(-seen, kind="stable")[: rules.symbols] if seen[b] > 0]
    symbol_of = np.zeros(256, np.int64)
    symbol_of[sorted(common)] = np.arange(1, len(common) + 1)
    k, n_lang = len(common) + 1, len(languages)
    grams = [symbol_of[(keys >> s) & 255].astype(np.int32) for s in (24, 16, 8, 0)]

    # contexts by length; a context is the number of its symbols in base k
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for order in range(ORDER + 1):
        context = np.zeros(len(keys), np.int32)
        for part in grams[ORDER - order : ORDER]:
            context = context * k + part
        names, inverse = np.unique(context, return_inverse=True)
        found.append((names.astype(np.int64), inverse.astype(np.int32)))
    limit = max(1, rules.cells // (k * n_lang))
    totals = [np.bincount(inv, weights=counts, minlength=len(names)) for names, inv in found]
    orders = np.repeat(np.arange(ORDER + 1), [len(t) for t in totals])
    # a shorter context has at least the count of a longer one that ends with it
    kept = np.zeros(len(orders), bool)
    kept[np.lexsort((orders, -np.concatenate(totals)))[:limit]] = True

    row_of = np.zeros((k,) * ORDER, np.int32)
    chances = np.zeros((int(kept.sum()), k, n_lang), np.float32)
    bits = np.zeros(chances.shape, np.int32)
    rows = base = 0
    for order, (names, inverse) in enumerate(found):
        keep = kept[base : base + len(names)]
        base += len(names)
        contexts = names[keep]
        place = np.full(len(names), -1, np.int64)
        place[keep] = np.arange(len(contexts))
        place = place[inverse]
        by_place = np.argsort(place, kind="stable")
        by_place = by_place[np.searchsorted(place[by_place], 0) :]
        below = row_of.reshape(-1, k ** max(order - 1, 0))[0] if order else None
        for lo in range(0, len(contexts), 256):
            hi = min(lo + 256, len(contexts))
            own = by_place[slice(*np.searchsorted(place[by_place], [lo, hi]))]
            seen = np.zeros((hi - lo, k, n_lang))
            np.add.at(seen, (place[own] - lo, grams[3][own], who[own]), counts[own])
            # the row that the context has without its first symbol
            shorter = (
                np.full((1, k, n_lang), 1.0 / k) if order == 0
                else chances[below[contexts[lo:hi] % k ** (order - 1)]].astype(np.float64)
            )
            chance = with_escapes(seen, shorter)
            chances[rows + lo : rows + hi] = chance
            bits[rows + lo : rows + hi] = np.rint(-np.log2(chance) * UNIT)
        # all contexts that end so take this row, until a longer one is found
        row_of.reshape(-1, k**order)[:, contexts] = rows + np.arange(len(contexts))
        rows += len(contexts)
    return Model(languages, symbol_of, row_of.reshape(-1), bits.reshape(-1, n_lang))


def with_escapes(seen: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities in contexts from their counts and from those of the shorter contexts.

    A context with ``n`` bytes, ``q`` of them different, gives a byte seen ``c`` times the
    share ``c / (n + q)`` and escapes with ``q / (n + q)``, split among the bytes it has not
    seen as the shorter context has them. A context a language has not seen is passed over.
    """
    n, new = seen.sum(1, keepdims=True), seen == 0
    q = (~new).sum(1, keepdims=True)
    rest = np.where(new, shorter, 0.0)
    mass = rest.sum(1, keepdims=True)
    whole = np.where(mass > 0, n + q, n)
    out = np.where(
        new, q * rest / np.maximum(mass, 1e-300) / np.maximum(whole, 1), seen / np.maximum(whole, 1)
    )
    return np.where(n > 0, out, shorter)


def code_lengths(texts: pa.Array, model: Model) -> np.ndarray:
    """Code length of each text in each language, in units."""
    data, offsets = utf8(texts)
    out = np.zeros((len(texts), len(model.languages)), np.int64)
    k = round(len(model.row_of) ** (1 / ORDER))
    size = BLOCK // 4
    for lo in range(0, len(data), size):
        hi = min(lo + size, len(data))
        back = min(ORDER, lo)
        symbols = np.zeros(hi - lo + ORDER, np.int64)
        symbols[ORDER - back :] = model.symbol_of[data[lo - back : hi]]
        a, b, c = symbols[:-3], symbols[1:-2].copy(), symbols[2:-1].copy()
        # nothing stands before a text
        first, last = np.searchsorted(offsets, [lo - ORDER + 1, hi])
        a = a.copy()
        for head in np.unique(offsets[first:last]):
            at = head - lo
            for part, reach in ((a, 3), (b, 2), (c, 1)):
                part[max(at, 0) : max(at + reach, 0)] = 0
        rows = model.row_of[(a * k + b) * k + c].astype(np.int64) * k + symbols[ORDER:]
        costs = model.lengths[rows]
        texts_here = slice(np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, hi))
        cuts = np.clip(offsets[:-1][texts_here] - lo, 0, hi - lo)
        some = np.clip(offsets[1:][texts_here] - lo, 0, hi - lo) > cuts
        which = np.arange(len(texts))[texts_here][some]
        out[which] += np.add.reduceat(costs, cuts[some], axis=0, dtype=np.int64)
    return out


def predict(texts: pa.Array, model: Model) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Language, score and bits for each byte of each text."""
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
    known = letters.to_numpy(zero_copy_only=False)
    if not model.languages:
        known = np.zeros(len(texts), bool)
        return pa.array([UNKNOWN] * len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    lengths = code_lengths(texts, model)
    best = lengths.argmin(1)
    shortest = lengths.min(1)
    behind = np.minimum((lengths - shortest[:, None]) / UNIT, 1000.0)
    score = np.round(1.0 / np.exp2(-behind).sum(1), 6)
    size = np.maximum(np.diff(utf8(texts)[1]), 1)
    names = np.array([*model.languages, UNKNOWN], object)
    lang = pa.array(names[np.where(known, best, len(model.languages))], pa.string())
    return lang, np.where(known, score, 0.0), shortest / UNIT / size


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits_per_byte``.

    A null text and one without a letter is ``und`` with score 0, and so is every text if the
    model has no language. The score is the share of the language among all, each weighted by
    two to the power of minus its code length. Equal lengths go to the first language by code
    points. Only the text decides. Columns of the added names are replaced.
    """
    added = ("lang_pred", "score", "bits_per_byte")
    keep = [c for c in docs.columns if c.lower() not in added]
    source = fresh("source_text", keep)
    given = docs.select(*cols_of(keep), col_of(text).cast("string").alias(source))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, len(keep))):
            lang, score, bits = predict(batch.column(len(keep)), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], lang, pa.array(score), pa.array(bits)],
                [*keep, *added],
            )

    schema = given.drop(source).schema.add("lang_pred", "string")
    return given.mapInArrow(run, schema.add("score", "double").add("bits_per_byte", "double"))
