"""Quality rules: fixed measures of texts, and a likelihood ratio of hashed n-grams.

Two multinomials over hashed n-grams of bytes are compared, one of the texts that labels call
good, one of the whole corpus. A document's score is the mean log-likelihood ratio of its
n-grams, so that its length does not matter, and it is kept if the score reaches a threshold
that is computed once from the scores of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.llm.frames import col_of, cols_of, fresh
from perilscope.llm.words import (
    BLOCK, SPACE, mix, multipliers, parts, shingles, sums_by, utf8, words,
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """``width`` bytes make an n-gram, hashed to ``1 << bits`` buckets.

    At most ``labelled`` labelled documents, those with the smallest hashes of their ids, give
    the trusted n-grams and the threshold; the corpus counts are those of all documents. The
    threshold lies where most good and bad labelled documents are told apart, but never above
    the score that all but ``lost`` of the good ones reach.
    """

    width: int = 4
    bits: int = 16
    labelled: int = 100_000
    smoothing: float = 1.0
    lost: float = 0.005
    min_words: int = 10
    max_repeat_percent: int = 20


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    threshold: float


def repeated_words(found, width: int = 5) -> np.ndarray:
    """For each text, the words in windows of ``width`` words that it holds twice or more."""
    n = np.diff(found.first)
    grams, first = shingles(found, width)
    whole = n >= width
    text = np.repeat(np.arange(len(n)), np.diff(first))
    # equal windows of different texts must differ
    keys = mix(grams + text.astype(np.uint64) * multipliers(1, 31)[0])
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    twice &= np.repeat(whole, np.diff(first))
    at = np.flatnonzero(twice)
    starts = found.first[text[at]] + (at - first[text[at]])
    cover = np.zeros(len(found.hashes) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return sums_by(np.cumsum(cover[:-1]) > 0, found.first)


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """``MEASURES`` of each text; null counts as empty."""
    data, offsets = utf8(texts)
    found = words(texts)
    chars, symbols = (np.zeros(len(texts), np.int64) for _ in range(2))
    for lo in range(0, len(data), BLOCK):
        part = data[lo : lo + BLOCK]
        cut = np.clip(offsets - lo, 0, len(part))
        # a code point has one byte that is no continuation
        chars += sums_by(~SPACE[part] & ((part & 0xC0) != 0x80), cut)
        symbols += sums_by(SYMBOLS[part], cut)
    return {
        "n_words": np.diff(found.first),
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": np.array([duplicate_lines(t.as_py()) for t in texts], np.int64),
        "n_repeat_words": repeated_words(found),
    }


def buckets(data: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte, as far as there are whole ones."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = (code << np.uint64(8)) | data[k : k + n]
    if width > 7:
        code = mix(code)
    return (mix(code) >> np.uint64(64 - bits)).astype(np.int64)


def grams_in(
    data: np.ndarray, offsets: np.ndarray, rules: Rules
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of buckets, with where each text's begin in the block; no n-gram leaves its text."""
    for lo in range(0, len(data), BLOCK):
        part = data[lo : lo + BLOCK + rules.width - 1]
        found = buckets(part, rules.width, rules.bits)
        yield found, np.clip(offsets - lo, 0, len(found))


def text_ends(offsets: np.ndarray, first: np.ndarray, lo: int, size: int, width: int) -> np.ndarray:
    """Where each text's last whole n-gram ends in the block."""
    return np.maximum(np.clip(offsets[1:] - (width - 1) - lo, 0, size), first[:-1])


def count_grams(texts: pa.Array, trusted: np.ndarray, rules: Rules) -> np.ndarray:
    """N-grams by bucket: of all texts, and of the trusted ones."""
    data, offsets = utf8(texts)
    size = 1 << rules.bits
    out = np.zeros((2, size), np.int64)
    for i, (found, first) in enumerate(grams_in(data, offsets, rules)):
        last = text_ends(offsets, first, i * BLOCK, len(found), rules.width)
        for row, chosen in enumerate((np.ones(len(texts), bool), trusted)):
            mark = np.zeros(len(found) + 1, np.int64)
            np.add.at(mark, first[:-1][chosen], 1)
            np.add.at(mark, last[chosen], -1)
            out[row] += np.bincount(found[np.cumsum(mark[:-1]) > 0], minlength=size)
    return out


def score_texts(texts: pa.Array, weights: np.ndarray, rules: Rules) -> np.ndarray:
    """Mean weight of the n-grams of each text; 0 for a text without any."""
    data, offsets = utf8(texts)
    total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for i, (found, first) in enumerate(grams_in(data, offsets, rules)):
        last = text_ends(offsets, first, i * BLOCK, len(found), rules.width)
        # whole numbers: sums do not depend on where a batch begins
        sums = np.concatenate([[0], np.cumsum(weights[found])])
        total += sums[last] - sums[first[:-1]]
        count += last - first[:-1]
    return total / np.maximum(count, 1) / SCALE


#: Weights are whole multiples of one part in so many.
SCALE = float(1 << 20)


def labelled_ids(labels: DataFrame, id: str, quality: str, rules: Rules) -> DataFrame:
    """At most ``rules.labelled`` ids with ``good``: 1 if every label of the id says so. Those
    with ``part`` 0 are for the n-grams, the others for the threshold."""
    return (
        labels.select(col_of(id).alias("label_id"), col_of(quality).alias("q"))
        .where("label_id is not null and q is not null")
        .groupBy("label_id")
        .agg(F.min(F.when(F.col("q") > 0, 1).otherwise(0)).alias("good"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(rules.labelled)
        .withColumn("part", F.pmod(F.xxhash64("label_id", F.lit("part")), F.lit(2)).cast("int"))
    )


def fit(
    docs: DataFrame, labels: DataFrame, id: str, text: str, quality: str, rules: Rules
) -> Model:
    """The n-gram weights and the threshold.

    Counts are sums of one row for each bucket and task. Without good labels every weight is
    near 0 and every score passes.
    """
    # at most rules.labelled rows of two numbers, so this can be broadcast
    known = F.broadcast(labelled_ids(labels, id, quality, rules))
    joined = docs.select(col_of(id).alias("id"), col_of(text).alias("text")).join(
        known, F.col("id") == F.col("label_id"), "left"
    )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 1 << rules.bits), np.int64)
        for batch in (part for whole in batches for part in parts(whole, 0)):
            good = pc.fill_null(batch.column(1), False)
            out += count_grams(batch.column(0), good.to_numpy(zero_copy_only=False), rules)
        seen = np.flatnonzero(out[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(out[0][seen]), pa.array(out[1][seen])], ["b", "n", "t"]
        )

    counts = (
        joined.select("text", ((F.col("good") == 1) & (F.col("part") == 0)).alias("trusted"))
        .mapInArrow(count, "b bigint, n bigint, t bigint")
        .groupBy("b")
        .agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        .toArrow()
    )
    corpus, target = (np.full(1 << rules.bits, rules.smoothing) for _ in range(2))
    at = counts["b"].to_numpy()
    corpus[at] += counts["n"].to_numpy()
    target[at] += counts["t"].to_numpy()
    ratio = np.log(target / target.sum()) - np.log(corpus / corpus.sum())
    weights = np.rint(ratio * SCALE).astype(np.int64)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 0)):
            found = score_texts(batch.column(0), weights, rules)
            n = measures(batch.column(0))
            ok = ~base_failed(n, rules)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), batch.column(1), pa.array(ok)], ["score", "good", "ok"]
            )

    scored = (
        joined.where("good is not null and part = 1")
        .select("text", "good")
        .mapInArrow(score, "score double, good int, ok boolean")
        .where("ok")
        .toArrow()
    )
    return Model(weights, threshold(scored["score"].to_numpy(), scored["good"].to_numpy(), rules))


def threshold(scores: np.ndarray, good: np.ndarray, rules: Rules) -> float:
    """The score with the most good documents at or above it and bad ones below, in shares."""
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order] == 1
    if not good.any():
        return -np.inf
    limit = scores[good][int(rules.lost * good.sum())]
    if good.all():
        return float(limit)
    # keeping scores[i:] loses the good and drops the bad ones before i
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    dropped = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    first = np.flatnonzero(np.concatenate([[True], scores[1:] > scores[:-1]]))
    best = first[np.argmax((dropped - lost)[first])]
    # in the middle between the last that goes and the first that stays
    return float(min((scores[max(best - 1, 0)] + scores[best]) / 2, limit))


def base_failed(found: dict[str, np.ndarray], rules: Rules) -> np.ndarray:
    n = found["n_words"]
    return (n < rules.min_words) | (100 * found["n_repeat_words"] > rules.max_repeat_percent * n)


def rate(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    rules: Rules = Rules(),
    model: Model | None = None,
) -> DataFrame:
    """``docs`` with ``MEASURES``, ``score``, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Null ids are rated but belong
    to no label; repeated rows each count for the corpus. Columns of the added names are
    replaced. The weights travel with the tasks: ``1 << bits`` numbers, whatever the data.
    """
    model = fit(docs, labels, id, text, quality, rules) if model is None else model
    added = [*MEASURES, "score", "base_failed", "kept"]
    keep = [c for c in docs.columns if c.lower() not in added]
    source = fresh("source_text", keep)
    given = docs.select(*cols_of(keep), col_of(text).cast("string").alias(source))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, len(keep))):
            texts = batch.column(len(keep))
            found = measures(texts)
            failed = base_failed(found, rules)
            score = score_texts(texts, model.weights, rules)
            columns = [
                *batch.columns[: len(keep)], *(pa.array(found[m]) for m in MEASURES),
                pa.array(score), pa.array(failed),
                pa.array(~failed & (score >= model.threshold)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *added])

    schema = given.drop(source).schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    schema = schema.add("score", "double").add("base_failed", "boolean").add("kept", "boolean")
    return given.mapInArrow(run, schema)
