"""Removal of benchmark passages from training documents.

Benchmark items are cut into windows of words. Each window is filed under its longest word,
in a hash table of checked size that is sent to all tasks as a constant. A document's words are looked up in
the table, and only where one of them is filed is the whole window compared. All of it is
done with column expressions, within the row of the document: nothing is shuffled but the
benchmark. A benchmark too large for that is joined by the hashes of all windows instead.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.columns import constant
from perilscope.llm.frames import (
    col_of, cols_of, computed_once, fresh, join_counted, materialise, text_or_empty,
)

WINDOW = 13
#: A table of at most so many bytes goes to the tasks, as a part of the plan.
TABLE_BYTES = 8 * 1024 * 1024
#: A word: letters and digits of ASCII, and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
HIT = "array<struct<s:int,e:int,items:array<string>>>"


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case and no other letter changed."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def words_of(text: str) -> Column:
    return F.regexp_extract_all(lower_ascii(text_or_empty(text)), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, id: str, text: str, width: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: ``gram``, its ``anchor`` word, that word's place
    ``off``, the window's length ``len``, and the ``items`` it is from.

    An item of fewer than ``width`` words is one window, one without words none. An item
    without an id goes by the empty text.
    """
    n = F.size("words")
    grams = F.when(
        n >= width,
        F.transform(
            F.sequence(F.lit(0), n - width), lambda i: F.slice("words", i + 1, width)
        ),
    ).when(n > 0, F.array("words"))
    longest = F.transform("gram", lambda w: F.octet_length(w))
    return (
        benchmark.select(
            F.coalesce(col_of(id).cast("string"), F.lit("")).alias("item"),
            words_of(text).alias("words"),
        )
        .select("item", F.explode(grams).alias("gram"))
        .groupBy("gram")
        .agg(F.collect_set("item").alias("items"))
        .withColumn(
            "off", (F.array_position(longest, F.array_max(longest)) - 1).cast("int")
        )
        .select(
            "gram", "items", "off", F.size("gram").alias("len"),
            F.get("gram", F.col("off")).alias("anchor"),
        )
    )


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def hash_table(found: DataFrame, buckets: int) -> Column:
    """The table as a constant of the plan: an array of buckets, each an array of windows."""
    table: list[list[dict]] = [[] for _ in range(buckets)]
    rows = found.select(
        bucket(F.col("anchor"), buckets).alias("b"), "anchor", "off", "len",
        F.concat_ws(" ", "gram").alias("gram"), "items",
    ).orderBy("anchor", "off", "gram")
    for b, *entry in rows.collect():
        table[b].append(dict(zip(("anchor", "off", "len", "gram", "items"), entry)))
    return constant(
        table,
        "array<array<struct<anchor:string,off:int,len:int,gram:string,items:array<string>>>>",
    )


def hits_in_row(words: Column, found: DataFrame, buckets: int) -> Column:
    """Where windows occur in ``words``, by the table of ``found``."""
    table = hash_table(found, buckets)
    n = F.size(words)

    def filed(p: Column) -> Column:
        return F.get(table, bucket(F.get(words, p), buckets))

    def occurs(p: Column, x: Column) -> Column:
        start = p - x["off"]
        inside = (x["anchor"] == F.get(words, p)) & (start >= 0) & (start + x["len"] <= n)
        # the slice is taken only where it is within the text
        gram = F.concat_ws(" ", F.slice(words, F.greatest(start, F.lit(0)) + 1, x["len"]))
        return F.when(inside, gram == x["gram"]).otherwise(F.lit(False))

    places = F.filter(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda p: F.size(filed(p)) > 0,
    )
    return F.flatten(
        F.transform(
            places,
            lambda p: F.transform(
                F.filter(filed(p), lambda x: occurs(p, x)),
                lambda x: F.struct(
                    (p - x["off"]).alias("s"), (p - x["off"] + x["len"]).alias("e"),
                    x["items"].alias("items"),
                ),
            ),
        )
    ).cast(HIT)


def hits_by_join(worded: DataFrame, words: str, hits: str, found: DataFrame) -> DataFrame:
    """``worded`` with the column ``hits``, by a join of all windows of all documents.

    For a benchmark of any size. Windows are compared by 128 bits of hashes, once for each
    different sequence of words.
    """
    key, n = fresh("key", worded.columns), F.size(words)
    keyed = worded.withColumn(key, F.sha2(F.concat_ws(" ", words).cast("binary"), 256))
    lengths = [r["len"] for r in found.select("len").distinct().collect()]

    def two(gram: Column) -> list[Column]:
        return [F.xxhash64(gram).alias("h"), F.xxhash64(F.lit("2"), gram).alias("g")]

    none = F.array().cast("array<struct<s:int,e:int,h:bigint,g:bigint>>")

    def of_length(size: int) -> Column:
        def gram(i: Column) -> Column:
            return F.struct(
                i.alias("s"), (i + size).alias("e"), *two(F.slice(words, i + 1, size))
            )

        return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), gram)).otherwise(none)

    grams = F.flatten(F.array(*[of_length(size) for size in lengths])) if lengths else none
    each = (
        keyed.groupBy(key).agg(F.first(words).alias(words), F.count("*").alias("rows"))
        .select(key, "rows", F.explode(grams).alias("x"))
        .select(key, "rows", "x.*")
    )
    targets = found.select("items", *two(F.col("gram")))
    met = materialise(
        each.join(targets, ["h", "g"])
        .groupBy(key)
        .agg(
            F.collect_list(F.struct("s", "e", "items")).cast(HIT).alias(hits),
            F.first("rows").alias("rows"),
        )
    )
    joined = join_counted(keyed, met, [key], "rows")
    return joined.withColumn(hits, F.coalesce(hits, F.array().cast(HIT))).drop(key)


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    limit: int | None = None,
) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, named in the result: the words of the text and the
    occurrences of windows, ``array<struct<s, e, items>>`` in places of words.

    The table is sent to the tasks if its measured size is within ``limit`` bytes.
    """
    limit = TABLE_BYTES if limit is None else limit
    found = materialise(windows(benchmark, item_id, item_text, width))
    held = F.octet_length(F.concat_ws(" ", "gram")) + F.octet_length(F.concat_ws(" ", "items"))
    count, size = found.agg(F.count("*"), F.coalesce(F.sum(held + 200), F.lit(0))).first()
    words, hits = fresh("words", docs.columns), fresh("hits", docs.columns)
    worded = docs.withColumn(words, computed_once(words_of(text)))
    if size <= limit:
        buckets = 1 << max(4, (16 * count - 1).bit_length())
        found_hits = hits_in_row(F.col(words), found, buckets)
        worded = worded.withColumn(hits, computed_once(found_hits))
    else:
        worded = hits_by_join(worded, words, hits, found)
    return worded, words, hits


def covered(hits: Column) -> Column:
    """Places that lie within an occurrence, overlaps counted once."""
    ends = F.array_sort(F.transform(hits, lambda h: F.struct(h["s"].alias("s"), h["e"].alias("e"))))
    return F.aggregate(
        ends,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, h: F.struct(
            (a["n"] + F.greatest(h["e"] - F.greatest(h["s"], a["to"]), F.lit(0))).alias("n"),
            F.greatest(a["to"], h["e"]).alias("to"),
        ),
        lambda a: a["n"],
    )


def report(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", share: int = 20, **options
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``contaminated``.

    A document is contaminated if at least one word in ``share`` is hit. Null and empty texts
    have no words and are clean; an empty benchmark hits nothing. Rows do not influence each
    other, so repeated rows and ids give repeated results. Columns of the added names are
    replaced.
    """
    added = ("n_words", "n_hit", "n_items", "items", "contaminated")
    base = docs.select(*cols_of([c for c in docs.columns if c.lower() not in added]))
    worded, words, hits = with_hits(base, benchmark, text, **options)
    counted = worded.select(
        *cols_of(base.columns),
        F.size(words).cast("bigint").alias("n_words"),
        covered(F.col(hits)).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.col(hits)["items"]))).alias("items"),
    )
    return counted.select(
        *cols_of(base.columns), "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    return report(docs, benchmark, **options).where(~F.col("contaminated")).select(
        *cols_of(docs.columns)
    )


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", **options
) -> DataFrame:
    """``docs`` with every hit word taken out of the text; what stands between words stays."""
    worded, _, hits = with_hits(docs, benchmark, text, **options)
    raw, gaps = fresh("raw", worded.columns), fresh("gaps", worded.columns)
    cut = worded.withColumn(
        raw, computed_once(F.regexp_extract_all(text_or_empty(text), F.lit(RAW_WORD), F.lit(0)))
    ).withColumn(gaps, computed_once(F.split(text_or_empty(text), RAW_WORD, -1)))
    kept = F.transform(
        raw,
        lambda w, i: F.concat(
            F.when(F.exists(hits, lambda h: (h["s"] <= i) & (i < h["e"])), F.lit("")).otherwise(w),
            F.get(gaps, i + 1),
        ),
    )
    rebuilt = F.when(
        F.size(hits) > 0, F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))
    ).otherwise(col_of(text))
    return cut.withColumn(text, rebuilt).select(*cols_of(docs.columns))


__all__ = ["drop_contaminated", "remove_spans", "report", "windows", "with_hits"]
