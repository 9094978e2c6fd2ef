"""Ordered rule tables that turn text into labels.

A rule table is small and belongs to the plan: it becomes a constant array, and every stage
is a column expression on the text. ``classify`` evaluates it once per distinct text, found
by a pre-aggregated pass, and joins the labels back: broadcast if their size is small,
else by a shuffle that splits hot texts. ``label_of`` is the expression itself, for rows
that pass only once (streams) or tables whose texts hardly repeat.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.columns import ColumnLike, bind, col_of, cols_of, constant, rows_of
from perilscope.functions.numbers import percent
from perilscope.functions.similarity import (
    MASK_FIELDS,
    WORD_FIELDS,
    allowed_edits,
    mask_entry,
    partial_ratio_to,
    ratio_from_masks,
    word_entry,
)
from perilscope.functions.text import literal_map, replace_synonym, strip, tokens
from perilscope.operators import matching
from perilscope.operators.joins import join_checked
from perilscope.session import materialise, shared_dir

RuleTable = Mapping[str, Sequence[str]] | Sequence[tuple[str, str]] | DataFrame
#: More rules than this cannot be literals of a plan.
RULE_LIMIT = 10_000
#: From so many rules on, texts are met with them by joins, which give the same labels.
JOIN_FROM = 500
CASE_LIMIT = 40
STAGES = ("exact", "token", "fuzzy", "token_fuzzy")


def rule_list(rules: RuleTable, limit: int = RULE_LIMIT) -> list[tuple[str, str]]:
    """(pattern, label) pairs in order, from label groups, pairs or a (pattern, label, ord) frame.

    More than ``limit`` rules are an error, however they are given: they are part of the plan.
    """
    if isinstance(rules, DataFrame):
        rows = rules.select("pattern", "label", "ord").limit(limit + 1).collect()
        pairs = [(r["pattern"], r["label"]) for r in sorted(rows, key=lambda r: r["ord"])]
    elif isinstance(rules, Mapping):
        pairs = [(p, label) for label, patterns in rules.items() for p in patterns]
    else:
        pairs = [(p, label) for p, label in rules]
    if len(pairs) > limit:
        raise ValueError(f"rule table has more than {limit} rows")
    return pairs


def many(rules: RuleTable) -> bool:
    """Whether there are ``JOIN_FROM`` rules or more; no more than that are read to find out."""
    if isinstance(rules, DataFrame):
        return rules.limit(JOIN_FROM).count() >= JOIN_FROM
    if isinstance(rules, Mapping):
        return sum(len(patterns) for patterns in rules.values()) >= JOIN_FROM
    return len(rules) >= JOIN_FROM


def computed_once(rules: RuleTable) -> RuleTable:
    """The rules; a frame, which is counted before it is met with texts, is computed, if there
    is a folder for it."""
    if isinstance(rules, DataFrame) and shared_dir(rules.sparkSession) is not None:
        return materialise(rules.select("pattern", "label", "ord"))
    return rules


def rule_frame(spark: SparkSession, rules: RuleTable) -> DataFrame:
    """The rules as a frame of (pattern, label, ord); a frame is taken as it is."""
    if isinstance(rules, DataFrame):
        return rules.select("pattern", "label", "ord")
    pairs = rule_list(rules, sys.maxsize)
    return spark.createDataFrame(
        pa.table(
            {
                "pattern": pa.array([p for p, _ in pairs], pa.string()),
                "label": pa.array([x for _, x in pairs], pa.string()),
                "ord": pa.array(range(len(pairs)), pa.int32()),
            }
        )
    )


def _rule_array(pairs: Sequence[tuple[str, str]], masks: bool = False) -> Column:
    entries = [
        {"pattern": p, "label": x, "place": -i, **(mask_entry(p) if masks else {})}
        for i, (p, x) in enumerate(pairs)
    ]
    fields = "pattern: string, label: string, place: int" + (f", {MASK_FIELDS}" if masks else "")
    return constant(entries, f"array<struct<{fields}>>")


def exact_label(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    table: dict[str, str] = {}
    for pattern, label in pairs:
        table.setdefault(pattern, label)
    return F.element_at(literal_map(table), text)


def token_label(text: Column, pairs: Sequence[tuple[str, str]], min_token_len: int = 1) -> Column:
    """First rule that contains, or is contained in, the first token that has such a rule.

    An empty token, which is part of every rule, never matches.
    """
    table = _rule_array(pairs)

    def first_rule(token: Column) -> Column:
        return F.get(
            F.filter(table, lambda r: r["pattern"].contains(token) | token.contains(r["pattern"])),
            F.lit(0),
        )["label"]

    usable = F.filter(tokens(text), lambda t: F.length(t) >= max(1, min_token_len))
    return F.get(F.array_compact(F.transform(usable, first_rule)), F.lit(0))


def _similar(text: Column, table: Column, min_score: float, place: Column) -> Column:
    """(score, text_place, place, label) of the rules with at least ``min_score``.

    The edit distance is never above the number of insertions and deletions, so a bounded
    Levenshtein distance rules out nearly all rules before one is scored.
    """

    def near(rule: Column) -> Column:
        allowed = allowed_edits(F.length(text) + rule["length"], min_score)
        close = F.abs(F.length(text) - rule["length"]) <= allowed
        return close & (F.call_function("levenshtein", text, rule["pattern"], allowed) >= 0)

    def scored(rule: Column) -> Column:
        return F.struct(
            ratio_from_masks(text, rule["masks"], rule["length"]).alias("score"),
            (-place).alias("text_place"),
            rule["place"].alias("place"),
            rule["label"].alias("label"),
        )

    found = F.transform(F.filter(table, near), scored)
    return F.filter(found, lambda s: s["score"] >= F.lit(float(min_score)))


def fuzzy_label(text: Column, pairs: Sequence[tuple[str, str]], min_score: float = 97) -> Column:
    """Label of the most similar rule from ``min_score`` on, the first one of equal ones."""
    found = _similar(text, _rule_array(pairs, masks=True), min_score, F.lit(0))
    return F.array_max(found)["label"]


def token_fuzzy_label(
    text: Column, pairs: Sequence[tuple[str, str]], min_score: float = 97
) -> Column:
    """``fuzzy_label`` of the best token, the first one of equally good ones."""
    table = _rule_array(pairs, masks=True)
    usable = F.filter(tokens(text), lambda t: t != "")
    found = F.transform(usable, lambda t, i: _similar(t, table, min_score, i))
    return F.array_max(F.flatten(found))["label"]


def label_of(
    text: ColumnLike,
    rules: RuleTable,
    synonyms: Mapping[str, str] | None = None,
    stages: Sequence[str] = STAGES,
    min_score: float = 97,
    min_token_len: int = 1,
) -> Column:
    """The cascade as one expression; a later stage runs only where the earlier ones fail."""
    pairs = rule_list(rules)
    stage = {
        "exact": lambda t: exact_label(t, pairs),
        "token": lambda t: token_label(t, pairs, min_token_len),
        "fuzzy": lambda t: fuzzy_label(t, pairs, min_score),
        "token_fuzzy": lambda t: token_fuzzy_label(t, pairs, min_score),
    }
    return bind(
        replace_synonym(text, synonyms), lambda t: F.coalesce(*[stage[s](t) for s in stages])
    )


def classify(
    df: DataFrame,
    column: str,
    rules: RuleTable,
    synonyms: Mapping[str, str] | None = None,
    stages: Sequence[str] = STAGES,
    min_score: float = 97,
    label: str = "theme",
) -> tuple[DataFrame, DataFrame]:
    """Add ``label`` by the cascade; also returns the distinct texts without one, sorted.

    The distinct texts are labelled at once, in jobs of their own; the result is lazy.
    """
    labelled = label_texts(df, column, rules, synonyms, stages, min_score, label)
    return attach_by_text(df, column, labelled, label), unmapped_texts(labelled, column, label)


def classify_counts(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    rules: RuleTable,
    synonyms: Mapping[str, str] | None = None,
    stages: Sequence[str] = STAGES,
    min_score: float = 97,
    label: str = "theme",
) -> tuple[DataFrame, DataFrame]:
    """The counts ``n`` of the rows by ``keys`` and ``column``, with their ``label``; also the
    labelled distinct texts, for ``attach_by_text``.

    The rows are read once, to be counted; labels are joined with the counts.
    """
    by = list(dict.fromkeys([*keys, column]))
    counts = materialise(df.groupBy(*cols_of(by)).agg(F.count("*").alias("n")))
    labelled = label_texts(counts, column, rules, synonyms, stages, min_score, label, "n")
    joined = join_checked(counts, labelled.select(*cols_of([column, label])), [column])
    return joined.select(*cols_of([*by, "n", label])), labelled


def label_texts(
    df: DataFrame,
    column: str,
    rules: RuleTable,
    synonyms: Mapping[str, str] | None = None,
    stages: Sequence[str] = STAGES,
    min_score: float = 97,
    label: str = "theme",
    n: str | None = None,
) -> DataFrame:
    """The distinct texts with ``n``, their number of rows, and their label, computed once.

    A table of ``JOIN_FROM`` rules or more is met by joins, one of any size.
    """
    texts = distinct_texts(df, column, n)
    rules = computed_once(rules)
    if many(rules):
        texts = materialise(texts)
        found = matching.label_frame(
            texts, column, rule_frame(df.sparkSession, rules), synonyms, tuple(stages), min_score
        )
        named = found.select(col_of(column), F.col("label").alias(label))
        return materialise(texts.join(named, column, "left"))
    return materialise(
        texts.withColumn(label, label_of(column, rules, synonyms, stages, min_score))
    )


def distinct_texts(df: DataFrame, column: str, n: str | None = None) -> DataFrame:
    """The distinct texts with their number of rows ``n``, spread over all shuffle partitions.

    Matching a text costs far more than reading it, so the partitions must not be merged
    by their size in bytes, as adaptive execution would do after the counting alone.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = df.where(col_of(column).isNotNull())
    some = known.groupBy(col_of(column)).agg(rows_of(n).alias("n"))
    return some.repartition(partitions, col_of(column))


def attach_by_text(df: DataFrame, column: str, labelled: DataFrame, label: str) -> DataFrame:
    """Join labels back by text: broadcast if they are small, else with hot texts split.

    ``labelled`` has the text, its label and its number of rows ``n``.
    """
    labels = labelled.select(*cols_of([column, label]))
    others = [c for c in df.columns if c != label]
    joined = join_checked(df.select(*cols_of(others)), labels, [column], labelled)
    return joined.select(*cols_of([*others, label]))


def unmapped_texts(df: DataFrame, column: str, label: str) -> DataFrame:
    return (
        df.where(col_of(label).isNull() & col_of(column).isNotNull())
        .select(col_of(column).alias("cause"))
        .distinct()
        .orderBy("cause")
    )


def mapping_stats(df: DataFrame, label: str) -> DataFrame:
    """One row: rows with and without a label, and the mapped share in percent."""
    return df.agg(
        F.count(col_of(label)).alias("mapped"), F.count_if(col_of(label).isNull()).alias("unmapped")
    ).withColumn("mapped_pct", percent("mapped", F.col("mapped") + F.col("unmapped")))


def first_contains(
    df: DataFrame,
    column: str,
    rules: RuleTable,
    default: str,
    order: str = "first",
    label: str = "theme",
) -> DataFrame:
    """Label of the first rule contained in the text, else ``default``.

    ``order='longest'`` tries longer rules first, so that none is hidden by a part of it.
    """
    bare = strip(column)
    rules = computed_once(rules)
    if many(rules):
        return _first_contains_joined(df, column, rules, default, order, label)
    pairs = rule_list(rules)
    if order == "longest":
        pairs = sorted(pairs, key=lambda p: -len(p[0]))
    if len(pairs) <= CASE_LIMIT:
        hit = F.coalesce(*[F.when(bare.contains(p), F.lit(x)) for p, x in pairs])
    else:
        table = _rule_array(pairs)
        hit = F.get(F.filter(table, lambda r: bare.contains(r["pattern"])), F.lit(0))["label"]
    return df.withColumn(label, F.coalesce(hit, F.lit(default)))


def _first_contains_joined(
    df: DataFrame, column: str, rules: RuleTable, default: str, order: str, label: str
) -> DataFrame:
    """``first_contains`` of the distinct texts by joins, joined back to the rows."""
    table = rule_frame(df.sparkSession, rules)
    table = matching.longest_first(table) if order == "longest" else table
    texts = materialise(
        distinct_texts(df, column).select(col_of(column), "n", strip(column).alias("bare"))
    )
    hit = matching.first_contained(texts.select("bare"), "bare", table, order == "longest")
    hit = hit.select(F.col("text").alias("bare"), F.col("rule.label").alias("label"))
    named = texts.join(hit, "bare", "left").select(
        col_of(column), "n", F.coalesce("label", F.lit(default)).alias(label)
    )
    out = attach_by_text(df, column, materialise(named), label)
    return out.withColumn(label, F.coalesce(col_of(label), F.lit(default)))


def shadow_report(rules: DataFrame) -> DataFrame:
    """Rules that "first contains" never reaches, because an earlier one with another label
    is part of them: (pattern, label, ord, shadowed_by, shadow_label).

    ``ord`` is the number of the rule in the order of the table.
    """
    placed = materialise(_placed(rules))
    return matching.first_hidden(placed).where(F.col("rule.label") != F.col("label")).select(
        "pattern",
        "label",
        "ord",
        F.col("rule.pattern").alias("shadowed_by"),
        F.col("rule.label").alias("shadow_label"),
    )


def _placed(rules: DataFrame) -> DataFrame:
    """The rules with ``ord`` as their number from 0, by a range sort and the sizes of the ranges."""
    ranged = rules.select("pattern", "label", "ord").repartitionByRange("ord").sortWithinPartitions("ord")
    ranged = materialise(ranged.withColumn("at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    before, shift = 0, {}
    for row in sorted(sizes, key=lambda r: r["part"]):
        shift[row["part"]] = before - (row["part"] << 33)
        before += row["n"]
    if not shift:
        return ranged.select("pattern", "label", F.lit(0).alias("ord"))
    place = F.col("at") + F.element_at(
        constant({str(k): v for k, v in shift.items()}, "map<string, bigint>"),
        F.shiftright("at", 33).cast("string"),
    )
    return ranged.select("pattern", "label", place.cast("int").alias("ord"))


def rule_table(rules: DataFrame, label: str | None = None) -> DataFrame:
    """The published rule table: cause and theme, sorted, of one theme if given."""
    out = rules.select(F.col("pattern").alias("cause"), F.col("label").alias("theme"))
    return (out if label is None else out.where(F.col("theme") == label)).orderBy("theme", "cause")


def priority_class(
    df: DataFrame,
    cases: Sequence[tuple[str, str, Sequence[str]]],
    default: str,
    label: str = "factor",
) -> DataFrame:
    """First case (label, column, words) whose column contains one of the words, case ignored."""
    out = None
    for name, column, words in cases:
        text = F.lower(F.coalesce(col_of(column).cast("string"), F.lit("")))
        for word in words:
            test = text.contains(word)
            out = F.when(test, name) if out is None else out.when(test, name)
    return df.withColumn(label, F.lit(default) if out is None else out.otherwise(default))


def _keyword_hit(text: Column, themes: Mapping[str, Sequence[str]]) -> Column:
    """(token, label) of the first token that contains a keyword, themes in order."""
    table = constant(
        [{"label": k, "words": list(ws)} for k, ws in themes.items()],
        "array<struct<label: string, words: array<string>>>",
    )

    def theme(token: Column) -> Column:
        hit = F.filter(table, lambda r: F.exists(r["words"], lambda w: token.contains(w)))
        return F.struct(token.alias("token"), F.get(hit, F.lit(0))["label"].alias("label"))

    found = F.filter(F.transform(tokens(text), theme), lambda h: h["label"].isNotNull())
    return F.get(found, F.lit(0))


def _keyword_fuzzy(text: Column, themes: Mapping[str, Sequence[str]], min_score: float) -> Column:
    """(score, ..., label, token, word) of the best window of a token with a keyword."""
    words = [(label, word) for label, group in themes.items() for word in group]
    table = constant(
        [
            {"label": label, "place": -i, "entry": word_entry(word, min_score)}
            for i, (label, word) in enumerate(words)
        ],
        f"array<struct<label: string, place: int, entry: struct<{WORD_FIELDS}>>>",
    )

    def scored(token: Column, index: Column) -> Column:
        return F.transform(
            table,
            lambda r: F.struct(
                partial_ratio_to(token, r["entry"]).alias("score"),
                (-index).alias("token_place"),
                r["place"].alias("place"),
                r["label"].alias("label"),
                token.alias("token"),
                r["entry"]["word"].alias("word"),
            ),
        )

    usable = F.filter(tokens(text), lambda t: t != "")
    found = F.flatten(F.transform(usable, scored))
    return F.array_max(F.filter(found, lambda s: s["score"] >= F.lit(float(min_score))))


def _usable(text: Column) -> Column:
    return text.isNotNull() & (strip(text) != "") & (F.lower(text) != "nan")


def keyword_report(
    df: DataFrame,
    column: str,
    themes: Mapping[str, Sequence[str]],
    min_score: float = 85,
    other: str = "other",
    fuzzy: bool = True,
) -> DataFrame:
    """One row per distinct text: its number of rows ``n``, its theme and the reason for it."""
    text = F.col("cause")
    out = (
        distinct_texts(df, column)
        .select(col_of(column).alias("cause"), "n")
        .withColumn("hit", F.when(_usable(text), _keyword_hit(text, themes)))
    )
    open_text = _usable(text) & F.col("hit").isNull()
    near = _keyword_fuzzy(text, themes, min_score) if fuzzy else F.lit(None)
    out = out.withColumn("near", F.when(open_text, near))
    reason = F.when(~_usable(text), F.lit("empty input")).when(
        F.col("hit").isNotNull(), F.concat(F.lit("exact token '"), F.col("hit")["token"], F.lit("'"))
    )
    theme = F.col("hit")["label"]
    if fuzzy:
        reason = reason.when(
            F.col("near").isNotNull(),
            F.concat(
                F.lit("fuzzy "),
                F.format_string("%.0f", F.rint(F.col("near")["score"])),
                F.lit("% '"),
                F.col("near")["token"],
                F.lit("'≈'"),
                F.col("near")["word"],
                F.lit("'"),
            ),
        )
        theme = F.coalesce(theme, F.col("near")["label"])
    listed = F.concat(
        F.lit("no match, tokens=["),
        F.array_join(
            F.transform(tokens(text), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "
        ),
        F.lit("]"),
    )
    return out.select(
        "cause",
        "n",
        F.coalesce(theme, F.lit(other)).alias("theme"),
        reason.otherwise(listed).alias("reason"),
    )


def keyword_theme(
    df: DataFrame,
    column: str,
    themes: Mapping[str, Sequence[str]],
    min_score: float = 85,
    other: str = "other",
    label: str = "theme",
    fuzzy: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Theme by keywords in the tokens, else by the best partial ratio, else ``other``.

    Returns the labelled rows and the ``keyword_report``.
    """
    report = materialise(keyword_report(df, column, themes, min_score, other, fuzzy))
    labels = report.select(F.col("cause").alias(column), "n", F.col("theme").alias(label))
    out = attach_by_text(df, column, labels, label)
    return out.withColumn(label, F.coalesce(col_of(label), F.lit(other))), report
