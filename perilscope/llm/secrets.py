"""Secrets in texts: fixed patterns, and Markov models of random strings.

Patterns find what announces itself as a secret. For other long tokens, two first-order Markov
models over characters are compared: one of random strings, trained from the values that the
patterns find, and one of ordinary identifiers, trained from the other tokens of a sample of
documents. A token is a secret if its mean log-likelihood ratio is above a limit. Everything
is done with column expressions; places are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.columns import bind, constant
from perilscope.llm.frames import col_of, cols_of, computed_once, fresh, same, text_or_empty

ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Kind, pattern, the group whose length counts, and the least length.
PATTERNS = (
    ("assign", ASSIGN, 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)
#: Patterns that hold wherever the pattern of that kind has a match long enough.
HINTS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}"}
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
STATES = len(ALPHABET) + 1  # 0 stands for any other character
SPAN = "array<struct<start:int,kind:int,end:int>>"


@dataclass(frozen=True)
class Rules:
    """Limits of the Markov stage and of its training.

    ``sample_docs`` ids, those with the smallest hashes, give the ordinary identifiers, and
    ``sample_values`` different matches of the patterns the random strings, so that copies of
    one do not use up the sample. Ordinary tokens have ``ordinary_chars`` characters at most: what is long enough to be judged is not
    learned from, or unknown secrets would pass as ordinary.
    """

    token: str = "[A-Za-z0-9+/_=-]{20,}"
    ordinary: str = "[A-Za-z0-9+/_=-]{6,}"
    ordinary_chars: int = 19
    limit: float = 0.5
    sample_docs: int = 5_000
    sample_values: int = 20_000
    rare: float = 0.01
    backoff: float = 4.0


def spans_of(text: Column, pattern: str, group: int, least: int, kind: int, hint: str) -> Column:
    """The matches of a pattern as spans: matches follow one another, so their places are sums
    of the lengths of what stands before and between them."""
    sized = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda whole, part: F.struct(
            F.length(whole).alias("n"), (F.length(part) >= least).alias("ok")
        ),
    )
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.zip_with(gaps, sized, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    empty = F.array().cast(SPAN)
    found = F.aggregate(
        F.filter(steps, lambda s: s["m"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["m"]["n"]).alias("at"),
            F.when(
                s["m"]["ok"],
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            (a["at"] + s["gap"]).alias("start"), F.lit(kind).alias("kind"),
                            (a["at"] + s["gap"] + s["m"]["n"]).alias("end"),
                        )
                    ),
                ),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.regexp_like(text, F.lit(hint)), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns by start, then kind."""
    return F.array_sort(
        F.concat(
            *[
                spans_of(text, pattern, group, least, i, HINTS[kind])
                for i, (kind, pattern, group, least) in enumerate(PATTERNS)
            ]
        )
    )


def states_of(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def pairs_of(token: Column) -> Column:
    """The transitions of a token, each as one number."""
    return bind(
        states_of(token),
        lambda s: F.zip_with(
            F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: a * STATES + b
        ),
    )


def train(docs: DataFrame, id: str, text: str, rules: Rules) -> list[float]:
    """The log-likelihood ratio, random against ordinary, of each transition.

    A transition's share is mixed with that of its second character, which counts as much as
    ``backoff`` transitions; ``rare`` is spread over all characters. So a transition that neither
    sample has tells nothing.
    Random strings need a digit and 16 characters: an assigned plain word is a secret but not a
    random string.
    """
    whole = text_or_empty(text)
    values = F.concat(
        *[
            F.when(
                F.regexp_like(whole, F.lit(HINTS[kind])),
                F.regexp_extract_all(whole, F.lit(pattern), F.lit(group)),
            ).otherwise(F.array().cast("array<string>"))
            for kind, pattern, group, _ in PATTERNS
        ]
    )
    random = (
        docs.select(F.explode(values).alias("token"))
        .where((F.length("token") >= 16) & F.regexp_like("token", F.lit("[0-9]")))
        .distinct()
        .select("token", F.lit(1).alias("random"))
        .orderBy(F.xxhash64("token"), "token")
        .limit(rules.sample_values)
    )
    ids = docs.select(col_of(id).alias("sample_id")).where("sample_id is not null")
    ids = ids.distinct().orderBy(F.xxhash64("sample_id"), "sample_id").limit(rules.sample_docs)
    # what the patterns cover is cut out before the tokens are taken
    rest = whole
    for kind, pattern, _, _ in PATTERNS:
        rest = F.regexp_replace(rest, F.lit(pattern if kind == "assign" else HINTS[kind] + "+"), F.lit(" "))
    tokens = F.regexp_extract_all(rest, F.lit(rules.ordinary), F.lit(0))
    ordinary = docs.join(F.broadcast(ids), col_of(id) == F.col("sample_id"), "left_semi").select(
        F.explode(tokens).alias("token"), F.lit(0).alias("random")
    ).where(F.length("token") <= rules.ordinary_chars)
    counts = (
        random.union(ordinary)
        .select("random", F.explode(pairs_of(F.col("token"))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    logs = []
    for kind in (1, 0):
        seen = [[0] * STATES for _ in range(STATES)]
        for row in counts:
            if row["random"] == kind:
                seen[row["pair"] // STATES][row["pair"] % STATES] = row["count"]
        each = [sum(column) for column in zip(*seen)]
        share = [
            (1 - rules.rare) * n / max(sum(each), 1) + rules.rare / STATES for n in each
        ]
        logs.append(
            [
                math.log((n + rules.backoff * p) / (sum(after) + rules.backoff))
                for after in seen
                for n, p in zip(after, share)
            ]
        )
    return [round(a - b, 6) for a, b in zip(*logs)]


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio over the transitions of a token."""
    table = constant(model, "array<double>")
    return bind(
        pairs_of(token),
        lambda pairs: F.aggregate(
            pairs, F.lit(0.0), lambda a, p: a + F.get(table, p)
        ) / F.size(pairs),
    )


def scan(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    rules: Rules = Rules(),
    model: list[float] | None = None,
    into: str = "secrets",
) -> DataFrame:
    """``docs`` with the column ``into``: ``array<struct<start, kind, end>>``, by start and kind.

    ``kind`` counts ``KINDS``. The spans of the patterns are all there, also where they overlap;
    the Markov stage adds tokens that meet none of them. Null and empty texts have no spans;
    rows do not influence each other, but all of them share the model, which is trained on
    ``docs`` unless given. An existing column of the name is replaced.
    """
    model = train(docs, id, text, rules) if model is None else model
    keep = [c for c in docs.columns if c.lower() != into.lower()]
    base, more = fresh("base", keep), fresh("more", keep)
    whole = text_or_empty(text)
    found = docs.withColumn(base, computed_once(base_spans(whole))).withColumn(
        more, computed_once(spans_of(whole, rules.token, 0, 0, len(PATTERNS), rules.token))
    )
    free = F.filter(
        more,
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    likely = F.filter(
        free,
        lambda s: ratio(whole.substr(s["start"] + 1, s["end"] - s["start"]), model) > rules.limit,
    )
    every = F.array_sort(F.concat(col_of(base), likely))
    return found.select(*cols_of(keep), computed_once(every).alias(into))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping spans by one."""
    spans = fresh("spans", docs.columns)
    found = scan(docs, text=text, into=spans, **options)
    whole = text_or_empty(text)
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                (s["start"] >= a["at"]) | same(a["at"], F.lit(0)),
                F.concat(
                    a["out"],
                    whole.substr(a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))),
                    F.lit(mark),
                ),
            ).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], whole.substr(a["at"] + 1, F.length(whole))),
    )
    return found.withColumn(
        text, F.when(F.size(spans) > 0, cut).otherwise(col_of(text))
    ).select(*cols_of(docs.columns))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, separated by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )
