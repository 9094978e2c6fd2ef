"""Rule cascades, keyword themes, fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (
    CASCADE,
    INCIDENT,
    LCS,
    RULES,
    RULES_SQL,
    SYNONYMS,
    TOKENS_SQL,
    TWO_STAGES,
    cascade_sql,
    incident,
    near,
    table,
    texts_sql,
    themed,
)
from checks.registry import check, r, values
from perilscope.operators import rules

_TEXTS = texts_sql()


def _labelled(spark, folder, stages, min_score=97.0):
    df = incident(spark, folder, "row_key", "cause")
    return rules.classify(df, "cause", RULES, SYNONYMS, stages, min_score)


@check(
    f"""WITH {_TEXTS}
SELECT row_key, i.cause, label AS theme FROM incident i LEFT JOIN (
  SELECT cause, label FROM texts JOIN rules ON text = pattern) h ON i.cause = h.cause"""
)
def rule_exact(spark, folder):
    return _labelled(spark, folder, ("exact",))[0]


@check(
    f"""WITH {TWO_STAGES}
SELECT row_key, i.cause, label AS theme FROM incident i LEFT JOIN token_hit h ON i.cause = h.cause"""
)
def rule_token_contains(spark, folder):
    return _labelled(spark, folder, ("token",))[0]


@check(f"WITH {TWO_STAGES} SELECT row_key, cause, theme FROM themed")
def rule_cascade(spark, folder):
    return _labelled(spark, folder, ("exact", "token"))[0]


@check(f"WITH {TWO_STAGES} SELECT cause, theme FROM cascade")
def rule_cascade_by_row(spark, folder):
    """The cascade as a plain expression on the rows, as a stream would use it."""
    df = incident(spark, folder, "cause").where("cause IS NOT NULL").distinct()
    return df.withColumn("theme", rules.label_of("cause", RULES, SYNONYMS, ("exact", "token")))


@check(f"WITH RECURSIVE {CASCADE} SELECT cause FROM cascade WHERE theme IS NULL")
def rule_unmapped(spark, folder):
    return _labelled(spark, folder, rules.STAGES)[1]


@check(
    f"""WITH RECURSIVE {CASCADE}
SELECT count(theme) AS mapped, count(*) FILTER (WHERE theme IS NULL) AS unmapped,
       {r("count(theme)::DOUBLE / count(*) * 100", 1)} AS mapped_pct FROM themed"""
)
def rule_mapping_stats(spark, folder):
    return rules.mapping_stats(themed(spark, folder, "row_key"), "theme")


_WORDS = [
    ("Licensed", "license"), ("http", "link"), ("@", "mail"), ("der ", "german"),
    (" le ", "french"), (" el ", "spanish"), (" the", "english"),
]
_WORDS_SQL = " ".join(f"WHEN contains(text, '{p}') THEN '{x}'" for p, x in _WORDS)


@check(f"SELECT doc_id, CASE {_WORDS_SQL} ELSE 'plain' END AS theme FROM documents")
def rule_first_contains(spark, folder):
    df = table(spark, folder, "documents").select("doc_id", "text")
    return rules.first_contains(df, "text", _WORDS, "plain").drop("text")


@check(
    f"""WITH {INCIDENT}, {RULES_SQL},
hit AS (
  SELECT cause, arg_min(label, -length(pattern) * 1000 + ord) AS label
  FROM (SELECT DISTINCT trim(cause) AS cause FROM incident) JOIN rules ON contains(cause, pattern)
  GROUP BY cause
)
SELECT row_key, coalesce(label, 'Handling') AS theme
FROM incident i LEFT JOIN hit h ON i.cause = h.cause"""
)
def rule_longest_contains(spark, folder):
    df = incident(spark, folder, "row_key", "cause")
    return rules.first_contains(df, "cause", RULES, "Handling", "longest").drop("cause")


@check(
    f"""WITH {INCIDENT}, t AS (
  SELECT row_key, lower(coalesce(cause, '')) AS c, lower(coalesce(surface, '')) AS s FROM incident)
SELECT row_key, CASE
  WHEN contains(c, 'ring') OR contains(c, 'promo') THEN 'Environment'
  WHEN contains(c, 'gear') OR contains(c, 'bolt') THEN 'Machine'
  WHEN contains(c, 'red ') THEN 'Method' WHEN contains(s, 'f') THEN 'Surface' ELSE 'Man' END AS factor
FROM t"""
)
def rule_priority(spark, folder):
    df = incident(spark, folder, "row_key", "cause", "surface")
    cases = [
        ("Environment", "cause", ["ring", "promo"]), ("Machine", "cause", ["gear", "bolt"]),
        ("Method", "cause", ["red "]), ("Surface", "surface", ["f"]),
    ]
    return rules.priority_class(df, cases, "Man").select("row_key", "factor")


_PART_RULES = """SELECT CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END
    AS pattern, p_brand, p_partkey FROM part"""


def _part_rules(spark, folder):
    return (
        table(spark, folder, "part")
        .select(
            F.when(F.col("p_partkey") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(2)))
            .otherwise(F.col("p_name")).alias("pattern"),
            "p_brand", "p_partkey",
        )
        .groupBy("pattern")
        .agg(F.min("p_brand").alias("label"), F.min("p_partkey").alias("ord"))
    )


_PART_RULES_SQL = f"""named AS ({_PART_RULES}),
rules AS (
  SELECT pattern, min(p_brand) AS label, min(p_partkey) AS ord FROM named GROUP BY pattern
)"""


@check(
    f"""WITH {_PART_RULES_SQL},
placed AS (SELECT pattern, label, (row_number() OVER (ORDER BY ord) - 1)::INT AS ord FROM rules),
first AS (
  SELECT a.pattern, a.label, a.ord, arg_min(b.pattern, b.ord) AS shadowed_by,
         arg_min(b.label, b.ord) AS shadow_label
  FROM placed a JOIN placed b ON b.ord < a.ord AND contains(a.pattern, b.pattern)
  GROUP BY ALL
)
SELECT * FROM first WHERE label <> shadow_label"""
)
def rule_shadow_report(spark, folder):
    return rules.shadow_report(_part_rules(spark, folder))


@check(
    f"""WITH {_PART_RULES_SQL}
SELECT pattern AS cause, label AS theme FROM rules WHERE label = 'Brand#1'"""
)
def rule_table(spark, folder):
    return rules.rule_table(_part_rules(spark, folder), "Brand#1")


@check(
    f"""WITH RECURSIVE {_TEXTS},
cand AS (
  SELECT DISTINCT text AS a, pattern AS b FROM texts JOIN rules ON {near("text", "pattern", 97)}
),
{LCS},
hit AS (
  SELECT cause, arg_max(label, score * 1000 - ord) AS label
  FROM texts JOIN scored ON text = a JOIN rules ON b = pattern WHERE score >= 97 GROUP BY cause
)
SELECT row_key, i.cause, label AS theme FROM incident i LEFT JOIN hit h ON i.cause = h.cause"""
)
def rule_fuzzy(spark, folder):
    return _labelled(spark, folder, ("exact", "fuzzy"))[0]


@check(
    f"""WITH RECURSIVE {_TEXTS},
cand AS (
  SELECT DISTINCT token AS a, pattern AS b FROM tokened JOIN rules ON {near("token", "pattern", 70)}
),
{LCS},
hit AS (
  SELECT cause, label,
         row_number() OVER (PARTITION BY cause ORDER BY score DESC, pos, ord) AS place
  FROM tokened JOIN scored ON token = a JOIN rules ON b = pattern WHERE score >= 70
)
SELECT row_key, i.cause, label AS theme
FROM incident i LEFT JOIN (FROM hit WHERE place = 1) h ON i.cause = h.cause"""
)
def token_fuzzy(spark, folder):
    return _labelled(spark, folder, ("token_fuzzy",), 70.0)[0]


@check(f"WITH RECURSIVE {CASCADE} SELECT cause, theme FROM cascade")
def rule_full_cascade(spark, folder):
    df = incident(spark, folder, "cause").where("cause IS NOT NULL").distinct()
    return rules.classify(df, "cause", RULES, SYNONYMS)[0]


def _many_rules(size: int = 148) -> list[tuple[str, str]]:
    """A rule table of the size of the largest one in use: the rules above and whole texts."""
    themes = ["Handling", "Attention", "Road", "Speed"]
    texts = [
        f"{kind} {part} (Brand#{brand})/{sort}"
        for brand in range(1, 26)
        for kind, part, sort in (
            ("small", "lever", "large"), ("new", "bracket", "promo"), ("cold", "sprocket", "standard"),
            ("blue", "cog", "economyy"), ("red", "anvill", "smal"), ("old", "rod", "large"),
        )
    ]
    more = [(t, themes[i % 4]) for i, t in enumerate(texts)]
    return [*RULES, *more][:size]


_MANY_SQL = values("rules", "pattern, label, ord", [(p, x, i) for i, (p, x) in enumerate(_many_rules())])


@check(f"WITH RECURSIVE {cascade_sql(_MANY_SQL)} SELECT row_key, cause, theme FROM themed")
def rule_cascade_148(spark, folder):
    df = incident(spark, folder, "row_key", "cause")
    return rules.classify(df, "cause", _many_rules(), SYNONYMS)[0]


# a rule table that grows with the data, far too large for a literal: all words of the documents
_WORD_RULES_SQL = r"""rules AS (
  SELECT pattern, min(coalesce(lang, 'none')) AS label, min(doc_id) AS ord
  FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS pattern
        FROM documents)
  GROUP BY pattern
)"""


def _word_rules(spark, folder):
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = table(spark, folder, "documents").select(
        "doc_id", F.coalesce("lang", F.lit("none")).alias("label"), F.explode(words).alias("pattern")
    )
    # the least of numbers needs no sort; that of labels does, and gets each one of a word once
    labelled = docs.groupBy("pattern", "label").agg(F.min("doc_id").alias("ord"))
    return labelled.groupBy("pattern").agg(F.min("label").alias("label"), F.min("ord").alias("ord"))


@check(
    f"""WITH {_WORD_RULES_SQL},
hit AS (
  SELECT text, label,
         row_number() OVER (PARTITION BY text ORDER BY length(pattern) DESC, ord, label, pattern) AS place
  FROM (SELECT DISTINCT text, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS bare FROM conversations)
  JOIN rules ON contains(bare, pattern)
)
SELECT conv_id, turn, coalesce(label, 'none of them') AS theme
FROM conversations c LEFT JOIN (FROM hit WHERE place = 1) h ON c.text = h.text"""
)
def rule_words_contained(spark, folder):
    """The longest of some 95,000 rules (at sf0.01) that stands in each message."""
    df = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    themed_ = rules.first_contains(df, "text", _word_rules(spark, folder), "none of them", "longest")
    return themed_.drop("text")


_PAGE_TOKENS_SQL = f"""split AS (
  SELECT url, {TOKENS_SQL.format("url")} AS toks FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)
),
tokened AS (SELECT url, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM split)"""


@check(
    f"""WITH {_WORD_RULES_SQL}, {_PAGE_TOKENS_SQL},
touch AS (
  SELECT t.token, label, ord, pattern
  FROM (SELECT DISTINCT token FROM tokened) t
  JOIN rules ON contains(pattern, t.token) OR contains(t.token, pattern)
),
hit AS (
  SELECT url, label, row_number() OVER (PARTITION BY url ORDER BY pos, ord, label, pattern) AS place
  FROM tokened JOIN touch USING (token)
)
SELECT page_id, label AS theme
FROM pages p LEFT JOIN (FROM hit WHERE place = 1) h ON p.url = h.url"""
)
def rule_words_touching(spark, folder):
    """The first part of each address with a rule in it, or that is part of a rule."""
    df = table(spark, folder, "pages").select("page_id", "url")
    return rules.classify(df, "url", _word_rules(spark, folder), None, ("exact", "token"))[0].drop("url")


# every text of a part as a rule, with one character left out
_ONE_OFF_SQL = """p_all AS (
  SELECT concat(p_name, ' (', p_brand, ')/', lower(p_type)) AS t, p_brand, p_partkey FROM part
),
one_off AS (
  SELECT substr(t, 1, (p_partkey % length(t))::INT) || substr(t, (p_partkey % length(t))::INT + 2) AS pattern,
    p_brand, p_partkey FROM p_all
),
rules AS (
  SELECT pattern, min(p_brand) AS label, min(p_partkey) AS ord FROM one_off GROUP BY pattern
)"""


def _one_off_rules(spark, folder):
    text = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")/"), F.lower("p_type"))
    at = (F.col("p_partkey") % F.length("t")).cast("int")
    left_out = F.concat(F.substring("t", F.lit(1), at), F.substring("t", at + 2, F.length("t")))
    parts = table(spark, folder, "part").select(text.alias("t"), "p_brand", "p_partkey")
    return parts.groupBy(left_out.alias("pattern")).agg(
        F.min("p_brand").alias("label"), F.min("p_partkey").alias("ord")
    )


@check(
    f"""WITH RECURSIVE {texts_sql(_ONE_OFF_SQL)},
cand AS (
  SELECT DISTINCT text AS a, pattern AS b FROM texts JOIN rules ON {near("text", "pattern", 97)}
),
{LCS},
hit AS (
  SELECT cause, label, row_number() OVER (PARTITION BY cause ORDER BY score DESC, ord, label DESC, b DESC) AS place
  FROM texts JOIN scored ON text = a JOIN rules ON b = pattern WHERE score >= 97
)
SELECT row_key, i.cause, label AS theme
FROM incident i LEFT JOIN (FROM hit WHERE place = 1) h ON i.cause = h.cause"""
)
def rule_fuzzy_indexed(spark, folder):
    """As many rules as parts: a text is scored with those that share a segment with it."""
    df = incident(spark, folder, "row_key", "cause")
    return rules.classify(df, "cause", _one_off_rules(spark, folder), SYNONYMS, ("fuzzy",))[0]


KEYWORDS = {
    "Forged": ["anvyl", "hot"],
    "Fixing": ["bolts", "old bolt"],
    "Motion": ["gear", "small giz"],
    "Sheet": ["plaate"],
    "Round": ["rings", "economic"],
}
_placed = [(t, w, i) for i, (t, ws) in enumerate(KEYWORDS.items()) for w in ws]
_KEYWORDS_SQL = values(
    "keywords", "theme, word, theme_ord, place", [(*k, n) for n, k in enumerate(_placed)]
)

_EXACT_KEYWORD = """exact_hit AS (
  SELECT cause, theme, token,
         row_number() OVER (PARTITION BY cause ORDER BY pos, theme_ord) AS place
  FROM tokened JOIN keywords ON contains(token, word)
)"""
_CAUSES = f"""{INCIDENT},
{_KEYWORDS_SQL},
split AS (
  SELECT cause, {TOKENS_SQL.format("cause")} AS toks
  FROM (SELECT DISTINCT cause FROM incident WHERE cause IS NOT NULL)
),
tokened AS (
  SELECT cause, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM split
)"""
_KEYWORD_REPORT = f"""{_CAUSES},
{_EXACT_KEYWORD},
sides AS (
  SELECT DISTINCT token, word, token AS short, word AS long FROM tokened, keywords
  WHERE length(token) <= length(word)
  UNION
  SELECT DISTINCT token, word, word, token FROM tokened, keywords WHERE length(word) <= length(token)
),
starts AS (
  SELECT *, unnest(range(2 - length(short), length(long) + 1)) AS st FROM sides
),
cuts AS (
  SELECT token, word, short AS a,
    substr(long, greatest(st, 1)::INT, (length(short) - greatest(1 - st, 0))::INT) AS b
  FROM starts
),
cand AS (SELECT DISTINCT a, b FROM cuts),
{LCS},
partial AS (
  SELECT token, word, max(score) AS score FROM cuts JOIN scored USING (a, b) GROUP BY token, word
),
near AS (
  SELECT cause, theme, token, word, score,
         row_number() OVER (PARTITION BY cause ORDER BY score DESC, pos, place) AS rank
  FROM tokened JOIN partial USING (token) JOIN keywords USING (word) WHERE score >= 85
),
report AS (
  SELECT s.cause, coalesce(e.theme, n.theme, 'other') AS theme,
    CASE WHEN e.theme IS NOT NULL THEN 'exact token ''' || e.token || ''''
         WHEN n.theme IS NOT NULL THEN 'fuzzy ' || round_even(n.score, 0)::INT || '% ''' ||
              n.token || '''≈''' || n.word || ''''
         ELSE 'no match, tokens=[' ||
              array_to_string(list_transform(toks, lambda t: '''' || t || ''''), ', ') || ']'
         END AS reason
  FROM split s LEFT JOIN (FROM exact_hit WHERE place = 1) e ON s.cause = e.cause
  LEFT JOIN (FROM near WHERE rank = 1) n ON s.cause = n.cause
)"""


@check(f"WITH RECURSIVE {_KEYWORD_REPORT} SELECT * FROM report")
def keyword_fuzzy(spark, folder):
    report = rules.keyword_report(incident(spark, folder, "cause"), "cause", KEYWORDS)
    return report.drop("n")


@check(
    f"""WITH RECURSIVE {_KEYWORD_REPORT}
SELECT row_key, coalesce(theme, 'other') AS theme
FROM incident i LEFT JOIN report p ON i.cause = p.cause"""
)
def keyword_theme(spark, folder):
    df = incident(spark, folder, "row_key", "cause")
    return rules.keyword_theme(df, "cause", KEYWORDS)[0].drop("cause")


_TALK = {"Polite": ["please", "bitte"], "Greek": ["éa"], "Question": ["?", "why"], "Else": ["the "]}
_TALK_SQL = " ".join(
    f"WHEN {' OR '.join(f'contains(token, {w!r})' for w in ws)} THEN '{t}'" for t, ws in _TALK.items()
)


@check(
    f"""WITH split AS (
  SELECT conv_id, turn, text, {TOKENS_SQL.format("text")} AS toks FROM conversations
),
tokened AS (
  SELECT text, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM split
),
hit AS (
  SELECT text, arg_min(theme, pos) AS theme
  FROM (SELECT text, pos, CASE {_TALK_SQL} END AS theme FROM tokened)
  WHERE theme IS NOT NULL GROUP BY text
)
SELECT conv_id, turn, coalesce(theme, 'other') AS theme
FROM conversations c LEFT JOIN hit h ON c.text = h.text"""
)
def keyword_theme_conversations(spark, folder):
    df = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return rules.keyword_theme(df, "text", _TALK)[0].drop("text")
