"""Rule tables of any size as frames: which rule is in a text, which text is in a rule, which is
nearly equal.

A rule table that is a literal of the plan compares every text with every rule. Here both sides
are cut into pieces that must be equal where there is a match, and met by equi-joins: a text
meets only the rules with which it has such a piece in common.

- Containment: a text is looked up at each of its places by the next ``GRAM`` characters among
  the beginnings of the rules, which gives the lengths of the rules that begin so; the parts of
  these lengths are looked up among the rules. No pair is made that does not match. Rules without
  blanks are met with the distinct words of the texts, not with each text.
- Nearly equal texts: of ``k`` edits at most ``k`` of ``k + 1`` segments of a rule are touched.
  Texts are looked up by the parts that can be an untouched segment, by its number, its place and
  the length of the rule (partition-based joins, as in Li et al. 2011, "Pass-Join").

Rules are aggregated to one row for each pattern, the first in order, so that no key of theirs
repeats; tables of them are broadcast within a checked size and shuffled beyond it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.columns import col_of
from perilscope.functions.similarity import allowed_edits, char_masks, ratio_from_masks
from perilscope.functions.text import replace_synonym, tokens
from perilscope.operators.joins import fits_broadcast, join_checked
from perilscope.session import materialise

#: Characters by which a place of a text is looked up first.
GRAM = 4
#: Places of a long text that are cut out at a time.
CHUNK = 512
#: What stands between words.
BLANK = r"[\x20\x09-\x0D]+"
#: Segments shorter than this are shared by nearly all texts; all rules of a length are compared.
SEGMENT = 2


def first_rules(rules: DataFrame) -> DataFrame:
    """The first rule in order (``ord``, then label) of each pattern that is not empty: ``pattern``, ``label``, ``ord``."""
    known = rules.where(F.col("pattern").isNotNull() & (F.col("pattern") != ""))
    best = known.groupBy("pattern").agg(F.min(F.struct("ord", "label")).alias("rule"))
    return best.select("pattern", "rule.label", "rule.ord")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def numbered(texts: DataFrame, text: str) -> DataFrame:
    """The distinct texts that are not empty, with a number ``key`` that stays the same."""
    subject = texts.select(col_of(text).alias("text")).where("text is not null and text <> ''")
    return materialise(subject.distinct().withColumn("key", F.monotonically_increasing_id()))


def ranked(rules: DataFrame) -> DataFrame:
    """``first_rules`` with a ``rank`` that grows in their order: ord, label, pattern. The least
    of many ranks is found by a plain hash aggregate, before any shuffle."""
    order = ["ord", "label", "pattern"]
    dealt = first_rules(rules).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(dealt.withColumn("rank", F.monotonically_increasing_id()))


def contained(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """``key`` of a text of ``texts`` (``text``, ``key``) with the row of ``parts`` whose ``part``
    stands in it, for all of them; a part that stands there more than once may come again.

    Parts are distinct and not empty; one of fewer than ``GRAM`` characters is its own beginning.
    Long texts are cut into chunks, each with what a part that begins in it may still take. Of a
    text with a number ``least``, parts with fewer characters than that are left out.
    """
    least = F.col("least") if "least" in texts.columns else F.lit(0)
    longest = texts.agg(F.max(F.length("text"))).first()[0] or 0
    given = materialise(parts.where(F.length("part") <= longest))
    most = given.agg(F.max(F.length("part"))).first()[0] or 1
    lengths = materialise(
        given.groupBy(F.substring("part", 1, GRAM).alias("gram"))
        .agg(F.collect_set(F.length("part")).alias("lengths"))
    )
    sizes = [r[0] for r in lengths.select(F.length("gram")).distinct().collect()]
    starts = F.sequence(F.lit(1), F.length("text"), F.lit(CHUNK))
    chunks = texts.select(
        "key", least.alias("least"),
        F.explode(
            F.transform(
                starts,
                lambda at: F.struct(
                    F.substring(F.col("text"), at, F.lit(CHUNK + most - 1)).alias("chunk"),
                    F.least(F.lit(CHUNK), F.length("text") - at + 1).alias("places"),
                ),
            )
        ).alias("c"),
    )
    places = chunks.select(
        "key", "least", F.col("c.chunk").alias("chunk"),
        F.explode(F.sequence(F.lit(1), "c.places")).alias("place"),
    )
    # what begins at a place, no longer than the longest part
    begun = places.select("key", "least", F.substring("chunk", F.col("place"), F.lit(most)).alias("rest"))
    # a beginning shorter than it should be is that of a smaller size, if there is one
    asked = F.explode(F.lit(sizes).cast("array<int>")).alias("size")
    heads = begun.where(F.length("rest") >= F.col("least")).select("key", "least", "rest", asked)
    heads = heads.where(F.length("rest") >= F.col("size")).select(
        "key", "least", "rest", F.substring("rest", F.lit(1), F.col("size")).alias("gram")
    )
    flat = lengths.select("gram", F.explode("lengths").alias("length"))
    met = heads.join(F.broadcast(lengths) if fits_broadcast(flat) else lengths, "gram")
    cut = met.select("key", "least", "rest", F.explode("lengths").alias("length")).where(
        (F.col("length") <= F.length("rest")) & (F.col("length") >= F.col("least"))
    )
    found = cut.select("key", F.substring("rest", F.lit(1), F.col("length")).alias("part"))
    return found.join(_sized(given), "part")


def _ruled(known: DataFrame) -> DataFrame:
    return known.select("pattern", F.struct("ord", "label", "pattern").alias("rule"))


def _by_rank(best: DataFrame, known: DataFrame) -> DataFrame:
    """``text`` and ``rule`` for ``text`` and ``rank``, the rank of the first rule of each text."""
    first = best.groupBy("text").agg(F.min("rank").alias("rank"))
    rules = known.select("rank", F.struct("ord", "label", "pattern").alias("rule"))
    return first.join(rules, "rank").select("text", "rule")


def first_contained(
    texts: DataFrame, text: str, rules: DataFrame, longest: bool = False
) -> DataFrame:
    """``text`` and ``rule``, the first one (a struct of ord, label and pattern) whose pattern
    stands in it, for the distinct texts that have one.

    A rule without blanks stands in a text where it stands in one of its words: these rules are
    met with the distinct words, and only the others with whole texts. ``longest`` says that a
    longer rule always comes before a shorter one. Then the words that are rules themselves need
    no search, and the longest of them leaves only longer words and rules to be looked for.
    """
    known = ranked(rules)
    blank = F.col("pattern").rlike(BLANK)
    return _by_rank(_ranks_in(numbered(texts, text), known, blank, longest), known)


def _ranks_in(subject: DataFrame, known: DataFrame, blank: Column, longest: bool) -> DataFrame:
    """``text`` and the ``rank`` of rules in it, the first one among them."""
    bare = known.where(~blank).select(F.col("pattern").alias("part"), "rank")
    spaced = materialise(known.where(blank).select(F.col("pattern").alias("part"), "rank"))
    words = subject.select(
        "key", F.explode(F.array_distinct(F.split("text", BLANK))).alias("word")
    ).where("word <> ''")
    hits = []
    if longest:
        # the words that are rules, the longest of them, and the words that may hold a longer one
        met = words.join(bare.withColumnRenamed("part", "word"), "word", "left")
        own = materialise(
            met.groupBy("key").agg(
                F.min("rank").alias("rank"),
                F.coalesce(F.max(F.when(F.col("rank").isNotNull(), F.length("word"))), F.lit(0)).alias("least"),
                F.collect_list(F.when(F.col("rank").isNull(), F.col("word"))).alias("others"),
            )
        )
        hits.append(own.where("rank is not null").select("key", "rank"))
        words = own.select("key", "least", F.explode("others").alias("word")).where(
            F.length("word") > F.col("least")
        )
        subject = subject.join(own.select("key", "least"), "key", "left").na.fill(0, ["least"])
    else:
        words = words.withColumn("least", F.lit(0))
    words = materialise(words)
    distinct = words.groupBy(F.col("word").alias("text")).agg(F.min("least").alias("least"))
    distinct = materialise(distinct.withColumn("key", F.monotonically_increasing_id()))
    in_words = contained(distinct, bare).groupBy("key").agg(F.min("rank").alias("rank"))
    of_words = distinct.join(in_words, "key").select(F.col("text").alias("word"), "rank")
    hits.append(words.join(of_words, "word").select("key", "rank"))
    if not spaced.isEmpty():
        hits.append(contained(subject, spaced).select("key", "rank"))
    first = reduce(DataFrame.union, hits).groupBy("key").agg(F.min("rank").alias("rank"))
    return subject.join(first, "key").select("text", "rank")


def first_touching(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """As ``first_contained``, of the rules whose pattern stands in the text or has it in itself."""
    return _touching(texts, text, ranked(rules))


def _touching(texts: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """``first_touching`` of ``ranked`` rules."""
    blank = F.col("pattern").rlike(BLANK)
    inside = _ranks_in(numbered(texts, text), known, blank, False)
    # here a rule is the text, and its rank the key
    subject = known.select(F.col("pattern").alias("text"), F.col("rank").alias("key"))
    parts = texts.select(col_of(text).alias("part")).where("part is not null and part <> ''").distinct()
    around = contained(subject, parts).groupBy("part").agg(F.min("key").alias("rank"))
    return _by_rank(inside.union(around.select(F.col("part").alias("text"), "rank")), known)


def first_equal(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """As ``first_contained``, of the rule whose pattern is the text."""
    return _equal(texts, text, first_rules(rules))


def _equal(texts: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """``first_equal`` of ``first_rules``; a few texts are sent to the rules, not rules to them."""
    subject = texts.select(col_of(text).alias("text")).where("text is not null").distinct()
    return _ruled(known).withColumnRenamed("pattern", "text").join(_sized(subject), "text")


def first_hidden(rules: DataFrame) -> DataFrame:
    """``pattern``, ``label``, ``ord`` of each rule that has an earlier one in its pattern, with
    the first such one as ``rule``."""
    known = materialise(rules.select("pattern", "label", "ord"))
    first = first_contained(known, "pattern", known).withColumnRenamed("text", "pattern")
    return known.join(first, "pattern").where(F.col("rule.ord") < F.col("ord"))


def segment_count(length: Column, min_score: float) -> Column:
    """Segments of a rule: one more than the insertions and deletions that leave ``min_score``.

    A text that is ``r`` or more alike has at most ``length * (2 / r - 1)`` characters.
    """
    total = 2 * length / (min_score / 100.0)
    return allowed_edits(total, min_score) + 1


def nearest(texts: DataFrame, text: str, rules: DataFrame, min_score: float) -> DataFrame:
    """``text`` and ``best``, (score, -ord, label, pattern) of the rule that is most similar from
    ``min_score`` on, the first of equally similar ones, for the distinct texts that have one."""
    return _nearest(texts, text, first_rules(rules), min_score)


def _nearest(texts: DataFrame, text: str, known: DataFrame, min_score: float) -> DataFrame:
    """``nearest`` of ``first_rules``."""
    pairs = near_pairs(texts, text, known, min_score)
    scored = join_checked(pairs, known, ["pattern"]).select(
        "text", F.struct("score", (-F.col("ord")).alias("place"), "label", "pattern").alias("best")
    )
    return scored.groupBy("text").agg(F.max("best").alias("best"))


def candidates(texts: DataFrame, text: str, known: DataFrame, min_score: float) -> DataFrame:
    """Distinct pairs (``text``, ``pattern``) among which are all that reach ``min_score``.

    ``k + 1`` segments of a pattern as even as can be, the longer ones last. A segment that no
    edit touched stands in the text at most ``k`` places from its own. Rules whose segments
    would have fewer than ``SEGMENT`` characters are met by their length alone, which is all
    that so low a score asks of them.
    """
    if min_score < 1:
        raise ValueError("min_score must be 1 or more")
    ratio = min_score / 100.0
    rules = known.select("pattern", F.length("pattern").alias("length"))
    cut = rules.withColumn("count", segment_count(F.col("length"), min_score))
    short = F.col("length") < F.col("count") * SEGMENT

    def bounds(i: Column, length: Column, count: Column) -> Column:
        return F.floor(i * length / count).cast("int")

    def segments(value: Column, length: Column, count: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(
                i.alias("i"),
                F.substring(
                    value, bounds(i, length, count) + 1,
                    bounds(i + 1, length, count) - bounds(i, length, count),
                ).alias("piece"),
            ),
        )

    whole = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("piece")))
    filed = cut.select(
        "pattern", "length",
        F.explode(
            F.when(short, whole).otherwise(segments(F.col("pattern"), F.col("length"), F.col("count")))
        ).alias("s"),
    ).select("pattern", "length", "s.i", "s.piece")
    filed = materialise(filed)
    present = materialise(cut.select("length", "count", short.alias("short")).distinct())
    subject = texts.select(col_of(text).alias("text")).where("text is not null and text <> ''").distinct()
    own = F.length("text")
    # the lengths of the rules there are, of which a text meets those near its own
    sized = subject.join(
        F.broadcast(present),
        (F.col("length") >= F.ceil(own * (ratio / (2 - ratio)) - 1e-9))
        & (F.col("length") <= F.floor(own * ((2 - ratio) / ratio) + 1e-9)),
    )

    def asked(count: Column) -> Column:
        def of_segment(i: Column) -> Column:
            begin, end = bounds(i, F.col("length"), count), bounds(i + 1, F.col("length"), count)
            low = F.greatest(begin - count + 1, F.lit(0))
            high = F.least(begin + count - 1, own - (end - begin))
            return F.when(
                low <= high,
                F.transform(
                    F.sequence(low, F.greatest(low, high)),
                    lambda at: F.struct(
                        i.alias("i"), F.substring(F.col("text"), at + 1, end - begin).alias("piece")
                    ),
                ),
            ).otherwise(F.array())

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), count - 1), of_segment)))

    looked = sized.select(
        "text", "length",
        F.explode(F.when(F.col("short"), whole).otherwise(asked(F.col("count")))).alias("s"),
    ).select("text", "length", "s.i", "s.piece")
    met = looked.join(_sized(filed), ["length", "i", "piece"])
    # the edit distance is at most the number of insertions and deletions: a bounded one, which
    # is cheap, rules out most pairs that meet before any is shuffled or scored
    allowed = allowed_edits(F.length("text") + F.length("pattern"), min_score)
    close = met.where(F.call_function("levenshtein", F.col("text"), F.col("pattern"), allowed) >= 0)
    return close.select("text", "pattern").distinct()


def near_pairs(texts: DataFrame, text: str, known: DataFrame, min_score: float) -> DataFrame:
    """``text``, ``pattern`` and ``score`` of all pairs of at least ``min_score``."""
    close = materialise(candidates(texts, text, known, min_score))
    # the table of a rule's characters is made once, not for every text
    masks = materialise(close.select("pattern").distinct().withColumn("masks", char_masks("pattern")))
    score = ratio_from_masks(F.col("text"), F.col("masks"), F.length("pattern"))
    scored = close.join(masks, "pattern").select("text", "pattern", score.alias("score"))
    return scored.where(F.col("score") >= float(min_score))


def label_frame(
    df: DataFrame,
    text: str,
    rules: DataFrame,
    synonyms: dict[str, str] | None = None,
    stages: tuple[str, ...] = ("exact", "token", "fuzzy", "token_fuzzy"),
    min_score: float = 97,
    min_token_len: int = 1,
) -> DataFrame:
    """``text`` and ``label`` of the distinct texts of ``df`` that a stage of the cascade labels.

    A stage gets the texts that no earlier one has labelled; the result is computed once, and so
    are the rules and what each stage finds, which is measured before it is joined.
    """
    open_ = df.select(col_of(text).alias("cause")).where("cause is not null").distinct()
    open_ = materialise(open_.withColumn("said", replace_synonym("cause", synonyms)))
    known = ranked(rules) if "token" in stages else materialise(first_rules(rules))
    done = None
    for stage in stages:
        if stage == "exact":
            hit = _equal(open_, "said", known).select(F.col("text").alias("said"), "rule.label")
            found = join_checked(open_, materialise(hit), ["said"])
        elif stage == "fuzzy":
            hit = _nearest(open_, "said", known, min_score)
            hit = hit.select(F.col("text").alias("said"), "best.label")
            found = join_checked(open_, materialise(hit), ["said"])
        else:
            found = _by_token(open_, known, stage, min_score, min_token_len)
        found = materialise(found.select("cause", "said", "label"))
        labelled = found.where("label is not null").select("cause", "label")
        done = labelled if done is None else done.union(labelled)
        open_ = found.where("label is null").select("cause", "said")
    return done.withColumnRenamed("cause", text)


def _by_token(
    open_: DataFrame, known: DataFrame, stage: str, min_score: float, min_token_len: int
) -> DataFrame:
    """``open_`` with the ``label`` of the first token that touches a rule, or of the best one."""
    least = max(1, min_token_len) if stage == "token" else 1
    usable = F.filter(tokens("said"), lambda t: F.length(t) >= least)
    said = materialise(open_.select("cause", "said", F.posexplode(usable).alias("pos", "token")))
    if stage == "token":
        hit = _touching(said, "token", known).select(F.col("text").alias("token"), "rule")
        met = join_checked(said, materialise(hit), ["token"]).where("rule is not null")
        best = met.groupBy("cause").agg(F.min(F.struct("pos", "rule")).alias("b"))
        label = F.col("b.rule.label")
    else:
        hit = _nearest(said, "token", known, min_score).select(F.col("text").alias("token"), "best")
        met = join_checked(said, materialise(hit), ["token"]).where("best is not null")
        key = F.struct("best.score", (-F.col("pos")).alias("pos"), "best.place", "best.label")
        best = met.groupBy("cause").agg(F.max(key).alias("b"))
        label = F.col("b.label")
    return open_.join(best.select("cause", label.alias("label")), "cause", "left")


def longest_first(rules: DataFrame) -> DataFrame:
    """The rules in the order of falling length, equal ones in their own."""
    order = F.struct((-F.length("pattern")).alias("length"), F.col("ord").alias("ord"))
    return rules.select("pattern", "label", order.alias("ord"))

