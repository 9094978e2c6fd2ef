"""Ordinal codes, stratified split, random forest and its evaluation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilscope.columns import col_of, cols_of, constant, free_name
from perilscope.functions.numbers import round_even, safe_ratio
from perilscope.operators.joins import BROADCAST_BYTES, fits_broadcast, join_checked
from perilscope.session import materialise, stored

PREFIX_DIGITS = (3, 6)
#: Partitions of the training rows: a number that depends on the rows alone, since the forest
#: draws its samples by partition and must not change with the cluster.
TRAIN_PARTITIONS = 16
ROWS_PER_PARTITION = 250_000
#: The square of the bins is a 32-bit number in the trainer.
MOST_BINS = 46_340


def train_partitions(rows: int) -> int:
    return max(TRAIN_PARTITIONS, -(-rows // ROWS_PER_PARTITION))


def bins(codes: int, limit: int, rows: int) -> int:
    """Bins of a feature with at most so many ``codes``: one for each up to ``limit``, and no fewer
    than the root of ``rows``, since the trainer looks for thresholds in a sample of more rows than
    the square of its bins. Features with fewer codes use as many bins as they have codes."""
    return min(MOST_BINS, max(32, min(codes + 1, limit), math.isqrt(max(rows - 1, 0)) + 1))


def category_text(name: str) -> Column:
    """Categories compare as text; null is a category of its own."""
    return F.coalesce(col_of(name).cast("string"), F.lit("Unknown"))


@dataclass(frozen=True)
class OrdinalEncoding:
    """Codes 0, 1, ... of the sorted categories of each column; -1 for unknown ones.

    ``codes`` has the columns ``place`` (of the name in ``names``), ``v`` and ``code``, for any
    number of categories.
    """

    names: list[str]
    codes: DataFrame
    sizes: dict[str, int]

    @classmethod
    def fit(cls, df: DataFrame, names: Sequence[str]) -> OrdinalEncoding:
        """Learn the categories, by one pass over the rows.

        The distinct categories are dealt by ranges and ranked within them; the sizes of the
        ranges say where each range begins.
        """
        pairs = F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("place"), category_text(n).alias("v"))
                    for i, n in enumerate(names)
                ]
            )
        )
        distinct = df.select(pairs.alias("p")).select("p.*").distinct()
        dealt = materialise(
            distinct.repartitionByRange("place", "v").withColumn("part", F.spark_partition_id())
        )
        ranges = dealt.groupBy("place", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("place").orderBy("part")
        starts = ranges.withColumn("start", F.sum("n").over(before) - F.col("n")).drop("n")
        rank = F.row_number().over(Window.partitionBy("place", "part").orderBy("v"))
        codes = materialise(
            dealt.withColumn("rank", rank).join(starts, ["place", "part"]).select(
                "place", "v", (F.col("start") + F.col("rank") - 1).cast("double").alias("code")
            )
        )
        sizes = {r["place"]: r["n"] for r in codes.groupBy("place").agg(F.count("*").alias("n")).collect()}
        return cls(list(names), codes, {n: sizes.get(i, 0) for i, n in enumerate(names)})

    def coded(self, df: DataFrame, into: Mapping[str, str]) -> DataFrame:
        """``df`` with the codes of the columns ``into`` names as keys, in new columns.

        Where all codes together fit a broadcast, which is asked once, the rows are not shuffled
        for any of them.
        """
        columns, narrow = list(df.columns), fits_broadcast(self.codes)
        category = free_name("_category", [*columns, *into.values()])
        for name, target in into.items():
            own = self.codes.where(F.col("place") == self.names.index(name)).select(
                F.col("v").alias(category), F.col("code").alias(target)
            )
            keyed = df.withColumn(category, category_text(name))
            if narrow:
                df = keyed.join(F.broadcast(own), category, "left")
            else:
                df = join_checked(keyed, own, [category])
            columns.append(target)
            df = df.withColumn(target, F.coalesce(F.col(target), F.lit(-1.0))).select(*cols_of(columns))
        return df

    def transform(self, df: DataFrame, suffix: str = "_code") -> DataFrame:
        """Add a code column per encoded column."""
        return self.coded(df, {n: n + suffix for n in self.names})

    @property
    def largest(self) -> int:
        return max(self.sizes.values(), default=0)


def split_flag(
    df: DataFrame, label: str, key: Sequence[str], test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: the first ``floor(test * n)`` rows of each label by a hash of the key.

    Where a label has a single row, or one of the sides would have fewer rows than there are
    labels, all rows with a label are split as one. Rows without a label are for training.

    The hash order gives each label one threshold. Counting by hash prefix tells the prefix
    that holds it, twice with a longer prefix; only the keys with the last one are ranked,
    about one in 16 million. So no label, however large, is sorted as a whole, and the flag
    itself is a comparison. Rows with equal keys stay on one side; a group of them that
    would exceed the share is left to the training side. The rows are read twice: for labels
    and hashes, of which 16 bytes a row are kept, and for the result.
    """
    place = F.md5(F.concat_ws("|", *cols_of(key), F.lit(str(seed))))
    kept = stored(
        df.select(col_of(label).cast("string").alias("_l"), F.unhex(place).alias("_h")).where(
            F.col("_l").isNotNull()
        ),
        "split",
    )
    rows = kept.select("_l", F.lower(F.hex("_h")).alias("_h"))
    first, second = PREFIX_DIGITS
    rows_per = F.count("*").alias("n")
    sizes = materialise(rows.groupBy("_l", F.substring("_h", 1, first).alias("_b")).agg(rows_per))
    least, total, labels = (
        sizes.groupBy("_l").agg(F.sum("n").alias("n"))
        .agg(F.min("n"), F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    )
    sides = (int(total * test), total - int(total * test))
    if labels and (least < 2 or min(sides) < labels):
        one = F.lit("all")
        rows, sizes = rows.withColumn("_l", one), sizes.groupBy("_b").agg(F.sum("n").alias("n"))
        sizes, of_row = sizes.withColumn("_l", one), F.when(col_of(label).isNotNull(), one)
    else:
        of_row = col_of(label).cast("string")
    by_label = Window.partitionBy("_l")

    def within(cut: DataFrame, digits: int) -> DataFrame:
        prefixed = rows.withColumn("_b", F.substring("_h", 1, digits))
        return prefixed.join(per_label(cut), ["_l", "_b"])

    def per_label(cut: DataFrame) -> DataFrame:
        """A frame with at most one row for each label, broadcast if that is small."""
        return F.broadcast(cut) if labels * 200 <= BROADCAST_BYTES else cut

    def crossing(sizes: DataFrame) -> DataFrame:
        """The prefix in which the count reaches ``need``, and what is needed of it."""
        before = F.col("upto") - F.col("n")
        found = sizes.withColumn("upto", F.sum("n").over(by_label.orderBy("_b"))).where(
            (F.col("upto") >= F.col("need")) & (before < F.col("need"))
        )
        return found.select("_l", "_b", (F.col("need") - before).alias("need"))

    cut = crossing(sizes.withColumn("need", F.floor(F.sum("n").over(by_label) * F.lit(test))))
    longer = F.substring("_h", 1, second).alias("_b")
    cut = crossing(within(cut, first).groupBy("_l", "need", longer).agg(rows_per))
    counts = within(cut, second).groupBy("_l", "_b", "need", "_h").agg(rows_per)
    inside = F.sum("n").over(by_label.orderBy("_h")) <= F.col("need")
    threshold = materialise(
        counts.withColumn("_in", F.when(inside, F.col("_h")))
        .groupBy("_l")
        .agg(F.coalesce(F.max("_in"), F.max("_b")).alias("_limit"))
    )
    flagged = df.withColumn("_l", of_row).join(per_label(threshold), "_l", "left")
    return flagged.withColumn("is_test", F.coalesce(place <= F.col("_limit"), F.lit(False))).select(
        *cols_of(df.columns), "is_test"
    )


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str], test: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test): disjoint, complete, and the same for every run and partitioning."""
    flagged = split_flag(df, label, key, test, seed)
    return (
        flagged.where(~F.col("is_test")).drop("is_test"),
        flagged.where(F.col("is_test")).drop("is_test"),
    )


@dataclass(frozen=True)
class Forest:
    """A fitted forest with the codes of its features and label."""

    model: RandomForestClassificationModel
    features: list[str]
    encoding: OrdinalEncoding
    classes: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``probs``, an array of class probabilities in the order of ``classes``."""
        taken = [*df.columns, "probs"]
        vector, raw, probability, best = (
            free_name(c, taken) for c in ("_features", "_raw", "_probability", "_prediction")
        )
        names = {"featuresCol": vector, "rawPredictionCol": raw, "probabilityCol": probability}
        model = self.model.copy({getattr(self.model, k): v for k, v in names.items()})
        model = model.setPredictionCol(best)
        scored = model.transform(_assembled(df, self.encoding, self.features, vector))
        return scored.select(*cols_of(df.columns), vector_to_array(F.col(probability)).alias("probs"))


def _assembled(
    df: DataFrame, encoding: OrdinalEncoding, features: Sequence[str], vector: str
) -> DataFrame:
    codes = {f: free_name(f"_code{i}", df.columns) for i, f in enumerate(features)}
    coded = encoding.coded(df, codes)
    assembler = VectorAssembler(inputCols=list(codes.values()), outputCol=vector)
    return assembler.transform(coded).drop(*codes.values())


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    trees: int = 200,
    depth: int = 10,
    seed: int = 42,
    encoding: OrdinalEncoding | None = None,
    max_classes: int = 1000,
    max_bins: int = 4096,
    train_rows: int | None = None,
) -> Forest:
    """Random forest on ordinal codes, which the trees treat as numbers.

    A label with more than ``max_classes`` values is an error. A feature with more than
    ``max_bins`` codes, or the root of the rows if that is more, is split at quantiles of them.
    All labelled rows are learned from, and thresholds come from all of them (up to two billion).
    Only a caller that gives ``train_rows`` gets a bound: about so many, drawn by a hash of the
    whole row.
    """
    encoding = encoding or OrdinalEncoding.fit(df, features)
    classes, rows = _classes(df, label, max_classes)
    if train_rows is not None:
        share = min(1.0, train_rows / max(1, rows))
        draw = F.pmod(F.xxhash64(*cols_of(df.columns), F.lit(seed)), F.lit(1 << 30))
        df = df.where(draw < int(share * (1 << 30)))
        rows = min(rows, train_rows)
    known = constant(classes, "array<string>")
    taken = [*features, label]
    codes = {f: free_name(f"_code{i}", taken) for i, f in enumerate(features)}
    target = free_name("_label", taken)
    place = F.array_position(known, col_of(label).cast("string")) - 1
    coded = encoding.coded(df.select(*cols_of(dict.fromkeys([*features, label]))), codes)
    names = [*codes.values(), target]
    # the trainer passes over its input many times, and draws by partition and place
    train = materialise(
        coded.withColumn(target, place.cast("double")).where(F.col(target) >= 0)
        .select(*names).repartition(train_partitions(rows), *names).sortWithinPartitions(*names)
    )
    vector = free_name("_features", names)
    train = VectorAssembler(inputCols=list(codes.values()), outputCol=vector).transform(train)
    model = RandomForestClassifier(
        featuresCol=vector,
        labelCol=target,
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        maxBins=bins(encoding.largest, max_bins, rows),
        featureSubsetStrategy="sqrt",
    ).fit(train.select(vector, target))
    return Forest(model, list(features), encoding, classes)


def _classes(df: DataFrame, label: str, limit: int) -> tuple[list[str], int]:
    """The values of a label in ascending order and the number of rows, by one pass."""
    counts = df.groupBy(col_of(label).alias("v")).agg(F.count("*").alias("n")).limit(limit + 2).collect()
    values = sorted(r["v"] for r in counts if r["v"] is not None)
    if len(values) > limit:
        raise ValueError(f"column {label!r} has more than {limit} distinct values")
    return [str(v) for v in values], sum(r["n"] for r in counts)


def importances(forest: Forest, df: DataFrame) -> DataFrame:
    """(feature, importance) in percent, largest first."""
    values = forest.model.featureImportances.toArray()
    table = pa.table({"feature": forest.features, "raw": [float(v) * 100.0 for v in values]})
    frame = df.sparkSession.createDataFrame(table)
    return frame.select("feature", round_even("raw", 2).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )


def predict_long(forest: Forest, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, theme, prob): one row per class."""
    names = constant(forest.classes, "array<string>")
    scored = forest.score(df).select(*cols_of(keys), F.posexplode("probs").alias("place", "prob"))
    return scored.select(*cols_of(keys), F.get(names, F.col("place")).alias("theme"), "prob")


def predict_class(forest: Forest, df: DataFrame, alias: str = "pred") -> DataFrame:
    """Add the most probable class, the first one of equal ones."""
    names = constant(forest.classes, "array<string>")
    best = (F.array_position("probs", F.array_max("probs")) - 1).cast("int")
    return forest.score(df).withColumn(alias, F.get(names, best)).drop("probs")


def accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """One row: the share of equal labels in percent."""
    hit = F.count_if(col_of(label) == col_of(pred))
    return df.agg(round_even(safe_ratio(hit, F.count("*")) * 100.0, 2).alias("accuracy"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class, then accuracy and both means.

    Everything comes from the counts of the confusion matrix.
    """
    confusion = df.groupBy(
        col_of(label).cast("string").alias("l"), col_of(pred).cast("string").alias("p")
    ).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("l").alias("class"), F.col("n").alias("support"), zero.alias("given"),
                 hit.alias("hits")),
        F.struct(F.col("p").alias("class"), zero.alias("support"), F.col("n").alias("given"),
                 zero.alias("hits")),
    )
    per_class = (
        confusion.select(F.explode(sides).alias("s"))
        .select("s.*")
        .groupBy("class")
        .agg(F.sum("support").alias("support"), F.sum("given").alias("given"),
             F.sum("hits").alias("hits"))
        .withColumn("precision", F.coalesce(safe_ratio("hits", "given"), F.lit(0.0)))
        .withColumn("recall", F.coalesce(safe_ratio("hits", "support"), F.lit(0.0)))
        .withColumn(
            "f1",
            F.coalesce(
                safe_ratio(
                    F.lit(2.0) * F.col("precision") * F.col("recall"),
                    F.col("precision") + F.col("recall"),
                ),
                F.lit(0.0),
            ),
        )
    )
    measures = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    macro = per_class.agg(F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures], total)
    weighted = per_class.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
        total,
    )
    share = F.sum("hits") / F.sum("support")
    overall = per_class.agg(
        F.lit("accuracy").alias("class"), *[share.alias(m) for m in measures], total
    )
    columns = ["class", *measures, "support"]
    return (
        per_class.select(*columns)
        .unionByName(overall.select(*columns))
        .unionByName(macro.select(*columns))
        .unionByName(weighted.select(*columns))
    )
