"""From raw documents to sharded training documents, stage by stage.

Each stage reads what the one before it has written: language, near duplicates, benchmark
passages, the mix of sources, shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.columns import col_of
from perilscope.llm import decontamination, language, mixing, neardup, sharding
from perilscope.llm.queries import CURVES, SHARDS, held_out, table
from perilscope.session import run_folder


def hidden(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the ``needed`` columns under names that no operator uses, and what
    gives a frame made of it the columns of ``docs`` back, their values as they were."""
    names = {c: c if c in needed else f"hidden column {i}" for i, c in enumerate(docs.columns)}

    def shown(df: DataFrame) -> DataFrame:
        return df.select(*[col_of(new).alias(old) for old, new in names.items()])

    return docs.select(*[col_of(old).alias(new) for old, new in names.items()]), shown


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; the model learns from the labelled rows that are not held out.

    A null or empty text and one without a letter go, and so do all if no document is labelled.
    Repeated rows stay or go together; other columns keep their values, whatever their names.
    """
    model = language.train(docs.where(~held_out()))
    rows, shown = hidden(docs, "doc_id", "text", "lang")
    return shown(language.identify(rows, model).where(F.col("lang_pred") != language.UNKNOWN))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Null and empty texts are like no other and stay. Rows that agree in id and text, and rows of
    a group without any id, are not told apart and stay together.
    """
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 is from the benchmark. Null and empty texts
    have no words and stay; each row is judged by itself."""
    rows, shown = hidden(docs, "doc_id", "text")
    return shown(decontamination.drop_contaminated(rows, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of training, each as often as the mix reads it.

    Null and empty texts have no words and are not read; a null source is the last one, rows
    with a null id take part, and repeated rows are read each for itself.
    """
    rows, shown = hidden(docs, "doc_id", "text", "source")
    return shown(mixing.curriculum(mixing.assign(rows, (5, 2, 1), CURVES)))


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shards: ``slot``, ``shard`` and ``shard_name``, which replace
    columns of these names. Equal ids share a shard; rows without one are spread by the rest."""
    return sharding.place(docs, ["doc_id"], SHARDS)


STAGES = [
    ("language", keep_languages),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_on_shards),
]

#: The first stage scores texts with models that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
