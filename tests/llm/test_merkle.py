"""Merkle manifests against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from perilscope.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, at int, root string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    out = []
    for value in (row[0], row[3], row[2], row[4], row[1]):
        text = None if value is None else str(value)
        out.append("-" if text is None else f"{len(text.encode())}:{text}")
    return h(*out)


def tree_of(leaves, fanout):
    """Root, and the siblings of each leaf from below."""
    level, groups, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        above, merged = [], []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for k in range(len(run)):
                for i in groups[at + k]:
                    proofs[i] += run[:k] + run[k + 1 :]
            above.append(h(*run))
            merged.append([i for g in groups[at : at + fanout] for i in g])
        level, groups = above, merged
    return level[0], proofs


def expected(rows, fanout):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0], leaf_of(row)))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    found = []
    for name in names:
        trees[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        found.append(tree_of([x[1] for x in trees[name]], fanout))
    root, above = tree_of([f[0] for f in found], fanout)
    out = []
    for name, (sub, proofs), top in zip(names, found, above):
        out += [(i, d, sub, root, "".join(p + top)) for (i, d), p in zip(trees[name], proofs)]
    return sorted(out, key=str)


def rows_of(n):
    langs = ["en", None, "de", "", "é", "en", "en", "en"]
    return [
        (i if i % 17 else None, "text" * (i % 5) if i % 7 else None, langs[i % 8],
         f"s{i % 3}" if i % 4 else None, i if i % 6 else None, i % 2, "x")
        for i in range(n)
    ]


@pytest.mark.parametrize("n,fanout,levels", [(1, 2, 3), (57, 2, 2), (64, 3, 7)])
def test_roots_and_proofs(spark, n, fanout, levels):
    rows = rows_of(n)
    rows += rows[: n // 10]  # repeated rows have leaves of their own
    found = merkle.manifest(
        spark.createDataFrame(rows, SCHEMA).repartition(5), fields=FIELDS,
        rules=merkle.Rules(fanout, levels),
    )
    proof = merkle.siblings(F.col("path"))
    got = found.select(
        "doc_id", "leaf", "subroot", "root", proof.alias("p"),
        merkle.folded(F.col("leaf"), F.col("path")).alias("f"),
        merkle.folded(F.sha2(F.lit(b"other"), 256), F.col("path")).alias("bad"),
    ).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows, fanout)
    assert all(r["f"] == r["root"] != r["bad"] for r in got)


def test_a_group_of_equal_rows_and_clashing_names(spark):
    """One id for most rows, an empty and a long text, and columns called as the helpers are."""
    rows = [(7, "same", "en", "s", 4, 1, "y")] * 60 + [(8, "", "en", "s", 0, 1, "y"), (9, "ab " * 50_000, None, None, None, 2, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit(1), "digest": F.lit("d"), "tree": F.lit("t")})
    found = merkle.manifest(df, rules=merkle.Rules(2, 3)).select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("p")
    )
    assert sorted([tuple(r) for r in found.collect()], key=str) == expected(rows, 2)


def test_more_columns_travel_along(spark):
    df = spark.createDataFrame(rows_of(20), SCHEMA)
    found = merkle.manifest(df, more=[(F.col("n_chars") * 2).alias("root"), F.col("at").alias("leaf")])
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "path", "root", "leaf"]


def test_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_numbers_of_a_level_stay_in_one_shuffle(spark):
    """All levels of a block are worked on after the one exchange that deals the blocks."""
    nodes = spark.range(100).select(
        F.col("id").cast("string").substr(9, 1).alias("tree"), F.col("id").alias("at"),
        (F.col("id") * 0 + 100).alias("size"),
        F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"), F.col("id").alias("row"),
    )
    rows = nodes.select(
        "tree", F.expr("at div 8").alias("block"), "at", "size", "digest",
        F.array(F.struct("row", F.array().cast(merkle.PATH).alias("path"))).alias("below"),
    ).repartition("tree", "block")
    for _ in range(3):
        rows = merkle.pivoted(rows, merkle.Rules(2, 3))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
