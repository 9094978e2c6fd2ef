"""Queries and pipeline stages on whole small tables, against plain Python and SQL."""

import hashlib
import math
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import database
from perilscope.llm import quality, queries, secrets

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not there")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
BASE = [("assign", ASSIGN, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


@pytest.fixture(scope="module")
def texts():
    rows = database(FOLDER).sql("SELECT doc_id, text FROM documents").fetchall()
    return {doc_id: text or "" for doc_id, text in rows}


def test_secrets_of_the_query(spark, texts):
    found = queries.QUERIES["op2_secrets"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        spans = [
            (m.start(), k, m.end())
            for k, (_, pattern, group, least) in enumerate(BASE)
            for m in pattern.finditer(texts[r["doc_id"]]) if len(m.group(group)) >= least
        ]
        base = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = [s for s in r["spans"].split(",") if s]
        assert [s for s in every if not s.startswith("markov")] == base
        for s in every:  # what the models add meets no base span
            if s.startswith("markov"):
                a, b = map(int, s.split(":")[1:])
                assert all(b <= lo or hi <= a for lo, _, hi in spans)
                assert re.fullmatch("[A-Za-z0-9+/_=-]{20,}", texts[r["doc_id"]][a:b])


def test_markov_models_are_the_counts_of_transitions(spark):
    """The model of a corpus with one value, and no rare characters, by hand."""
    value = "Zq9Zq9Zq9Zq9Zq9Z"
    docs = spark.createDataFrame([(1, f"token={value} ident ident_a")], "doc_id bigint, text string")
    rules = secrets.Rules()
    model = secrets.train(docs, "doc_id", "text", rules)

    def log(tokens, a, b):
        pairs = [(x, y) for t in tokens for x, y in zip(t, t[1:])]
        share = (1 - rules.rare) * sum(y == b for _, y in pairs) / max(len(pairs), 1) + rules.rare / secrets.STATES
        seen, after = sum(p == (a, b) for p in pairs), sum(x == a for x, _ in pairs)
        return math.log((seen + rules.backoff * share) / (after + rules.backoff))

    random, ordinary = [value], ["ident_a"]
    for a, b in (("Z", "q"), ("q", "9"), ("i", "d"), ("t", "_"), ("A", "B")):
        place = (secrets.ALPHABET.index(a) + 1) * secrets.STATES + secrets.ALPHABET.index(b) + 1
        assert model[place] == pytest.approx(log(random, a, b) - log(ordinary, a, b), abs=1e-5)


def test_quality_weights_and_threshold(spark):
    """The fit and the verdicts of the query, by counts in dictionaries."""
    rules = quality.Rules()
    con = database(FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.fit(docs, labels, "doc_id", "text", "quality", rules)
    known = {r["label_id"]: (r["good"], r["part"]) for r in quality.labelled_ids(labels, "doc_id", "quality", rules).collect()}
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    size = 1 << rules.bits
    corpus, target = [rules.smoothing] * size, [rules.smoothing] * size
    grams = {}
    for doc_id, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        grams[doc_id] = quality.buckets(raw, rules.width, rules.bits).tolist()
        for g in grams[doc_id]:
            corpus[g] += 1
            if known.get(doc_id) == (1, 0):
                target[g] += 1
    all_c, all_t = sum(corpus), sum(target)
    weights = [math.log(t / all_t) - math.log(c / all_c) for t, c in zip(target, corpus)]
    assert np.abs(model.weights / quality.SCALE - np.array(weights)).max() < 2 / quality.SCALE
    scores = {d: sum(weights[g] for g in gs) / max(len(gs), 1) for d, gs in grams.items()}
    found = queries.QUERIES["op7_quality"](spark, FOLDER).collect()
    for r in found:
        assert r["score"] == pytest.approx(scores[r["doc_id"]], abs=1e-5)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= model.threshold)


def test_threshold_by_trying_every_cut():
    rng = np.random.default_rng(4)
    rules = quality.Rules()
    for _ in range(50):
        scores = rng.integers(0, 12, 40) / 4
        good = (scores + rng.normal(0, 1, 40) > 1.5).astype(int)
        if not good.any() or good.all():
            continue
        found = quality.threshold(scores, good, rules)
        limit = np.sort(scores[good == 1])[int(rules.lost * good.sum())]

        def gain(cut):
            return (scores[good == 0] < cut).mean() - (scores[good == 1] < cut).mean()

        best = max(gain(c) for c in np.unique(scores))
        assert found <= limit and (found == limit or gain(found) == pytest.approx(best))


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_language_stage_drops_what_has_no_letter(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    import regex

    want = sorted(d for d, t in texts.items() if regex.search(r"\p{L}", t))
    assert ids(stage_of("language")(spark, docs, FOLDER)) == want


def test_near_duplicate_stage_keeps_the_smallest_of_each_group(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sql = queries.ORACLES["op1_near_duplicates"].replace("< 4 THEN", "< 5 THEN").replace("- 3)", "- 4)").replace("i + 4]", "i + 5]")
    want = sorted(r[0] for r in database(FOLDER).sql(f"SELECT doc_id FROM ({sql}) WHERE kept").fetchall())
    assert len(want) < docs.count()
    assert ids(stage_of("near duplicates")(spark, docs, FOLDER)) == want


def test_decontamination_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sql = f"SELECT doc_id FROM ({queries.ORACLES['op9_decontamination']}) WHERE NOT contaminated"
    want = sorted(r[0] for r in database(FOLDER).sql(sql).fetchall())
    assert ids(stage_of("decontamination")(spark, docs, FOLDER)) == want


def test_mixing_stage_reads_each_document_as_often_as_the_mix_takes_it(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sql = f"SELECT doc_id, ceil(taken / size)::INT FROM ({queries.ORACLES['op5_mixing']}) WHERE size > 0"
    want = sorted(d for d, n in database(FOLDER).sql(sql).fetchall() for _ in range(n))
    assert ids(stage_of("mixing")(spark, docs, FOLDER)) == want


def test_user_columns_keep_their_values(spark):
    names = ["score", "Lang_Pred", "items", "n_words", "n_hit", "size", "target", "position", "taken",
             "source_size", "_h", "_size", "_bucket", "_source", "hidden column 1", "gone"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).withColumns(
        {n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names}
    )
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        if name == "near duplicates":  # adds no column
            continue
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).toArrow())
        if name != "sharding":
            assert docs.columns == columns
        assert docs.count() and docs.select([c for c in docs.columns if c in columns]).columns == columns
        wrong = [F.col(f"`{n}`") != F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names]
        assert docs.where(F.exists(F.array(*wrong), lambda x: x)).isEmpty()
