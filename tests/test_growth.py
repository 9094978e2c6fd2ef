"""What keeps the work of a query in step with its input: passes over it, bytes kept, tasks."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks import forecasting, summaries
from checks import rules as rule_checks
from perilscope.operators import joins, matching, model, rules
from perilscope.sources import tables

FOLDER = "/root/testdata/sf0.001"


def rules_of(spark, words):
    return spark.createDataFrame(
        pa.table({"pattern": words, "label": [f"l{i}" for i in range(len(words))],
                  "ord": pa.array(range(len(words)), pa.int64())})
    )


@pytest.mark.parametrize("longest", [False, True])
def test_words_are_searched_once_not_once_a_text(spark, monkeypatch, longest):
    rng = random.Random(3)
    words = ["anvils", "bolted", "gear", "gizmo", "é-ring", "x", "unlike", "plates"]
    said = [rng.choice([" ", "\t", "\n "]).join(rng.choices(words, k=30)) + f" {i}" for i in range(120)]
    said += ["hot gearing", "no", "a hot rod", None, "", "  ", "gizmo gizmos"]
    patterns = ["anvil", "bolt", "gear", "gizmo", "ring", "plate", "hot rod", "bolted anvils", "like", "o"]
    searched = []
    whole = matching.contained

    def counted(texts, parts):
        searched.append((texts.count(), parts.where("part like '% %'").isEmpty()))
        return whole(texts, parts)

    monkeypatch.setattr(matching, "contained", counted)
    given = rules_of(spark, patterns)
    given = matching.longest_first(given) if longest else given
    df = spark.createDataFrame(pa.table({"t": pa.array(said, pa.string())}))
    got = {r["text"]: r["rule"]["pattern"] for r in matching.first_contained(df, "t", given, longest).collect()}
    for t in said:
        hits = [p for p in patterns if t and p in t]
        order = (lambda p: (-len(p), patterns.index(p))) if longest else patterns.index
        assert got.get(t) == (min(hits, key=order) if hits else None)
    distinct = {w for t in said if t for w in t.split()}
    of_words = [n for n, bare in searched if bare]
    assert of_words and max(of_words) <= (12 if longest else len(distinct))


def test_pairs_that_touch_are_cut_to_the_first_rule_of_a_text(spark):
    patterns = [f"en{i}" for i in range(300)]
    given = rules_of(spark, patterns[::-1])
    df = spark.createDataFrame(pa.table({"t": ["en", "en29", "xen7x", "zz"]}))
    found = matching.first_touching(df, "t", given)
    assert {r["text"]: r["rule"]["pattern"] for r in found.collect()} == {
        "en": "en299", "en29": "en299", "xen7x": "en7"
    }


def plan_of(df, phase="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), phase)().toString()


@pytest.mark.parametrize("label", [
    lambda df, given: rules.classify(df, "t", given, None, ("exact", "token"))[0],
    lambda df, given: rules.first_contains(df, "t", given, None),
])
def test_a_frame_of_rules_is_computed_once(spark, monkeypatch, label):
    words = [f"en{i}" for i in range(20)]
    monkeypatch.setattr(rules, "JOIN_FROM", len(words))
    seen = spark.sparkContext.accumulator(0)

    def same(word):
        seen.add(1)
        return word

    given = rules_of(spark, words).repartition(2)
    given = given.withColumn("pattern", F.udf(same, "string")("pattern"))
    df = spark.createDataFrame(pa.table({"t": ["xen7x", "xen13", "zz"]}))
    got = {r["t"]: r["theme"] for r in label(df, given).collect()}
    assert got == {"xen7x": "l7", "xen13": "l1", "zz": None}
    assert seen.value == len(words)


def test_what_a_stage_finds_is_computed_before_it_is_measured(spark, monkeypatch):
    plans, whole = [], matching.join_checked

    def noted(left, right, *more, **named):
        plans.append(plan_of(right))
        return whole(left, right, *more, **named)

    monkeypatch.setattr(matching, "join_checked", noted)
    monkeypatch.setattr(matching, "near_pairs", lambda texts, text, known, least: known.select(
        F.col("pattern").alias("text"), "pattern", F.lit(100.0).alias("score")))
    df = spark.createDataFrame(pa.table({"t": ["a gear", "gears/bolt", "gear", "bolt ", "no"]}))
    out = matching.label_frame(df, "t", rules_of(spark, ["gear", "bolt"]))
    assert {(r["t"], r["label"]) for r in out.collect()} == {
        ("a gear", "l0"), ("gears/bolt", "l0"), ("gear", "l0"), ("bolt ", "l1")
    }
    assert len(plans) >= 4
    assert not [p for p in plans if "Join" in p or "Aggregate" in p]


def test_words_of_the_documents_are_not_sorted_to_become_rules(spark):
    lines = plan_of(rule_checks._word_rules(spark, FOLDER), "executedPlan").splitlines()
    above = lines[: next(i for i, x in enumerate(lines) if "Generate explode" in x)]
    assert "HashAggregate" in [x for x in above if "Aggregate" in x][-1]


def test_beginnings_shorter_than_the_rest_of_a_text_are_met_once(spark):
    said = spark.createDataFrame(pa.table({"text": ["abab", "é", "bcd"], "key": pa.array([1, 2, 3], pa.int64())}))
    parts = spark.createDataFrame(pa.table({"part": ["a", "ab", "b", "é", "bcd", "abab", "cdef"]}))
    got = sorted((r["key"], r["part"]) for r in matching.contained(said, parts).collect())
    assert got == sorted([(1, "a"), (1, "a"), (1, "ab"), (1, "ab"), (1, "b"), (1, "b"), (1, "abab"),
                          (2, "é"), (3, "b"), (3, "bcd")])


def test_candidates_are_near(spark):
    """Pairs that share a segment but differ elsewhere are dropped before they are shuffled."""
    rng = random.Random(5)
    half = "abcdefghijklmnopqrst"
    given = rules_of(spark, [half + "".join(rng.choices("uvwxyz", k=20)) for _ in range(50)])
    near = given.first()["pattern"]
    df = spark.createDataFrame(pa.table({"t": [near[:30] + near[31:]]}))
    met = matching.candidates(df, "t", given, 97).collect()
    assert [r["pattern"] for r in met] == [near]


def test_rows_joined_by_position_go_to_tasks_by_their_number(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id", "id % 3 AS k").write.parquet(str(tmp_path / "t"))
    rows = joins.positioned(spark.read.parquet(str(tmp_path / "t")))
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 10)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.personalised(rows.select(joins.POSITION, "id"), rows.select(joins.POSITION, "k"), None, {"k": "K"})
        assert out.rdd.getNumPartitions() == 100
        assert sorted(map(tuple, out.collect())) == [(i, i % 3) for i in range(1000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_one_pass_tells_hot_keys_and_partners(spark, monkeypatch):
    rows = spark.range(600).selectExpr("id", "cast(id % 20 AS string) AS k")
    master = spark.range(500).selectExpr("cast(id AS string) AS k", "id * 2 AS twice")
    asked, whole = [], joins.key_filter

    def counted(df, keys):
        asked.append(df.count())
        return whole(df, keys)

    monkeypatch.setattr(joins, "key_filter", counted)
    out = joins.join_master(rows, master, "k", limit=-1)
    assert sorted((r["id"], r["twice"]) for r in out.collect()) == [(i, i % 20 * 2) for i in range(600)]
    assert asked == [20]


def test_a_split_keeps_sixteen_bytes_a_row(spark, monkeypatch):
    kept, whole = [], model.stored

    def seen(df, name):
        kept.append({f.name: f.dataType.simpleString() for f in df.schema})
        return whole(df, name)

    monkeypatch.setattr(model, "stored", seen)
    df = spark.range(500).selectExpr("id", "concat('k', id % 2) AS label")
    train, test = model.stratified_split(df, "label", ["id"])
    assert (train.count(), test.count()) == (400, 100)
    assert kept == [{"_l": "string", "_h": "binary"}]


def test_classes_and_rows_by_one_pass(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "y string")
    assert model._classes(df, "y", 2) == (["a", "b"], 4)
    with pytest.raises(ValueError, match="more than 1"):
        model._classes(df, "y", 1)


def test_parts_of_quoted_files_are_read_together(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("t,,\nkey,a,b\n" * (i == 0) + f'{i},"x\ny",z\n')
    calls, whole = [], tables.read_records
    monkeypatch.setattr(tables, "read_records", lambda s, p: calls.append(p) or whole(s, p))
    df = tables.read_with_header(spark, str(tmp_path), 3, ["key"], multi_line=True)
    assert df.columns == ["key", "a", "b"]
    assert sorted(map(tuple, df.collect())) == [(str(i), "x\ny", "z") for i in range(3)]
    assert len(calls) == 1


def test_incidents_are_joined_once(spark, monkeypatch):
    """What passes over the incidents several times reads them from a table."""
    seen = []

    def plan(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())

    stop = RuntimeError("seen")

    def given(*frames, **_):
        for df in frames[:2]:
            if hasattr(df, "_jdf"):
                plan(df)
        raise stop

    for module, name, query in [
        (forecasting.pipeline, "run_pipeline", forecasting.pipeline_rows),
        (forecasting.forecast, "run_forecast", forecasting.forest_forecast),
        (forecasting.model, "stratified_split", forecasting.forest_signal),
        (summaries.joins, "join_master", summaries.master_join),
    ]:
        with monkeypatch.context() as patch:
            patch.setattr(module, name, given)
            with pytest.raises(RuntimeError, match="seen"):
                query(spark, FOLDER)
    assert len(seen) >= 5 and not any("Join" in text for text in seen)


@pytest.mark.parametrize(
    ("query", "share"),
    [("forest_forecast", 0.8), ("forest_importance", 1.0), ("forest_signal", 0.8),
     ("forest_signal_accuracy", 0.8), ("forest_signal_importance", 0.8)],
)
def test_forests_learn_from_all_rows(spark, monkeypatch, query, share):
    n = 30_000
    of = lambda *given: F.element_at(F.array(*map(F.lit, given)), (F.col("id") % len(given) + 1).cast("int"))
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("row_key"), of("A", "B", "C", "D").alias("area"),
        of("anvil", "hot rod", "bolt").alias("cause"), of("Jan", "Apr", "Aug").alias("month"),
        of("F", "O").alias("surface"), of("1-U", "2-H", "3-M", "4-N", "5-L").alias("priority"),
        of(1999, 2000).alias("year"), of(1, 2, 3, 4).alias("quarter"),
    )
    learned = []
    stop = RuntimeError("learned")

    class Trainer:
        def __init__(self, **_):
            pass

        def fit(self, df):
            learned.append(df.count())
            raise stop

    monkeypatch.setattr(forecasting, "incident", lambda spark, folder, *columns: rows.select(*columns))
    monkeypatch.setattr(model, "RandomForestClassifier", Trainer)
    with pytest.raises(RuntimeError, match="learned"):
        getattr(forecasting, query)(spark, FOLDER)
    assert n * share <= learned[0] <= n * share + 10
