import pytest
from pyspark.sql import functions as F

from perilscope.operators import joins, model
from perilscope.plans import forecast


def test_master_join(frame):
    left = frame(id=["1", " 2 ", "3.0", None, "9"], name=["a", "b", "c", "d", "e"])
    master = frame(id=[1, 2, 2, 3, None], name=["m1", "m2", "m2x", "m3", "mn"], extra=[1, 2, 3, 4, 5])
    got = {tuple(r) for r in joins.join_master(left, master, "id").collect()}
    assert got == {
        ("1", "a", "m1", 1), ("2", "b", "m2", 2), ("2", "b", "m2x", 3), ("3", "c", "m3", 4),
        (None, "d", None, None), ("9", "e", None, None),
    }
    assert left.columns == ["id", "name"]


def test_spread_join_equals_a_plain_join(frame):
    keys = ["hot"] * 300 + [None] * 200 + [str(i % 7) for i in range(100)]
    left = frame(partitions=5, k=keys, v=[i // 3 for i in range(600)])  # with exact copies
    right = frame(k=["hot", "hot", "1", "2", None], w=[1, 2, 3, 4, 5])
    got = joins.spread_left_join(left, right, ["k"], salts=8, hot_rows=50)
    plain = left.join(right, "k", "left")
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
    assert got.count() == 300 * 2 + 300


def test_spread_join_splits_the_hot_key(frame):
    left = frame(partitions=4, k=["hot"] * 4000, v=list(range(4000)))
    right = frame(k=["hot"], w=[1])
    got = joins.spread_left_join(left, right, ["k"], salts=16, hot_rows=50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    salts = left.select(
        F.pmod(F.xxhash64("k", "v", F.spark_partition_id()), F.lit(16)).alias("s")
    ).groupBy("s").count()
    assert salts.count() == 16 and salts.agg(F.max("count")).first()[0] < 400


@pytest.mark.parametrize(
    "one,other",
    [("int", "bigint"), ("int", "double"), ("date", "timestamp"), ("bigint", "int")],
)
def test_spread_join_with_keys_of_two_types(spark, one, other):
    value = "date_add(DATE'2025-01-01', cast(id % 3 as int))" if one == "date" else "id % 3"
    left = spark.range(0, 900, 1, 5).selectExpr(f"cast({value} as {one}) AS k", "id AS v")
    right = spark.range(2).selectExpr(f"cast({value} as {other}) AS k", "id AS w")
    got = joins.spread_left_join(left, right, ["k"], salts=5, hot_rows=10)
    assert got.schema["k"].dataType.simpleString() == one
    assert got.where("w IS NOT NULL").count() == 600 and got.count() == 900


def test_every_hot_key_is_split(frame):
    left = frame(k=[i % 60 for i in range(3000)], v=list(range(3000)))
    right = frame(k=list(range(60)), w=list(range(60)))
    got = joins.spread_left_join(left, right, ["k"], salts=4, hot_rows=10)
    assert got.where("w = k").count() == 3000


def test_size_check(frame):
    df = frame(t=["x" * 100] * 10)
    assert joins.fits_broadcast(df, 1160) and not joins.fits_broadcast(df, 1159)
    assert joins.fits_broadcast(df.limit(0), 0)


def test_lookup(frame):
    df = frame(a=["x", "x", None, "y"], b=["1", "2", "1", None])
    table = {("x", "1"): "hit"}
    large = table | {(f"k{i}", "1"): "no" for i in range(100)}
    for entries in (table, large, joins.lookup_frame(df, ["a", "b"], table, "p")):
        got = joins.lookup(df, ["a", "b"], entries, "p", "none").collect()
        assert {tuple(r) for r in got} == {
            ("x", "1", "hit"), ("x", "2", "none"), (None, "1", "none"), ("y", None, "none"),
        }


def test_lookup_replaces_a_column(frame):
    df = frame(a=["x", "y"], p=["old", "old"], z=[1, 2])
    small = {"x": "new"}
    large = small | {f"k{i}": "no" for i in range(60)}
    for entries in (small, large, joins.lookup_frame(df, ["a"], small, "p")):
        got = joins.lookup(df, ["a"], entries, "p", "none")
        assert got.columns == ["a", "z", "p"]
        assert {tuple(r) for r in got.collect()} == {("x", 1, "new"), ("y", 2, "none")}


def test_personalised(frame):
    raw = frame(k=[1, 2, None], t=["a", "b", "c"])
    derived = frame(k=[2, 1], theme=["B", "A"])
    out = joins.personalised(raw, derived, "k", {"theme": "advice", "gone": "x"})
    assert {tuple(r) for r in out.collect()} == {(1, "a", "A"), (2, "b", "B"), (None, "c", None)}

    def derive(df):
        return df.withColumn("theme", F.upper("t")).withColumn("t", F.lit("changed")).drop("k")

    out = joins.personalised(raw, derive, "k", {"theme": "advice", "t": "now", "gone": "x"})
    assert out.columns == ["k", "t", "advice", "now"]
    assert {tuple(r) for r in out.collect()} == {
        (1, "a", "A", "changed"), (2, "b", "B", "changed"), (None, "c", "C", "changed"),
    }
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_ordinal_codes(frame):
    df = frame(a=["z", "b", None, "b"], q=[3, 1, 2, 1])
    codes = model.OrdinalEncoding.fit(df, ["a", "q"])
    assert codes.sizes == {"a": 3, "q": 3} and codes.largest == 3
    known = codes.codes.orderBy("place", "code").collect()
    assert [(r["v"], r["code"]) for r in known] == [
        ("Unknown", 0.0), ("b", 1.0), ("z", 2.0), ("1", 0.0), ("2", 1.0), ("3", 2.0),
    ]
    out = codes.transform(frame(a=["b", "new"], q=[3, 9])).orderBy("q").collect()
    assert [(r["a_code"], r["q_code"]) for r in out] == [(1.0, 2.0), (-1.0, -1.0)]


def test_thousands_of_categories(frame):
    names = [f"area {i}" for i in range(3000)]
    df = frame(partitions=5, a=names, y=["u" if i < 1500 else "v" for i in range(3000)], q=[i % 4 for i in range(3000)])
    codes = model.OrdinalEncoding.fit(df, ["a", "q"])
    got = {r["a"]: r["a_code"] for r in codes.transform(df).collect()}
    assert got == {n: float(i) for i, n in enumerate(sorted(names))}
    fitted = model.fit_forest(df, ["a", "q"], "y", trees=2, depth=2, max_bins=64)
    assert fitted.classes == ["u", "v"]


def test_forest_does_not_depend_on_partitions(learned):
    found = [
        [tuple(r) for r in model.importances(
            model.fit_forest(learned.repartition(n), ["x", "z"], "y", trees=6, depth=3), learned
        ).collect()]
        for n in (2, 8)
    ]
    assert found[0] == found[1]


def test_forest_on_a_bounded_sample(learned):
    fitted = model.fit_forest(learned, ["x", "z"], "y", trees=5, depth=3, train_rows=100)
    assert fitted.classes == ["high", "low"]


def test_thresholds_come_from_all_rows(spark):
    # five of 200,000 rows have the value between the others, and a label of their own
    rare = F.col("id") % 40_000 == 7
    z = F.when(rare, "b").when(F.col("id") % 2 == 0, "a").otherwise("c")
    df = spark.range(200_000).select(z.alias("z"), F.when(rare, "rare").otherwise(z).alias("y"))
    fitted = model.fit_forest(df, ["z"], "y", trees=10, depth=3)
    found = model.predict_class(fitted, df.distinct()).collect()
    assert {(r["z"], r["pred"]) for r in found} == {("a", "a"), ("b", "rare"), ("c", "c")}


def test_bins_for_all_rows():
    assert [model.bins(*x) for x in ((3, 4096, 0), (3, 4096, 9), (99, 64, 9), (99, 4096, 9))] == [32, 32, 64, 100]
    assert [model.bins(3, 4096, n) for n in (40_000, 40_001, 10**12)] == [200, 201, 46_340]
    assert all(model.bins(3, 4096, n) ** 2 >= n for n in (1025, 10_001, 123_456_789))


def test_plain_split_where_a_class_is_too_small(frame):
    df = frame(k=[str(i) for i in range(101)], y=["a"] * 60 + ["b"] * 40 + ["only one"])
    flagged = model.split_flag(df, "y", ["k"])
    assert flagged.columns == ["k", "y", "is_test"]
    assert flagged.where("is_test").count() == 20
    few = frame(k=[str(i) for i in range(8)], y=["a", "b"] * 4)
    assert model.split_flag(few, "y", ["k"]).where("is_test").count() == 1
    assert model.split_flag(few.limit(0), "y", ["k"]).count() == 0


def test_split_is_stratified_disjoint_and_stable(frame):
    labels = ["a"] * 500 + ["b"] * 53 + ["c"] * 4 + [None]
    df = frame(k=[str(i) for i in range(len(labels))], y=labels)
    train, test = model.stratified_split(df, "y", ["k"])
    counts = {r["y"]: r["count"] for r in test.groupBy("y").count().collect()}
    assert counts == {"a": 100, "b": 10}
    first = {r["k"] for r in test.collect()}
    assert not first & {r["k"] for r in train.collect()}
    assert train.count() + test.count() == len(labels)
    again = model.stratified_split(df.repartition(7), "y", ["k"])[1]
    assert {r["k"] for r in again.collect()} == first
    other = model.stratified_split(df, "y", ["k"], seed=7)[1]
    assert {r["k"] for r in other.collect()} != first


def test_split_keeps_copies_together(frame):
    keys = ["copy"] * 40 + [str(i) for i in range(60)]
    df = frame(k=keys, y=["a"] * 100)
    for seed in range(6):
        flags = model.split_flag(df, "y", ["k"], seed=seed).groupBy("k").agg(
            F.min("is_test").alias("lo"), F.max("is_test").alias("hi"), F.count("*").alias("n")
        ).collect()
        assert all(r["lo"] == r["hi"] for r in flags)
        assert sum(r["n"] for r in flags if r["hi"]) <= 20
    unique = model.split_flag(df.where("k <> 'copy'"), "y", ["k"])
    assert unique.where("is_test").count() == 12


def test_classification_report(frame):
    df = frame(y=["a", "a", "a", "b", "b", "c"], p=["a", "a", "b", "b", "a", "b"])
    rows = {r["class"]: r for r in model.classification_report(df, "y", "p").collect()}
    assert rows["a"]["precision"] == pytest.approx(2 / 3) and rows["a"]["recall"] == pytest.approx(2 / 3)
    assert rows["b"]["precision"] == pytest.approx(1 / 3) and rows["b"]["f1"] == pytest.approx(0.4)
    assert rows["c"]["f1"] == 0.0 and rows["c"]["support"] == 1
    assert rows["accuracy"]["recall"] == 0.5
    assert rows["macro avg"]["recall"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert rows["weighted avg"]["recall"] == pytest.approx(0.5)
    assert model.accuracy(df, "y", "p").first()["accuracy"] == 50.0


@pytest.fixture
def learned(frame):
    n = 240
    x = [str(i % 4) for i in range(n)]
    z = [str(i % 3) for i in range(n)]
    y = ["low" if int(a) < 2 else "high" for a in x]
    return frame(k=[str(i) for i in range(n)], x=x, z=z, y=y)


def test_forest(learned):
    train, test = model.stratified_split(learned, "y", ["k"])
    fitted = model.fit_forest(train, ["x", "z"], "y", trees=10, depth=3)
    assert fitted.classes == ["high", "low"]
    judged = model.predict_class(fitted, test)
    assert model.accuracy(judged, "y", "pred").first()["accuracy"] == 100.0
    long = model.predict_long(fitted, test.select("k", "x", "z"), ["k"])
    assert long.count() == 2 * test.count()
    sums = long.groupBy("k").agg(F.sum("prob").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)
    weights = {r["feature"]: r["importance"] for r in model.importances(fitted, test).collect()}
    assert weights["x"] > weights["z"] and sum(weights.values()) == pytest.approx(100, abs=0.05)


def test_subcause_forecast(frame):
    rows = frame(area=["1"] * 6, theme=["A"] * 5 + ["B"], cause=["x", "x", "x", "y", "z", None])
    probs = frame(quarter=[3, 3, 3], area=["1", "1", "2"], theme=["A", "B", "A"], prob=[0.5, 0.5, 1.0])
    trends = frame(area=["1"], theme=["A"], trend=[1.5])
    got = forecast.subcause_forecast(probs, rows, "area", "theme", "cause", trends, n=2)
    assert {tuple(r) for r in got.collect()} == {
        (3, "1", "A", 50.0, 1.5, "x", 45.0), (3, "1", "A", 50.0, 1.5, "y", 15.0),
    }
    plain = forecast.subcause_forecast(probs, rows, "area", "theme", "cause", n=1)
    assert [tuple(r) for r in plain.collect()] == [(3, "1", "A", 50.0, "x", 60.0, 30.0)]
    wide = forecast.theme_forecast(probs, "area", "theme", ["B", "A"]).orderBy("area").collect()
    assert tuple(wide[0]) == (3, "1", 50.0, 50.0, "B", 50.0)  # the first theme wins ties
    assert tuple(wide[1]) == (3, "2", None, 100.0, "A", 100.0)
    assert [tuple(r) for r in forecast.forecast_counts(got).collect()] == [(3, 2)]
