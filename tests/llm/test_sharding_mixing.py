"""Sharding tables and the mix of sources."""

from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perilscope.llm import mixing, sharding

NAMES = [f"s{i}" for i in range(7)]


def slow_table(names, size):
    """Each shard walks its whole order of preference, written out."""
    orders = []
    for name in names:
        start, step = sharding.preference(name, size)
        orders.append([(start + k * step) % size for k in range(size)])
        assert sorted(orders[-1]) == list(range(size))
    table, turn = {}, 0
    while len(table) < size:
        shard = turn % len(names)
        slot = next(s for s in orders[shard] if s not in table)
        table[slot] = shard
        turn += 1
    return [table[s] for s in range(size)]


@pytest.mark.parametrize("count,size", [(1, 2), (3, 13), (7, 101), (5, 5)])
def test_table(count, size):
    assert sharding.fill_table(NAMES[:count], size) == slow_table(NAMES[:count], size)


def test_shards_are_even_and_stable():
    before = sharding.fill_table(NAMES, 65_537)
    sizes = Counter(before).values()
    assert max(sizes) - min(sizes) <= 1
    after = sharding.fill_table(NAMES[:-1], 65_537)
    moved = sum(a != b for a, b in zip(before, after) if a != 6)
    assert moved < 0.1 * 65_537


@pytest.mark.parametrize("names,size", [([], 13), (["a", "a"], 13), (["a"], 12), (NAMES, 5)])
def test_faulty_tables(names, size):
    with pytest.raises(ValueError):
        sharding.fill_table(names, size)


def test_place(spark):
    rows = [(i, f"t{i}", 0) for i in range(500)] + [(None, f"n{i}", 1) for i in range(500)]
    df = spark.createDataFrame(rows + [(7, "again", 2), (None, None, 3)], "id int, t string, slot int")
    placed = sharding.place(df, ["id"], NAMES)
    assert placed.columns == ["id", "t", "slot", "shard", "shard_name"]
    found = placed.collect()
    table = sharding.fill_table(NAMES)
    assert len(found) == 1002 and all(r["shard"] == table[r["slot"]] for r in found)
    assert len({r["shard"] for r in found if r["id"] == 7}) == 1
    # rows without a key are spread
    assert max(Counter(r["shard"] for r in found if r["id"] is None).values()) < 150
    assert "Exchange hash" not in placed._jdf.queryExecution().executedPlan().toString()
    assert sharding.place(df.limit(0), ["id"], NAMES).count() == 0


def test_two_keys_are_kept_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("c", None)], "x string, y string")
    assert len({r["slot"] for r in sharding.place(df, ["x", "y"], NAMES).collect()}) == 4


def test_write_shards(spark, tmp_path):
    df = sharding.place(spark.range(300), ["id"], NAMES)
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("id", "shard").collect())) == sorted(
        map(tuple, df.select("id", "shard").collect())
    )


@given(
    st.lists(st.integers(0, 10_000), min_size=1, max_size=12),
    st.sampled_from([(5, 2, 1), (1,), (3, 0.5)]),
)
def test_targets(sizes, weights):
    each = [weights[i % len(weights)] for i in range(len(sizes))]
    found = mixing.targets(sizes, each)
    assert all(t <= 2 * s for t, s in zip(found, sizes))
    assert sum(found) == pytest.approx(1.5 * sum(sizes))
    free = [t / w for t, s, w in zip(found, sizes, each) if t < 2 * s * (1 - 1e-9)]
    assert not free or max(free) == pytest.approx(min(free))
    # sources at their limit would get at least as much by their weight
    assert all(not free or t / w <= max(free) * (1 + 1e-9) for t, w in zip(found, each))


def area(schedule, t):
    total = 0.0
    for (a, v), (b, w) in zip(schedule, schedule[1:]):
        if t > a:
            x = min(t, b)
            at = v + (w - v) * (x - a) / (b - a)
            total += (x - a) * (v + at) / 2
    return total


CURVES = [mixing.FLAT, ((0, 0.5), (0.5, 1), (1, 1.5)), ((0, 0), (0.3, 0), (0.6, 2), (1, 0))]


@pytest.mark.parametrize("schedule", CURVES)
def test_time_is_the_inverse_of_demand(spark, schedule):
    from pyspark.sql import functions as F

    from perilscope.columns import constant

    target = 1000.0
    segments = constant(mixing.demand(schedule, target), mixing.SEGMENTS)
    rows = spark.range(0, 1000, 37).select(
        "id", mixing.time_of(F.col("id").cast("double"), segments).alias("t")
    ).collect()
    for r in rows:
        assert area(schedule, r["t"]) / area(schedule, 1) * target == pytest.approx(r["id"], abs=1e-6)


@pytest.mark.parametrize(
    "schedule", [((0, 1), (0.5, 1)), ((0, 1), (0, 1), (1, 1)), ((0, -1), (1, 1)), ((0, 0), (1, 0))]
)
def test_faulty_schedules(schedule):
    with pytest.raises(ValueError):
        mixing.demand(schedule, 1.0)


def mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, size string")
    return mixing.assign(df.repartition(5), (5, 2, 1), CURVES[:2], **options)


ROWS = [(i, "abc"[i % 7 % 3], "w " * (i % 11), "x") for i in range(400)] + [
    (None, None, "a b", ""), (None, None, "a b", ""), (5, "c", None, None), (6, "empty", "", None),
]


@pytest.mark.parametrize("per_bucket", [3, 100_000])
def test_mix(spark, per_bucket):
    found = mixed(spark, ROWS, rows_per_bucket=per_bucket).collect()
    assert len(found) == len(ROWS)
    taken, target = Counter(), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= len(r["positions"]) <= 2
        assert all(0 <= p < 1 for p in r["positions"]) and bool(r["taken"]) == bool(r["positions"])
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def test_mix_does_not_depend_on_buckets(spark):
    a, b = (
        sorted(map(str, mixed(spark, ROWS, rows_per_bucket=n).collect())) for n in (3, 100_000)
    )
    assert a == b


def test_curriculum_is_sorted(spark):
    order = [r["position"] for r in mixing.curriculum(mixed(spark, ROWS)).collect()]
    assert order == sorted(order) and len(order) > 400


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, source string, text string")
    assert mixing.assign(empty, (1,)).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (2, "a", "")], empty.schema)
    assert [r["taken"] for r in mixing.assign(nothing, (1,)).collect()] == [0, 0]


@settings(max_examples=20)
@given(st.lists(st.integers(1, 50), min_size=2, max_size=5))
def test_exact_shares(sizes):
    total = sum(map(Fraction, mixing.targets(sizes, [1] * len(sizes))))
    assert abs(total - Fraction(3, 2) * sum(sizes)) < Fraction(1, 10**6)
