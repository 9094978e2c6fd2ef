"""Rule tables as frames against plain Python."""

import random

import pyarrow as pa
import pytest

from perilscope.operators import matching, rules

WORDS = ["anvil", "bolt", "gear", "gizmo", "hot", "lever", "old", "plate", "promo", "red", "ring", "rod"]


def table(spark, triples):
    pattern, label, ord_ = zip(*triples) if triples else ((), (), ())
    return spark.createDataFrame(
        pa.table({
            "pattern": pa.array(pattern, pa.string()), "label": pa.array(label, pa.string()),
            "ord": pa.array(ord_, pa.int64()),
        })
    )


def texts(spark, values):
    return spark.createDataFrame(pa.table({"t": pa.array(values, pa.string())})).repartition(3)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def some(n, seed, odd=0.2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
        if rng.random() < odd:
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(["", "é", "ด้", t[at] * 2]) + t[at + 1 :]
        out.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_first_contained(spark, seed):
    subjects = [*some(150, seed), "", None, "x" * 3000 + "ring" + "y" * 900, "a", "ร"]
    triples = [(p, f"l{i % 7}", i // 2) for i, p in enumerate(dict.fromkeys([*some(80, seed + 9), "a", "ri", "ring", "ร", "gé"]))]
    got = {r["text"]: tuple(r["rule"]) for r in matching.first_contained(texts(spark, subjects), "t", table(spark, triples)).collect()}
    for t in set(subjects):
        hits = [(o, x, p) for p, x, o in triples if t and p in t]
        assert got.get(t) == (min(hits) if hits else None)


def test_first_touching_works_both_ways(spark):
    subjects = [*some(100, 4, 0.5), "od", "l", "zz", ""]
    triples = [(p, "x", i) for i, p in enumerate(dict.fromkeys([*some(60, 5), "no" * 700]))]
    got = {r["text"]: r["rule"]["ord"] for r in matching.first_touching(texts(spark, subjects), "t", table(spark, triples)).collect()}
    for t in set(subjects):
        hits = [o for p, _, o in triples if t and (p in t or t in p)]
        assert got.get(t) == (min(hits) if hits else None)


@pytest.mark.parametrize("min_score", [97, 90, 70, 40])
def test_nearest(spark, min_score):
    subjects = [*some(60, 7, 0.8), "", None, "ก", "q" * 90 + "r", "red"]
    triples = [(p, f"l{i % 5}", i) for i, p in enumerate(dict.fromkeys([*some(50, 8, 0.8), "q" * 90, "ก", "re"]))]
    known = table(spark, triples)
    got = {r["text"]: (r["best"]["score"], r["best"]["pattern"]) for r in matching.nearest(texts(spark, subjects), "t", known, min_score).collect()}
    for t in set(subjects):
        scored = [(200.0 * lcs(t, p) / (len(t) + len(p)), -o, p) for p, _, o in triples] if t else []
        best = max((s for s in scored if s[0] >= min_score), default=None)
        assert got.get(t) == (best and (best[0], best[2]))


def test_a_text_meets_few_rules(spark):
    """Of 3,000 rules of one length, a text is compared with those that share a segment."""
    rng = random.Random(11)
    patterns = ["".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(3000)]
    known = table(spark, [(p, "x", i) for i, p in enumerate(patterns)])
    asked = [p[:20] + "X" + p[21:] for p in patterns[::100]]
    met = matching.candidates(texts(spark, asked), "t", known, 95)
    assert len(asked) <= met.count() <= 2 * len(asked)
    assert "CartesianProduct" not in met._jdf.queryExecution().executedPlan().toString()


def test_a_hundred_thousand_rules(spark):
    """No limit, the first rule in order wins, and a frame, pairs and groups give the same."""
    pairs = [(f"part {i:06d}", f"l{i % 3}") for i in range(100_000)]
    pairs += [("part 000007 x", "late"), ("part", "last")]
    subjects = ["a part 000007 x", "part 099999", "part", "nothing", "part 00", None]
    df = texts(spark, subjects)
    want = {"a part 000007 x": "l1", "part 099999": "l0", "part": "last", "nothing": "-", "part 00": "last", None: "-"}
    frame = table(spark, [(p, x, i) for i, (p, x) in enumerate(pairs)])
    for given in (pairs, frame):
        got = rules.first_contains(df, "t", given, "-")
        assert {r["t"]: r["theme"] for r in got.collect()} == want
    # as tokens, "part" and "part 00" are part of the first rule
    got = {r["t"]: r["theme"] for r in rules.classify(df, "t", frame, stages=("exact", "token"))[0].collect()}
    assert got == {**want, "part": "last", "part 00": "l0", "nothing": None, None: None}


def test_the_cascade_is_the_same_by_joins(spark, monkeypatch):
    subjects = [*some(80, 21, 0.5), "red/old rod (x)/gear", "(only)", "/", "", None, " bolt "]
    pairs = [(p, f"l{i % 4}") for i, p in enumerate([*some(30, 22, 0.5), "oldd rod", "bolt"])]
    pairs = [(p, x) for p, x in pairs if len(p) > 3]
    df = texts(spark, [*subjects, *subjects[:20]])
    literal = rules.classify(df, "t", pairs, {"gear": "oldd rod"}, min_score=80)
    by_expression = sorted(map(str, literal[0].collect())), literal[1].collect()
    monkeypatch.setattr(rules, "JOIN_FROM", 0)
    joined = rules.classify(df, "t", pairs, {"gear": "oldd rod"}, min_score=80)
    assert (sorted(map(str, joined[0].collect())), joined[1].collect()) == by_expression


def test_shadowed_rules_of_a_large_table(spark):
    triples = [("b", "X", 5), ("ab", "Y", 9), ("abc", "X", 11), *((f"q{i:05d}", "Z", 20 + i) for i in range(11_000))]
    got = rules.shadow_report(table(spark, triples)).collect()
    assert [tuple(r) for r in got] == [("ab", "Y", 1, "b", "X")]


def test_no_rules_no_texts(spark):
    none = table(spark, [])
    assert matching.first_contained(texts(spark, ["a"]), "t", none).collect() == []
    assert matching.nearest(texts(spark, ["a"]), "t", none, 90).collect() == []
    assert matching.first_touching(texts(spark, []), "t", table(spark, [("a", "b", 1)])).collect() == []
