import pyarrow as pa
import pytest

from perilscope.functions.numbers import percent
from perilscope.operators import area, crosstab, ranking, report, trend

THEMES = {"A": "a", "Road": "road", "Speed": "speed"}


@pytest.fixture
def rows(frame):
    # area 1: A A Road, severe 1 of 4; area 2: Speed only; area 3: no theme at all
    return frame(
        area=["1", "1", "1", "1", "2", "2", "3", None],
        theme=["A", "A", "Road", None, "Speed", "Speed", None, "A"],
        severity=["long", "none", "none", "none", "long", None, "none", "long"],
        cause=["x", "x", "y", "q", "z", "w", None, "x"],
    )


def summary(rows, **more):
    return area.area_summary(rows, "area", "theme", "severity", ["long"], THEMES, **more)


def test_shares_scores_and_bands(rows):
    found = {r["area"]: r.asDict() for r in summary(rows).collect()}
    assert set(found) == {"1", "2", "3"}
    one = found["1"]
    # themes: 2 and 1 of 3; severity: 1 of 4; impacts over all rows: A 2 of 3, Road 0, Speed 1
    assert (one["a_pct"], one["road_pct"], one["speed_pct"]) == (66.7, 33.3, 0.0)
    assert one["severity_pct"] == 25.0
    assert one["a_score"] == round(66.7 * (2 / 3 * 100.0), 2)
    assert (one["road_score"], one["speed_score"]) == (0.0, 0.0)
    assert one["risk_score"] == 22.49 and one["priority_level"] == "Medium"
    assert one["dominant_theme"] == one["recommended_campaign"] == "A"
    assert one["supporting_campaigns"] == "Road > Speed" and one["confidence"] == 100.0
    two = found["2"]
    assert (two["severity_pct"], two["speed_pct"], two["speed_score"]) == (100.0, 100.0, 10000.0)
    assert two["risk_score"] == 70.0 and two["priority_level"] == "High"


def test_area_without_theme_keeps_its_row(rows):
    three = {r["area"]: r for r in summary(rows).collect()}["3"]
    assert three["severity_pct"] == 0.0
    for name in ("a_pct", "a_score", "risk_score", "priority_level", "dominant_theme",
                 "recommended_campaign", "supporting_campaigns", "confidence"):
        assert three[name] is None
    assert three["insurance_recommendation"] == "basic"


def test_products_texts_and_detail(rows):
    out = summary(rows, products={("A", "Medium"): "p1"}, texts=("{area}:{band}={score}", "other", "{confidence}"))
    out = area.attach_detail(out, rows, "area", "theme", "cause")
    found = {r["area"]: r for r in out.collect()}
    assert found["1"]["insurance_recommendation"] == "p1"
    assert found["2"]["insurance_recommendation"] == "basic"
    assert found["1"]["reason"] == "1:Medium=22.5" and found["1"]["insight"] == "100.0"
    assert found["1"]["recommended_campaign_detail"] == "x (2)"
    assert found["2"]["recommended_campaign_detail"] == "w (1) • z (1)"
    assert found["3"]["recommended_campaign_detail"] == "-"
    order = [r["area"] for r in area.sort_by_risk(out, "area").collect()]
    assert order == ["2", "1", "3"]


def test_scores_without_rounding(rows):
    exact = {r["area"]: r["a_score"] for r in summary(rows, score_digits=None).collect()}
    assert exact["1"] == 66.7 * (2 / 3 * 100.0)


def test_partitioning_does_not_change_the_summary(rows):
    wide, narrow = (sorted(summary(rows.repartition(n)).collect()) for n in (1, 7))
    assert wide == narrow


def test_shares_of_an_area_sum_to_100(rows):
    table = crosstab.crosstab(rows, "area", "theme", normalize=True)
    for r in table.collect():
        assert sum(v for v in r[1:]) == pytest.approx(100.0, abs=0.2)


def test_crosstab(rows):
    table = crosstab.crosstab(rows, "area", "theme", ["A", "Gone"])
    assert {tuple(r) for r in table.collect()} == {("1", 2, 0), ("2", 0, 0)}
    assert crosstab.crosstab(rows, "area", "theme").columns == ["area", "A", "Road", "Speed"]
    share = crosstab.crosstab(rows, "theme", "severity", ["long"], True)
    assert crosstab.worst_group(share, "theme", "long").first() == ("Speed", 100.0)
    # equal values: the first by name
    equal = share.where("theme <> 'Road'").select("theme", percent("long", "long").alias("long"))
    assert crosstab.worst_group(equal, "theme", "long").first()["group"] == "A"
    impact = {r["theme"]: r["impact"] for r in
              crosstab.theme_impact(rows, "theme", "severity", ["long"]).collect()}
    assert impact == {"A": 2 / 3 * 100.0, "Road": 0.0, "Speed": 100.0}


def test_reshape(frame):
    wide = frame(k=["1"], a=[1.0], b=[2.0])
    long = crosstab.to_long(wide, ["k"], {"a": "A", "b": "B"}, "name", "%")
    assert {tuple(r) for r in long.collect()} == {("1", "A", 1.0), ("1", "B", 2.0)}
    back = crosstab.to_wide(long, ["k"], "name", "%", {"A": "a", "B": "b", "C": "c"})
    assert back.collect() == [("1", 1.0, 2.0, None)]


def test_leading_causes_break_ties_by_text(frame):
    df = frame(k=["g"] * 6, v=["b", "a", "c", "c", "d", None])
    assert [tuple(r) for r in ranking.top_causes(df, ["k"], "v", 3).orderBy("rank").collect()] == [
        ("g", "c", 2, 1), ("g", "a", 1, 2), ("g", "b", 1, 3),
    ]
    share = {r["v"]: r["share"] for r in ranking.cause_share(df, ["k"], "v", 2).collect()}
    assert share == {"c": 0.4, "a": 0.2}


def test_trend(frame):
    cells = [
        # area, theme, year, quarter, times
        ("p", "up", 1, 1, 1), ("p", "up", 2, 2, 9), ("p", "same", 1, 1, 2), ("p", "same", 2, 1, 2),
        ("p", "new", 2, 1, 1), ("p", "gone", 1, 2, 3), ("p", "late", 2, 4, 1), ("p", None, 1, 3, 6),
        ("only1", "up", 1, 1, 2),
    ]
    flat = [c[:4] for c in cells for _ in range(c[4])]
    df = frame(**{n: [c[i] for c in flat] for i, n in enumerate(("area", "theme", "year", "q"))})
    got = {(r[0], r[1]): r["trend"] for r in
           trend.yoy_trend(df, "area", "theme", "year", "q", 1, 2).collect()}
    assert got[("p", "up")] == 1.5 and got[("p", "gone")] == 0.8
    assert got[("p", "same")] == pytest.approx((2 / 13) / (2 / 12))
    assert got[("p", "new")] == 1.2 and got[("p", "late")] == 1.0
    assert got[("only1", "up")] == 1.0
    same = trend.yoy_trend(df, "area", "theme", "year", "q", 1, 2, same_period_denominator=True)
    values = {(r[0], r[1]): r["trend"] for r in same.collect()}
    assert values[("p", "same")] == 0.8  # 2 of 12 against 2 of 6


def test_modes(frame):
    df = frame(k=["a"] * 5 + ["b"], x=["2", "1", "2", "1", None, None], y=[1, 1, 2, None, None, None],
               types={"x": pa.string(), "y": pa.int32()})
    got = {r["k"]: (r["x"], r["y"]) for r in trend.modal_profile(df, "k", ["x", "y"]).collect()}
    assert got == {"a": ("1", "1"), "b": ("Unknown", "Unknown")}


def test_reports(frame):
    df = frame(m=["Feb", "Jan", "Feb", None], a=["x", "y", "x", "z"], v=[1.0, 2.0, 3.0, None])
    assert [tuple(r) for r in report.counts_by_month(df, "m").collect()] == [("Jan", 1), ("Feb", 2)]
    assert report.value_counts(df, "m", dropna=False).count() == 3
    assert report.slice_rows(df, {"m": ["Feb"], "a": []}).count() == 2
    assert report.slice_rows(df, {"m": ["none"]}).isEmpty()
    again = report.reindex(report.value_counts(df, "a"), "a", ["z", "w", "x"])
    assert [tuple(r) for r in again.collect()] == [("z", 1), ("w", None), ("x", 2)]
    assert [tuple(r) for r in report.null_counts(df, 2).collect()] == [("m", 1), ("v", 1)]
    top = report.rank_rows(df, ["a", "v"], [False, True], 2)
    assert [r["a"] for r in top.collect()] == ["z", "y"]


@pytest.mark.parametrize("few", [3, 50, 1_000_000])
def test_quartiles_are_exact_however_few_values_may_be_ranked(frame, few):
    import random

    import numpy as np

    rnd = random.Random(few)
    values = [rnd.choice([1.0, 1.0, rnd.random() * 9, -rnd.random()]) for _ in range(4001)] + [7.0] * 900
    df = frame(partitions=4, a=values, b=[float(v > 1) for v in values])
    for r in report.describe(df, ["a", "b"], few).collect():
        data = values if r["column"] == "a" else [float(v > 1) for v in values]
        assert r["count"] == len(data)
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx(list(np.percentile(data, [25, 50, 75])))
        assert r["std"] == pytest.approx(np.std(data, ddof=1))


def test_describe_without_values(frame):
    df = frame(a=[None, None], types={"a": pa.float64()})
    row = report.describe(df, ["a"]).first()
    assert row["count"] == 0 and row["median"] is None
