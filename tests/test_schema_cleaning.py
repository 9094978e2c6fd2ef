import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perilscope import presets
from perilscope.operators import cleaning, schema


def test_drops(frame):
    df = frame(
        **{"Unnamed: 0": [1, 2], "a": ["x", None], "b": [None, None]}, types={"b": pa.string()}
    )
    assert schema.drop_unnamed(df).columns == ["a", "b"]
    assert schema.drop_empty_columns(df).columns == ["Unnamed: 0", "a"]


def test_a_late_value_keeps_its_column(frame):
    df = frame(a=[1] * 9, b=[None] * 8 + ["x"], c=[None] * 9, types={"c": pa.string()})
    assert schema.drop_empty_columns(df).columns == ["a", "b"]


def test_name_scores():
    """Names that contain or reorder the wanted words."""
    assert schema.name_score("area", "area") == 100
    assert schema.name_score("cause", "true cause of it") == 90
    assert schema.name_score("first second", "second first") == 95
    assert schema.name_score("area", "cause") < 80 and schema.name_score("", "x") == 0
    assert 0 < schema.name_score("ab", "a" * 40) < 60
    assert schema.part_score("abc", "xxabcxx") == 100 and schema.part_score("ab", "bc") == 200 / 3


def test_a_name_within_another(frame):
    df = frame(**{"the true cause of it": ["x"], "other": ["y"]})
    out, report = schema.resolve_columns(df, ["true cause"])
    assert out.columns == ["true cause", "other"]
    assert report.first()["score"] == 90


def test_resolve_by_white_space_and_similarity(frame):
    df = frame(
        **{" area\n name ": ["x"], "cause of it": ["y"], "severty": ["z"], "old": [1], "spare": [2]}
    )
    out, report = schema.resolve_columns(
        df, ["area name", "causeofit", "severity"], ["age"], {"old": "age", "gone": "z"}
    )
    assert out.columns == ["area name", "causeofit", "severity", "age", "spare"]
    found = {r["target"]: (r["status"], r["source"]) for r in report.collect()}
    assert found == {
        "area name": ("exact", "area name"), "causeofit": ("normalized", "cause of it"),
        "severity": ("fuzzy", "severty"), "age": ("exact", "age"),
    }


def test_a_column_serves_one_target_and_required_ones_come_first(frame):
    df = frame(**{"area nam": ["x"]})
    out, report = schema.resolve_columns(df, ["area name"], ["area names"])
    assert out.columns == ["area name"]
    status = {r["target"]: r["status"] for r in report.collect()}
    assert status == {"area name": "fuzzy", "area names": "NOT FOUND"}


def test_missing_required_column_names_the_closest(frame):
    with pytest.raises(ValueError, match="cause.*closest: 'case'"):
        schema.resolve_columns(frame(case=[1]), ["cause text"])
    with pytest.raises(ValueError, match="become equal"):
        schema.squash_names(frame(**{"a  b": [1], "a b": [2]}))


def test_names_with_dots_and_line_breaks(frame):
    name = presets.INCIDENT_DATE
    df = frame(**{name: ["2568-01-01"], presets.SPEED: ["4"], presets.PERSONAL_COLUMNS[4]: ["p"]})
    out = schema.drop_personal(schema.squash_names(df), presets.PERSONAL_COLUMNS)
    assert out.columns == [name, "ความเร็วรถขณะเกิดเหตุ (ใส่เฉพาะตัวเลข)"]
    assert schema.find_column(out, presets.DATE_WORDS) == name
    assert cleaning.blank_to_null(out).first()[0] == "2568-01-01"


def test_blank_texts_and_numbers(frame):
    df = frame(
        i=[0, 1, 2, 3, 4, 5, 6, 7],
        t=["", " nan ", "<NA>", "None", " x ", "nano", None, " "],
        n=["5", " 5.5 ", "5d", "nan", "1e3", "-2", "๑๒", "1,000"],
    )
    rows = cleaning.coerce_numeric(cleaning.blank_to_null(df), ["n", "absent"]).orderBy("i").collect()
    assert [r["t"] for r in rows] == [None, None, None, None, "x", "nano", None, None]
    assert [r["n"] for r in rows] == [5.0, 5.5, None, None, 1000.0, -2.0, 12.0, None]
    nan = cleaning.coerce_numeric(frame(v=[float("nan"), 1.0]), ["v"])
    assert {r["v"] for r in nan.collect()} == {None, 1.0}


def test_fill_training_and_years(frame):
    df = frame(area=["a", "b", None], theme=["x", None, "y"], road=[None, "r", None])
    out = cleaning.training_set(df, ["area", "road", "gone"], "theme", ["area"], ["road"])
    assert out.collect() == [("a", "Unknown", "x")]
    both = cleaning.union_years({1: df.select("area"), 2: df.select("road", "area")})
    assert both.columns == ["area", "year", "road"]
    assert both.count() == 6 and both.where("year = 1 AND road IS NULL").count() == 3


def test_operators_keep_empty_frames_empty(frame):
    df = frame(a=["x"], b=["y"]).where(F.lit(False))
    assert cleaning.blank_to_null(df).isEmpty()
    assert schema.drop_empty_columns(df).columns == []
    assert cleaning.fill_unknown(df, ["a", "z"]).columns == ["a", "b", "z"]
