import datetime
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perilscope import presets
from perilscope.plans import forecast, incident
from perilscope.sources.outputs import read_output, run_name, write_outputs
from perilscope.sources.tables import promote_header, read_sheet, read_table


@pytest.fixture
def thai(frame):
    """A small table as the forms have it: dirty names, dirty values."""
    causes = ["ขับเร็ว", "รถตัดหน้า", "ถนนลื่น (ฝน)/อื่นๆ", "ง่วงนอน", "???", "nan"]
    severities = [presets.SEVERITIES[i] for i in (0, 1, 2, 0, 1, 2)]
    n = 60
    return frame(
        **{
            "Unnamed: 0": list(range(n)),
            " พื้นที่": [f"เขต {i % 3 + 1}" for i in range(n)],
            presets.CAUSE.replace(" ", "  "): [causes[i % 6] for i in range(n)],
            presets.SEVERITY + "\n": [severities[(i * 5 + i // 7) % 6] for i in range(n)],
            presets.AGE: ["25", "31", "x", None, "20", "40"] * 10,
            presets.MONTH: ["jan", "Feb", "JUN", "dec", None, "Mar"] * 10,
            presets.TIME: ["8:30", "13.00", "23:59", "2:00", "x", None] * 10,
            presets.RIDER_EXPERIENCE: ["2ปี", "3เดือน", "1ปี6เดือน", "5ปี", None, "x"] * 10,
            presets.EMPLOYEE: [str(1000000 + i) for i in range(n)],
            "ชื่อ": ["name"] * n,
            "empty": [None] * n,
        },
        types={"empty": pa.string()},
    )


def plan(**more):
    return incident.IncidentPlan(
        area=presets.AREA, cause=presets.CAUSE, severity=presets.SEVERITY,
        severe=[presets.SEVERE], themes=presets.THEMES, rules=presets.CAUSE_PATTERNS,
        optional=[presets.AGE, presets.TIME, presets.MONTH, presets.RIDER_EXPERIENCE,
                  presets.EMPLOYEE],
        numbers=[presets.AGE], age=presets.AGE, time=presets.TIME, month=presets.MONTH,
        rider_experience=presets.RIDER_EXPERIENCE, employee=presets.EMPLOYEE,
        personal=presets.PERSONAL_COLUMNS, synonyms=presets.SYNONYMS, units=presets.DURATION_UNITS,
        area_products=presets.AREA_PRODUCTS, default_area_product=presets.DEFAULT_AREA_PRODUCT,
        row_products=presets.ROW_PRODUCTS, default_row_product=presets.DEFAULT_ROW_PRODUCT,
        texts=(presets.REASON_SAME, presets.REASON_OTHER, presets.INSIGHT),
        cause_text=presets.CAUSE_COUNT_TEXT,
        row_columns=[presets.AREA, presets.CAUSE, "campaign_theme", "period", "not there"], **more,
    )


def test_incident_run(spark, thai, frame, tmp_path):
    master = frame(**{presets.EMPLOYEE: ["1000001", "1000002"], "branch": ["p", "q"]})
    result = incident.run_pipeline(thai, plan(), master)
    rows = result.rows
    assert not {"ชื่อ", "empty", "Unnamed: 0", presets.EMPLOYEE} & set(rows.columns)
    themes = {r[0]: r[1] for r in rows.select(presets.CAUSE, "campaign_theme").distinct().collect()}
    assert themes == {
        "ขับเร็ว": "Speed Awareness", "รถตัดหน้า": "Defensive Driving",
        "ถนนลื่น (ฝน)/อื่นๆ": "Road & Vehicle Safety", "ง่วงนอน": "Focus & Attention",
        "???": None, None: None,
    }
    groups = {r[0]: r[1] for r in rows.select("rider_exp_group", "rider_exp_month").distinct().collect()}
    assert groups["1-2y"] in (18.0, 24.0) and groups["<3m"] in (0.0, 3.0) and groups[None] is None
    assert {r["quarter"] for r in rows.select("quarter").distinct().collect()} == {1, 2, 4, None}
    assert [r["cause"] for r in result.unmapped.collect()] == ["???"]
    summary = result.area_summary.collect()
    assert {r[presets.AREA] for r in summary} == {"เขต 1", "เขต 2", "เขต 3"}
    scores = [r["risk_score"] for r in summary]
    assert scores == sorted(scores, reverse=True)
    assert all("คะแนน" in r["reason"] and r["insight"].startswith("ความเสี่ยง: ") for r in summary)
    assert any("ครั้ง)" in r["recommended_campaign_detail"] for r in summary)
    assert result.joined.count() == 60 and result.joined.where("branch IS NOT NULL").count() == 2
    paths = incident.write_run(result, plan(), str(tmp_path), "run 1")
    assert set(paths) == {"area_summary", "rows", "unmapped", "joined"}
    back = read_output(spark, str(tmp_path), "rows", "run 1")
    assert back.columns == [presets.AREA, presets.CAUSE, "campaign_theme", "period"]
    assert back.count() == 60
    assert result.column_report.where("status = 'NOT FOUND'").isEmpty()


def test_forecast_run(spark, frame, tmp_path):
    def year(shift):
        n = 240
        causes = ["ขับรถเร็ว", "รถตัดหน้า", "ถนนลื่น", "ง่วงนอน", "อื่นๆ"]
        return frame(
            **{
                "key": [f"{shift}-{i}" for i in range(n)],
                presets.AREA: [f"เขต {i % 2 + 1}" for i in range(n)],
                "สาเหตุที่แท้จริง": [causes[(i + i // 5 * (i % 3) + shift) % 5] for i in range(n)],
                "เดือน (ไทย)": [["ม.ค.", "พ.ค.", "ก.ย.", "ธ.ค."][i % 4] for i in range(n)],
                presets.ROAD_SURFACE: [["แห้ง", "ลื่น", None][i % 3] for i in range(n)],
            }
        )

    names = forecast.ForecastPlan(
        area=presets.AREA, cause_word=presets.CAUSE_WORD, default_cause=presets.CAUSE,
        month_word=presets.MONTH_WORD, themes=presets.FORECAST_PATTERNS,
        default_theme=presets.DEFAULT_THEME, factor_cases=presets.FACTOR_CASES,
        factor_default=presets.FACTOR_DEFAULT, surface=presets.ROAD_SURFACE,
        features=["quarter", presets.AREA, presets.VISIBILITY, presets.ROAD_SURFACE, "factor"],
        key=["key"], years=presets.YEARS, second_year_renames=presets.SECOND_YEAR_RENAMES,
        drop=[presets.SECOND_YEAR_EXTRA], trees=8, depth=4,
    )
    result = forecast.run_forecast(year(0), year(1), names)
    rows = result.forecast.collect()
    assert {r["quarter"] for r in rows} == {"Q3", "Q4"}
    assert {r["campaign_theme"] for r in rows} == set(presets.THEMES)
    assert all(0 <= r["estimated_prob"] <= 150 and 0.8 <= r["trend"] <= 1.5 for r in rows)
    themes = result.themes.collect()
    assert len(themes) == 4
    for r in themes:
        probs = [r[f"prob_{t}"] for t in presets.THEMES]
        assert sum(probs) == pytest.approx(100, abs=0.05) and r["top_prob"] == max(probs)
    assert 0 <= result.accuracy.first()["accuracy"] <= 100
    assert result.importances.count() == 5
    assert result.report.count() >= 4
    assert result.cleaned.count() == 480
    written = forecast.write_forecast(result, str(tmp_path), "r1", "csv")
    assert set(written) == {"forecast", "theme_forecast", "importances", "accuracy"}
    back = read_output(spark, str(tmp_path), "forecast", "r1", "csv")
    assert back.count() == len(rows)
    figures = forecast.forecast_kpis(result.forecast, presets.AREA, "campaign_theme").first()
    assert figures["top_theme"] in presets.THEMES


def test_run_name():
    at = datetime.datetime(2025, 1, 2, 3, 4, 5)
    assert run_name("sheet1", at) == "sheet1_20250102_030405" and run_name(at=at) == "20250102_030405"


def test_empty_frames_are_not_written(spark, frame, tmp_path):
    df = frame(a=[1, 2])
    paths = write_outputs(
        {"x": df, "unmapped": df.where(F.lit(False)), "joined": None}, str(tmp_path), "r"
    )
    assert list(paths) == ["x"] and os.path.isdir(tmp_path / "x" / "run_id=r")
    write_outputs({"x": df.limit(1)}, str(tmp_path), "r")
    assert read_output(spark, str(tmp_path), "x", "r").count() == 1


def test_sheet_with_a_late_header(spark, tmp_path):
    lines = ["พื้นที่ 2025,,", ",,", "no,พื้นที่,", *[f"{i},เขต {i},{i}" for i in range(2000)]]
    path = tmp_path / "sheet.csv"
    path.write_text("\n".join(lines), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = promote_header(read_sheet(spark, str(path), 3), "line", presets.HEADER_MARKERS)
        assert df.columns == ["line", "no", "พื้นที่", "Unnamed: 2"]
        assert df.rdd.getNumPartitions() > 3
        assert df.count() == 2000 and df.agg(F.min(F.col("no").cast("int"))).first()[0] == 0
        # line numbers grow with the place in the file, over all splits
        late = df.orderBy("line").select(F.col("no").cast("int").alias("n")).collect()
        assert [r["n"] for r in late] == list(range(2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = promote_header(read_sheet(spark, str(path), 3), "line", ["no such mark"])
    assert first.columns == ["line", "พื้นที่ 2025", "Unnamed: 1", "Unnamed: 2"] and first.count() == 2002
    csv = read_table(spark, str(path))
    assert csv.count() == 2002


def test_sheet_of_several_files(spark, tmp_path):
    """Spark reads the largest file first; the header is in the first one by name."""
    (tmp_path / "a.csv").write_text("title,,\nno,พื้นที่,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("".join(f"{i},z,y\n" for i in range(500)), encoding="utf-8")
    (tmp_path / "c.csv").write_text("500,z,y\n", encoding="utf-8")
    df = promote_header(read_sheet(spark, str(tmp_path), 3), "line", presets.HEADER_MARKERS)
    assert df.columns == ["line", "no", "พื้นที่", "x"]
    assert [int(r["no"]) for r in df.orderBy("line").collect()] == list(range(501))


def test_header_with_line_breaks(spark, tmp_path):
    path = tmp_path / "form.csv"
    path.write_text('area,"speed \n(digits)",cause\n1,"2",x\n', encoding="utf-8")
    df = read_table(spark, str(path), multi_line=True)
    assert df.columns == ["area", "speed \n(digits)", "cause"] and df.count() == 1
    cells = read_sheet(spark, str(path), 3, multi_line=True)
    assert promote_header(cells, "line", ["area"]).columns[2] == "speed \n(digits)"
    assert promote_header(cells.limit(0), "line", ["area"]).columns == cells.columns
