import pyarrow as pa
import pytest

from perilscope import presets
from perilscope.operators import rules

RULES = [("ring road", "Road"), ("ring", "Tool"), ("speeding", "Speed"), ("abcdefghijklmnopqrstuvwx", "Long")]


def labels(df, column="t"):
    return {r[column]: r["theme"] for r in df.collect()}


def test_cascade_order(frame):
    texts = [
        "ring", "a ring / speeding", "(ring)", "QQ", "speed", "syn", None, "",
        "abcdefghijklmnopqrstuvw",  # part of a rule
        "abcdefghijkl_mnopqrstuvwx",  # one letter more than a rule
        "zzz/abcdefghijkl_mnopqrstuvwx",
    ]
    out, unmapped = rules.classify(frame(t=texts), "t", RULES, {"syn": "speeding"})
    got = labels(out)
    assert got["ring"] == "Tool"  # exact before the earlier rule that contains it
    assert got["a ring / speeding"] == "Tool"  # the first token decides
    assert got["(ring)"] is None and got[""] is None  # an empty token is part of no rule
    assert got["speed"] == "Speed" and got["syn"] == "Speed"
    assert got["abcdefghijklmnopqrstuvw"] == "Long"
    assert got["abcdefghijkl_mnopqrstuvwx"] == "Long"
    assert got["zzz/abcdefghijkl_mnopqrstuvwx"] == "Long"
    assert got[None] is None
    assert [r["cause"] for r in unmapped.collect()] == ["", "(ring)", "QQ"]


def test_token_containment_keeps_rule_order(frame):
    got = labels(rules.classify(frame(t=["ring r", "ring roads"]), "t", RULES, stages=["token"])[0])
    assert got == {"ring r": "Road", "ring roads": "Road"}


def test_rows_and_distinct_texts_agree_and_repeats_do_not_matter(frame):
    texts = ["ring", "speeding now", "QQ", None] * 50
    df = frame(t=texts)
    joined, _ = rules.classify(df, "t", RULES)
    by_row = df.withColumn("theme", rules.label_of("t", RULES))
    assert sorted(joined.collect(), key=str) == sorted(by_row.collect(), key=str)
    again, _ = rules.classify(joined, "t", RULES)
    assert sorted(again.collect(), key=str) == sorted(joined.collect(), key=str)


def test_too_many_labels_to_broadcast(frame, monkeypatch):
    from perilscope.operators import joins

    df = frame(t=["ring", "QQ", None, "speeding"] * 10)
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    spread = joins.spread_left_join
    monkeypatch.setattr(
        joins, "spread_left_join", lambda *a, **k: spread(*a, **k, hot_rows=5, salts=3)
    )
    got = rules.classify(df, "t", RULES)[0]
    assert got.count() == 40 and labels(got) == {
        "ring": "Tool", "QQ": None, None: None, "speeding": "Speed",
    }


def test_thai_rules(frame):
    texts = ["ขับเร็ว", "รถตัดหน้า (ด้านขวา)", "ถนนลื่น/ฝนตก", "ผู้ขับขี่ผิดพลาดเอง", "???"]
    out, unmapped = rules.classify(
        frame(t=texts), "t", presets.CAUSE_PATTERNS, presets.SYNONYMS, min_score=97
    )
    assert labels(out) == {
        "ขับเร็ว": "Speed Awareness", "รถตัดหน้า (ด้านขวา)": "Defensive Driving",
        "ถนนลื่น/ฝนตก": "Road & Vehicle Safety", "ผู้ขับขี่ผิดพลาดเอง": "Focus & Attention",
        "???": None,
    }
    assert unmapped.count() == 1
    assert len(rules.rule_list(presets.CAUSE_PATTERNS)) == 148


def test_first_contains(frame):
    df = frame(t=["the ring road", "ring", None, "z"])
    pairs = [("ring", "Tool"), ("ring road", "Road")]
    assert labels(rules.first_contains(df, "t", pairs, "Other")) == {
        "the ring road": "Tool", "ring": "Tool", None: "Other", "z": "Other",
    }
    longest = labels(rules.first_contains(df, "t", pairs, "Other", order="longest"))
    assert longest["the ring road"] == "Road"
    many = pairs + [(f"word{i:02}", f"L{i}") for i in range(60)]
    df = frame(t=["the ring road", "word59 word07", None])
    got = labels(rules.first_contains(df, "t", many, "Other"))
    assert got == {"the ring road": "Tool", "word59 word07": "L7", None: "Other"}


def test_factor_cases(frame):
    df = frame(
        i=[0, 1, 2, 3, 4],
        cause=["ถนนลื่น", "ยางแตก", "แซงซ้าย", None, "x"],
        surface=[None, "แห้ง", "แห้ง", "ลื่น", "แห้ง"],
    )
    out = rules.priority_class(df, presets.FACTOR_CASES, presets.FACTOR_DEFAULT)
    assert [r["factor"] for r in out.orderBy("i").collect()] == [
        "Environment", "Machine", "Method", "Environment", "Man",
    ]


def test_rule_tables(spark):
    table = rules.rule_frame(spark, [("b", "X"), ("ab", "Y"), ("abc", "X"), ("q", "Z")])
    assert rules.rule_list(table) == [("b", "X"), ("ab", "Y"), ("abc", "X"), ("q", "Z")]
    assert [tuple(r) for r in rules.shadow_report(table).collect()] == [("ab", "Y", 1, "b", "X")]
    assert [r["cause"] for r in rules.rule_table(table, "X").collect()] == ["abc", "b"]
    with pytest.raises(ValueError, match="more than 3"):
        rules.rule_list(table, 3)


def test_keyword_themes(frame):
    themes = {"Turn": ["turn", "lane"], "Hit": ["crash", "turn back"], "Dirt": ["slippery"]}
    texts = ["crash / turn", "go lane", "slipery floor", "zz", "", None, "nan", "(x)"]
    out, report = rules.keyword_theme(frame(t=texts), "t", themes, other="?")
    assert labels(out) == {
        "crash / turn": "Hit", "go lane": "Turn", "slipery floor": "Dirt", "zz": "?", "": "?",
        None: "?", "nan": "?", "(x)": "?",
    }
    reasons = {r["cause"]: r["reason"] for r in report.collect()}
    assert reasons["crash / turn"] == "exact token 'crash'"
    assert reasons["slipery floor"] == "fuzzy 93% 'slipery floor'≈'slippery'"
    assert reasons["zz"] == "no match, tokens=['zz']"
    assert reasons[""] == reasons["nan"] == "empty input"
    assert None not in reasons


def test_thai_keywords(frame):
    out, _ = rules.keyword_theme(
        frame(t=["ถูกชนท้าย", "ถนนลื่นมาก", "abc"]), "t", presets.KEYWORDS,
        presets.KEYWORD_FUZZY_MIN, presets.KEYWORD_OTHER,
    )
    assert labels(out) == {
        "ถูกชนท้าย": "ชนคู่กรณี", "ถนนลื่นมาก": "สภาพถนน/สิ่งแวดล้อม", "abc": presets.KEYWORD_OTHER,
    }


def test_mapping_stats(frame):
    df = frame(theme=["a", None, "b"])
    assert rules.mapping_stats(df, "theme").first() == (2, 1, 66.7)


def test_distinct_texts_are_spread(spark, frame):
    df = rules.distinct_texts(frame(t=["a", "b", "a", None], types={"t": pa.string()}), "t")
    assert sorted(tuple(r) for r in df.collect()) == [("a", 2), ("b", 1)]
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_row_label_on_a_stream(spark, frame, tmp_path):
    frame(t=["ring", "QQ", "speeding fast"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    query = (
        stream.withColumn("theme", rules.label_of("t", RULES))
        .writeStream.format("memory").queryName("labelled").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert labels(spark.table("labelled")) == {"ring": "Tool", "QQ": None, "speeding fast": "Speed"}
