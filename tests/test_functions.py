import datetime

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perilscope import presets
from perilscope.columns import constant
from perilscope.functions import dates, numbers, similarity, text

THAI = presets.DURATION_UNITS


def test_duration(one):
    got = one(
        lambda c: text.duration_months(c, THAI),
        ["2ปี3เดือน", "15วัน", "2สัปดาห์", "๑๐เดือน", "2 ปี", "ไม่ทราบ", None, "1ปี 2ปี"],
    )
    assert got == [27.0, 0.5, 0.5, 10.0, 0.0, 0.0, None, 12.0]
    assert one(lambda c: text.duration_months(c, THAI, allow_space=True), ["2 ปี"]) == [24.0]


def test_clock(one):
    texts = ["8:30", "23.05 น.", "123:45", "noon", None, "๗:๓๐"]
    assert one(text.clock_hour, texts) == [8, 23, 23, None, None, 7]
    assert one(text.day_period, [0, 5, 6, 11, 12, 17, 18, 99, None]) == [
        "Late Night", "Late Night", "Morning", "Morning", "Afternoon", "Afternoon", "Night",
        "Night", None,
    ]


def test_bins_are_closed_on_the_right(one):
    def band(c):
        return numbers.bin_right_closed(c, (0, 20, 30, 100), ("Low", "Medium", "High"))

    assert one(band, [0.0, 0.1, 20.0, 20.1, 30.0, 31.0, 100.0, 101.0, None, float("nan")]) == [
        None, "Low", "Low", "Medium", "Medium", "High", "High", None, None, None,
    ]
    lowest = one(lambda c: numbers.bin_right_closed(c, (0, 1), ("a",), include_lowest=True), [0, 1])
    assert lowest == ["a", "a"]
    with pytest.raises(ValueError):
        numbers.bin_right_closed("x", (0, 1), ("a", "b"))


def test_rounding_is_half_even_on_the_scaled_value(one):
    assert one(lambda c: numbers.round_even(c, 2), [1.005, 2.675, 0.125, None]) == [
        1.0, 2.68, 0.12, None,
    ]
    assert one(lambda c: numbers.round_even(c, 1), [0.25, 0.35, -0.25]) == [0.2, 0.4, -0.2]


def test_clip_and_ratio(frame):
    df = frame(a=[0.5, 1.0, 2.0, None], b=[0.0, 2.0, -1.0, 3.0])
    got = df.select(numbers.clip("a", 0.8, 1.5).alias("c"), numbers.safe_ratio("a", "b").alias("r"))
    assert sorted(got.collect(), key=str) == sorted(
        [(0.8, None), (1.0, 0.5), (1.5, None), (None, None)], key=str
    )


def test_row_wise_ranks(frame):
    df = frame(a=[1.0, 2.0, None, 0.0], b=[1.0, 3.0, None, 0.0], c=[0.5, None, None, 0.0])
    columns = {"A": "a", "B": "b", "C": "c"}
    got = {
        tuple(r[:3]): tuple(r[3:])
        for r in df.select(
            "a", "b", "c", numbers.argmax_label(columns), numbers.ranked_labels(columns),
            numbers.confidence(columns),
        ).collect()
    }
    assert got[(1.0, 1.0, 0.5)] == ("A", ["A", "B", "C"], 50.0)
    assert got[(2.0, 3.0, None)] == ("B", ["B", "A"], 60.0)
    assert got[(None, None, None)] == (None, [], None)
    assert got[(0.0, 0.0, 0.0)] == ("A", ["A", "B", "C"], None)


def test_tokens(one):
    got = one(text.tokens, ["a (x/y) / b//c ", "(only)", "/", "", None, "x\t/ y\n"])
    assert got == [["a", "b", "c"], [""], ["/"], [""], None, ["x", "y"]]


def test_synonyms_and_render(one, frame):
    assert one(lambda c: text.replace_synonym(c, {"a": "b"}), [" a ", "aa", None]) == ["b", "aa", None]
    df = frame(n=[1], s=[None], types={"s": pa.string()})
    row = df.select(text.render("{n} of {s}!", {"n": F.col("n"), "s": "s"}).alias("t")).first()
    assert row["t"] == "1 of -!"


def test_natural_key_sorts_numbers_inside_text(frame):
    long = "zone 1" + "0" * 25
    names = ["zone 10", "zone 2", long, "zone ๓", "zone 2b", "zone 007", "area", "zone 0" * 1]
    got = [r["n"] for r in frame(n=names).orderBy(text.natural_key("n")).collect()]
    assert got == [
        "area", "zone 0", "zone 2", "zone 2b", "zone ๓", "zone 007", "zone 10", long,
    ]


def test_months(one):
    words = ["Jan", " january", "ก.พ.", "07.0", "7.0", "12", "Sept", None]
    assert one(dates.quarter_of_month, words) == [1, 1, 1, 3, 3, 4, None, None]
    assert one(dates.quarter_of_short_month, ["Apr", "apr", "April", None]) == [2, None, None, None]
    assert one(dates.month_key, ["march", "DEC", "x", None]) == [2, 11, 999, 999]


def test_every_month_spelling(one):
    for i, names in enumerate(dates.MONTH_SPELLINGS):
        assert set(one(dates.quarter_of_month, list(names))) == {i // 3 + 1}


def test_era_dates(one):
    got = one(
        dates.era_date,
        ["2568-03-01 00:00:00", "29/2/2567", "2024-02-29", "31/02/2568", "13-1-2569", "x", None],
    )
    day = datetime.date
    assert got == [day(2025, 3, 1), day(2024, 2, 29), day(2024, 2, 29), None, day(2026, 1, 13),
                   None, None]
    assert one(text.leading_year, ["2568-01-01", "1/2/2568", None]) == [2568, None, None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    sides = [(short, long)] + ([(long, short)] if len(a) == len(b) else [])
    return max(
        ratio(s, t[max(0, i) : i + len(s)]) for s, t in sides for i in range(1 - len(s), len(t))
    )


letters = st.text(alphabet="abcdeฝน/", max_size=90)
quiet = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@quiet
@given(st.lists(st.tuples(letters, letters), min_size=30, max_size=60))
def test_indel_ratio_against_the_textbook(frame, pairs):
    df = frame(a=[p[0] for p in pairs], b=[p[1] for p in pairs])
    for r in df.select("a", "b", similarity.indel_ratio("a", "b").alias("r")).collect():
        assert r["r"] == pytest.approx(ratio(r["a"], r["b"]))


short_letters = st.text(alphabet="abcdeฝ", max_size=12)


@quiet
@given(st.lists(st.tuples(short_letters, short_letters), min_size=30, max_size=60))
def test_partial_ratio_against_all_windows(frame, pairs):
    df = frame(a=[p[0] for p in pairs], b=[p[1] for p in pairs])
    for r in df.select("a", "b", similarity.partial_ratio("a", "b").alias("r")).collect():
        assert r["r"] == pytest.approx(partial(r["a"], r["b"]))


@quiet
@given(
    st.lists(st.text(alphabet="abcdeฝ.", max_size=60), min_size=60, max_size=120),
    st.text(alphabet="abcde.ฝ", min_size=1, max_size=14),
    st.sampled_from([70, 85, 95]),
)
def test_seeded_partial_ratio_is_exact_from_its_minimum(frame, texts, word, least):
    # also texts that hold the word with one edit
    texts = [*texts, *[t + word[:i] + word[i + 1 :] + t for i, t in enumerate(texts[: len(word)])]]
    entry = constant(similarity.word_entry(word, least), f"struct<{similarity.WORD_FIELDS}>")
    df = frame(t=texts)
    for r in df.select("t", similarity.partial_ratio_to("t", entry).alias("r")).collect():
        expected = partial(r["t"], word)
        if expected >= least:
            assert r["r"] == pytest.approx(expected)
        else:
            assert (r["r"] or 0.0) < least
