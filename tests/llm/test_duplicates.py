"""Near duplicates, repeated byte strings and components, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from perilscope.llm import neardup, repeats, suffixes
from perilscope.llm.graph import components
from perilscope.llm.words import prefix_hashes

# ---- components


def slow_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def graphs():
    random.seed(1)
    path = list(range(60))
    random.shuffle(path)
    yield list(zip(path, path[1:]))
    yield [(100, i) for i in range(50)] + [(200, i) for i in range(60, 90)]
    yield [(random.randint(0, 80), random.randint(0, 80)) for _ in range(60)]
    yield [(1, 2), (2, 1), (1, 2), (3, 3)]


@pytest.mark.parametrize("links", list(graphs()))
def test_components(spark, links):
    df = spark.createDataFrame(links, "a int, b int")
    want = slow_components([(a, b) for a, b in links if a != b])
    for held in (1_000_000, 2):  # with few links at a time, clusters are put together in rounds
        assert {r["node"]: r["root"] for r in components(df, held=held).collect()} == want


# ---- near duplicates

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_set(text, width):
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def slow_near(rows, width):
    sets = [slow_set(t, width) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    group = slow_components([(i, i) for i in range(len(rows))] + links)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[group[i]].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for d in least[group[i]] if d is not None]
        component = min(ids) if ids and sets[i] else doc
        out.append((doc, len(sets[i]), component, doc == component))
    return out


def near_rows(seed=2):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [random.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n", "one", "One", "one two", "É x", "é x", "a b c d", "a  b\tc D"]
    for _ in range(40):
        base = make(random.choice([6, 20, 60, 200]))
        for _ in range(random.randint(1, 6)):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    big = make(120)
    for i in range(150):  # a dense region, in which some are linked with few others
        copy = list(big)
        for k in range(1 + i % 6):
            copy[random.randrange(120)] = f"own{i}.{k}"
        texts.append(" ".join(copy))
    texts += [" ".join(make(30_000))] * 2 + ["same text of a large group"] * 40
    random.shuffle(texts)
    return list(enumerate(texts)) + [(None, texts[0]), (None, "alone of all"), (3, texts[3])]


RULES = [
    neardup.Rules(width=3, share=10),
    neardup.Rules(width=4, region=4, near=1, group=40, group_trees=16),
]


@pytest.mark.parametrize("rules", RULES)
def test_near_duplicates(spark, rules, monkeypatch):
    if rules.share == 10:
        monkeypatch.setattr(neardup, "HELD", 100)
    rows = near_rows()
    docs = spark.createDataFrame(
        [(i, t, "x", "y", "z") for i, t in rows], "doc_id bigint, text string, node string, n string, kept string"
    ).repartition(5)
    found = sorted(map(tuple, neardup.near_duplicates(docs, rules=rules).collect()), key=str)
    assert found == sorted(slow_near(rows, rules.width), key=str)


def large_family_rows():
    """A large family of texts that share 0.6 to 0.8 of their unions, linked by few pairs."""
    random.seed(13)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(80):
        at = random.sample(range(5, 145, 5), 4)
        for own in (at[1:2], at[2:]):
            copy = list(base)
            copy[at[0]] = f"pair{i}"
            for k in own:
                copy[k] = f"own{i}.{k}"
            texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_large_families_are_compared_whole(spark):
    # with the trees of production, and groups so small that prefixes of several values are needed
    rules = neardup.Rules(region=6, near=1, group=3)
    rows = large_family_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted(map(tuple, neardup.near_duplicates(docs, rules=rules).collect()))
    assert found == sorted(slow_near(rows, rules.width))


def test_regions_that_hold_many_rows_are_dealt_deeper(spark, monkeypatch):
    # more than HELD // 10 copies agree in all values of a tree, so that their deals are cut each time
    monkeypatch.setattr(neardup, "HELD", 100)
    base = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join([*base[: 4 * i], f"own{i}", *base[4 * i + 1 :]])) for i in range(120)]
    rows += [(200 + i, " ".join(f"other{i}.{k}" for k in range(20))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    rules = neardup.Rules()
    classes = neardup.sketch(docs, "doc_id", "text", rules).withColumnRenamed("n_shingles", "n")
    dealt = neardup.forest(classes, rules).select("tree", "node", "deal").collect()
    assert len({(r["tree"], bytes(r["node"])) for r in dealt}) == len(dealt) == 130 * rules.trees
    assert {len(r["deal"]) for r in dealt} >= {2 * rules.min_depth, 2 * rules.depth, 2 * rules.depth + 4}
    found = sorted(map(tuple, neardup.near_duplicates(docs, rules=rules).collect()))
    assert found == sorted(slow_near(rows, rules.width))


@pytest.mark.parametrize(("main", "limits"), [(0, {"group": 8}), (60, {"group_shingles": 600})])
def test_pieces_of_a_family_are_compared_with_each_other(spark, main, limits):
    random.seed(17)
    sets = [set(range(1000 * i, 1000 * i + 90)) for i in range(40)]
    sets += [set(random.sample(sorted(s), 85)) for s in sets]
    sets += [set(range(90_000, 90_090)) | {10**6 + i} for i in range(main)]
    # one that only a class of the most frequent part is linked with
    sets += [set(range(90_000, 90_088)) | {10**7}] if main else []
    first = len(sets) - main - bool(main)
    node = lambda i: i.to_bytes(16, "big")
    rows = spark.createDataFrame(
        [
            (b"f", False, bytearray(node(i)), bytearray(node(first if first <= i < first + main else i)), len(s))
            for i, s in enumerate(sets)
        ],
        "family binary, whole boolean, node binary, part binary, size bigint",
    )
    whole = spark.createDataFrame(
        [(bytearray(node(i)), bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(sets)],
        "node binary, values binary",
    )
    roots = rows.select("node", "part").where("node <> part or conv(hex(node), 16, 10) = '%d'" % first)
    roots = roots.withColumnRenamed("part", "root") if main else None
    links = neardup.links_between_pieces(rows, roots, whole, neardup.Rules(**limits))
    found = {(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in links.collect()}
    assert {(i, i + 40) for i in range(40)} <= found
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in found)
    merged = slow_components([*found, *((first, first + i) for i in range(main))])
    expect = slow_components(
        [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    )
    assert merged == expect


def test_one_document_of_each_group_stays(spark):
    rows = near_rows(4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = neardup.drop_near_duplicates(docs)
    expect = sorted((d for d, _, c, k in slow_near(rows, 5) if k), key=str)
    assert kept.columns == ["doc_id", "text"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == expect


def test_an_id_on_a_duplicate_and_on_another_text(spark):
    rows = [(0, "a b c d e f"), (1, "a b c d e f"), (1, "nothing like the others at all")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = neardup.drop_near_duplicates(docs).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[2]]


def test_nothing_to_compare(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert neardup.near_duplicates(docs).collect() == []
    docs = spark.createDataFrame([(2, None), (1, "")], "doc_id bigint, text string")
    found = sorted(map(tuple, neardup.near_duplicates(docs).collect()))
    assert found == [(1, 0, 1, True), (2, 0, 2, True)]
    assert neardup.drop_near_duplicates(docs).count() == 2


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(near_rows(6), "doc_id bigint, text string")
    a, b = (
        sorted(map(str, neardup.near_duplicates(docs.repartition(n)).collect())) for n in (2, 9)
    )
    assert a == b


def test_regions_are_cut_deeper():
    rules = neardup.Rules(region=3, near=1, depth=8)
    random.seed(9)
    paths = np.array(sorted([0] * 6 + [random.randint(0, 2) for _ in range(10)] for _ in range(40)), np.uint8)
    pairs = set(neardup.region_pairs(paths, 3, rules))
    assert {(i, i + 1) for i in range(39)} <= pairs
    assert all(i < j for i, j in pairs) and len(pairs) < 40 * 39 / 2


# ---- suffix arrays


@given(st.text(st.sampled_from("ab"), min_size=1, max_size=60) | st.text(st.sampled_from("abcdé"), min_size=1, max_size=60))
def test_suffix_array(text):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    hashes, n = prefix_hashes(data), len(data)
    found = suffixes.suffix_array(data.astype(np.uint16), hashes, 1000)
    expect = sorted(range(n), key=lambda i: raw[i:])
    assert found.tolist() == expect
    for depth in (3, 1000):
        shared = suffixes.common_prefixes(found, data, n - np.arange(n), depth)
        for a, b in zip(expect, expect[1:]):
            k = 0
            while k < min(depth, n - max(a, b)) and raw[a + k] == raw[b + k]:
                k += 1
            assert shared[b] == k
        whole = suffixes.common_prefixes(found, data, n - np.arange(n), depth, hashes)
        assert whole.tolist() == [k if k == depth else 0 for k in shared]


def test_common_prefixes_decide_what_is_equal(monkeypatch):
    """Not the hashes: with the same hash for everything, other strings are still told apart."""
    pieces = [b"0123456789abcdef", b"xx0123456789zz", b"0123456789abcdef"]
    doc, lo = np.array([1, 2, 3]), np.array([0, 5, 7])
    rules = repeats.Rules(length=10, gram=4)
    want = {"ord": [2, 3], "lo": [7, 7], "strings": [1, 7]}
    assert repeats.equal_in_shard(pieces, doc, lo, rules).to_pydict() == want
    monkeypatch.setattr(suffixes, "span_hashes", lambda hashes, a, b: np.zeros(len(a), np.uint64))
    array = np.array(sorted(range(46), key=lambda i: b"".join(pieces)[i:][:10]))
    monkeypatch.setattr(repeats, "suffix_array", lambda *_: array)
    assert repeats.equal_in_shard(pieces, doc, lo, rules).to_pydict() == want


def test_kinds_of_suffixes():
    raw = b"mississippi"
    kind = suffixes.smaller(np.frombuffer(raw, np.uint8))
    assert [raw[i:] < raw[i + 1 :] for i in range(len(raw))] == kind.tolist()
    assert suffixes.leftmost(kind).tolist() == [1, 4, 7]


# ---- repeated strings


def slow_repeats(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = set(), [None] * len(rows)
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            piece = raw[p : p + length]
            if piece in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(piece)
        spans = sum(1 for q in range(len(raw)) if gone[q] and not (q and gone[q - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (rows[i][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeat_rows():
    random.seed(11)
    make = lambda n, letters="abcdefghij ": "".join(random.choice(letters) for _ in range(n))
    shared = [make(30), make(12), "é€😀" * 5, "a" * 40]
    texts = [None, "", "short", "a" * 300, "ab" * 100]
    for _ in range(80):
        texts.append(make(random.randint(0, 40)) + random.choice(shared) + make(random.randint(0, 60)))
    texts += texts[10:14] + [make(5_000, "ab")]
    rows = list(enumerate(texts))
    random.shuffle(rows)
    return rows


#: Places of few bytes are split by longer keys, at last by whole strings.
@pytest.mark.parametrize("place,keys", [(50_000, 3), (40, 2), (40, 0), (0, 1)])
def test_repeats(spark, place, keys, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 64 if place <= 40 else 1 << 20)
    rules = repeats.Rules(length=10, gram=4, shard=300, place=place, keys=keys)
    rows = repeat_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, ord int").repartition(4)
    found = sorted(map(tuple, repeats.summary(docs, rules=rules).collect()))
    assert found == sorted(slow_repeats(rows, 10))


def test_ids_that_are_missing_or_equal(spark):
    rules = repeats.Rules(length=10, gram=4)
    text = "0123456789abcdef"
    docs = spark.createDataFrame(
        [(None, text), (1, text), (1, text), (0, "xx" + text), (2, "nothing like it")],
        "doc_id bigint, text string",
    )
    found = sorted((str(r[0]), r[1], r[2]) for r in map(tuple, repeats.summary(docs, rules=rules).collect()))
    assert found == [("0", 18, 0), ("1", 16, 16), ("1", 16, 16), ("2", 15, 0), ("None", 16, 16)]
    # names as ids: in the order of the names
    names = spark.createDataFrame([("b", text), ("a", text)], "doc_id string, text string")
    assert sorted((r[0], r[2]) for r in repeats.summary(names, rules=rules).collect()) == [("a", 0), ("b", 16)]


def test_texts_without_repeats(spark):
    rules = repeats.Rules(length=10, gram=4)
    docs = spark.createDataFrame(
        [(1, "0123456789é", 5), (2, "xx0123456789", 6), (3, None, 7), (4, "ab0123456789éz", 8)],
        "doc_id bigint, text string, list int",
    )
    found = {r["doc_id"]: (r["text"], r["list"]) for r in repeats.remove_repeats(docs, rules=rules).collect()}
    assert found == {1: ("0123456789é", 5), 2: ("xx", 6), 3: (None, 7), 4: ("abz", 8)}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.summary(empty).collect() == []


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 30), st.integers(1, 6)), max_size=30))
def test_merged_ranges(ranges):
    doc, lo, size = (np.array([r[i] for r in ranges], np.int64) for i in range(3))
    d, a, b = repeats.merged(doc, lo, lo + size)
    cover = defaultdict(set)
    for i, start, n in ranges:
        cover[i].update(range(start, start + n))
    back = defaultdict(set)
    for i, start, end in zip(d.tolist(), a.tolist(), b.tolist()):
        assert start - 1 not in cover[i] and end not in cover[i]
        back[i].update(range(start, end))
    assert back == cover


def test_long_words_that_differ_are_not_linked(spark):
    """Thue-Morse words, for which sums of powers modulo 2**64 are equal."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
