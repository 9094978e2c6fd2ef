"""SimHash fingerprints and BK-trees against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from perilscope.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, rows int, component string"


def plain(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference(rows, radius=4):
    fps = [plain(r[1]) for r in rows]
    component = list(range(len(rows)))

    def top(i):
        while component[i] != i:
            i = component[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                component[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted([(r[0], f"{f:016x}", least.get(top(i))) for i, (r, f) in enumerate(zip(rows, fps))], key=str)


def documents(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 200))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i * 3 % (2 * n), " ".join(words)))
    return out


def result(spark, rows, rules=simhash.Rules()):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    return sorted([tuple(r) for r in simhash.near_duplicates(df, rules=rules).collect()], key=str)


#: Pieces of few classes: large shards are cut, and trees of the pieces meet all others.
@pytest.mark.parametrize("rules", [simhash.Rules(), simhash.Rules(piece=8, visits=50), simhash.Rules(expected=1)])
def test_components(spark, rules):
    rows = documents(260, 1)
    rows += [(5000 + i, rows[0][1].upper()) for i in range(90)]
    rows += [(None, rows[3][1]), (None, "alone in the world"), (6000, None), (6001, ""), (6002, " \t\n")]
    rows += [(6003, "one two"), (6004, "one two"), (6004, "one two"), (6005, "É\x1f\x85 x É\x1f\x85 x É"), (6006, "a " * 30_000)]
    got = result(spark, rows, rules)
    assert got == reference(rows)
    assert len({r[2] for r in got}) > 20


def test_empty(spark):
    assert result(spark, []) == []
    assert result(spark, [(4, None)]) == [(4, "0" * 16, 4)]


def test_parts_of_a_long_text_give_the_same_fingerprint():
    text = " ".join(f"Word{i * i % 97} \x0b" for i in range(3000))
    for size in (1, 7, 100, 10_000):
        assert simhash.fingerprint(text, simhash.Rules(text=size)) == plain(text)


def test_any_number_of_blocks_has_one_that_agrees():
    rng = random.Random(2)
    for count in (10, 10**8, 10**11, 10**14):
        masks = simhash.block_masks(count, simhash.Rules())
        for _ in range(300):
            other = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(other & (m % (1 << 64)) == 0 for m in masks)


def test_trees_are_those_of_one_insertion_after_the_other():
    rng = np.random.default_rng(5)
    first = np.array([0, 1, 40, 41, 300])
    fps = np.unique(rng.integers(0, 2**12, 400, dtype=np.uint64))[:300]
    assert len(fps) == 300
    parent, edge = simhash.grown(fps, first)
    for lo, hi in zip(first[:-1], first[1:]):
        children = {}
        for i in range(lo, hi):
            at = lo
            while i > lo:
                apart = (int(fps[i]) ^ int(fps[at])).bit_count()
                if (at, apart) not in children:
                    children[at, apart] = i
                    assert (parent[i], edge[i]) == (at, apart)
                    break
                at = children[at, apart]
        assert parent[lo] == -1


def test_searches_go_down_few_edges():
    """All links are found, and most of a tree is not looked at where distances differ."""
    rng = np.random.default_rng(6)
    fps = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    parent, edge = simhash.grown(fps, np.array([0, len(fps)]))
    queries = fps[::50] ^ np.uint64(0b1011)
    hits = list(simhash.found_links(queries, np.zeros(len(queries), np.int64), fps, parent, edge, simhash.Rules(visits=64)))
    got = sorted(zip(np.concatenate([h[0] for h in hits]).tolist(), np.concatenate([h[1] for h in hits]).tolist()))
    apart = np.bitwise_count(queries[:, None] ^ fps[None, :])
    assert got == sorted(zip(*(x.tolist() for x in np.nonzero(apart <= 4))))
