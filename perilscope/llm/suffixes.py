"""Suffix arrays by induced sorting, with numpy.

Suffixes are classified as smaller or larger than the one behind them. The leftmost of each
run of smaller ones are sorted, and all others follow from them in two scans over the buckets
of first symbols. A scan works on a whole bucket at once: what a bucket induces in later
buckets is ready when they are reached, and what it induces in itself comes in waves.
"""

from __future__ import annotations

import numpy as np

from perilscope.llm.words import span_hashes


def smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the end of the text is the smallest."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    kind = np.append(text[change] < text[change + 1], False)
    return np.repeat(kind, np.diff(np.concatenate([[-1], ends])))


def leftmost(kind: np.ndarray) -> np.ndarray:
    return np.flatnonzero(kind[1:] & ~kind[:-1]) + 1


class Buckets:
    """The array under construction, with the first and last free place of each bucket."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, symbols: int):
        self.text, self.kind, self.symbols = text, kind, symbols
        counts = np.bincount(text, minlength=symbols)
        self.end = np.cumsum(counts)
        self.start = self.end - counts
        self.array = np.full(len(text), -1, np.int64)
        self.head, self.tail = self.start.copy(), self.end.copy()

    def append(self, found: np.ndarray, front: bool) -> None:
        """Put suffixes at the front or the back of their buckets, in the order given."""
        order = np.argsort(self.text[found], kind="stable")
        found = found[order]
        symbol = self.text[found]
        counts = np.bincount(symbol, minlength=self.symbols)
        rank = np.arange(len(found)) - (np.cumsum(counts) - counts)[symbol]
        if front:
            self.array[self.head[symbol] + rank] = found
            self.head += counts
        else:
            self.array[self.tail[symbol] - 1 - rank] = found
            self.tail -= counts

    def induce(self, sources: np.ndarray, small: bool) -> None:
        before = sources[sources > 0] - 1
        before = before[self.kind[before] == small]
        if len(before):
            self.append(before, front=not small)

    def sort_from(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes in the order that the leftmost smaller ones, given in order, induce."""
        self.append(seeds[::-1], front=False)
        filled = self.tail.copy()
        # the last suffix stands before the end of the text, which is the smallest of all
        self.append(np.array([len(self.text) - 1]), front=True)
        for c in range(self.symbols):
            at = self.start[c]
            while at < self.head[c]:
                done, at = at, self.head[c]
                self.induce(self.array[done:at], small=False)
            if filled[c] < self.end[c]:
                self.induce(self.array[filled[c] : self.end[c]].copy(), small=False)
        self.tail = self.end.copy()
        for c in range(self.symbols - 1, -1, -1):
            at = self.end[c]
            while self.tail[c] < at:
                done, at = at, self.tail[c]
                self.induce(self.array[at:done][::-1].copy(), small=True)
            if self.start[c] < self.head[c]:
                self.induce(self.array[self.start[c] : self.head[c]][::-1].copy(), small=True)
        return self.array


def ranked(names: np.ndarray, reach: int) -> np.ndarray:
    """The order of the suffixes of a text of names, by their first ``reach`` names at least.

    The alphabet is nearly as large as the text, too large for bucket scans, so ranks of
    prefixes of twice the length are made of pairs of ranks until all differ.
    """
    n, length, rank = len(names), 1, names.astype(np.int64)
    while True:
        following = np.zeros(n, np.int64)
        following[: max(n - length, 0)] = rank[length:] + 1
        order = np.lexsort((following, rank))
        a, b = rank[order], following[order]
        new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank[order] = new
        length *= 2
        if length >= reach or new[-1] == n - 1:
            return order


def suffix_array(text: np.ndarray, hashes: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text``, numbers below 2**16, by their first ``depth`` symbols.

    ``hashes`` are the prefix hashes of the text's bytes, by which substrings are compared.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    alphabet, text = np.unique(text, return_inverse=True)
    text = text.astype(np.uint16)
    kind = smaller(text)
    seeds = leftmost(kind)
    if not len(seeds):
        return Buckets(text, kind, len(alphabet)).sort_from(seeds)
    rough = Buckets(text, kind, len(alphabet)).sort_from(seeds)
    is_seed = np.zeros(n, bool)
    is_seed[seeds] = True
    order = rough[is_seed[rough]]
    # equal substrings between neighbouring seeds get one name
    end = np.full(n, n, np.int64)
    end[seeds[:-1]] = seeds[1:] + 1
    length = end[order] - order
    content = span_hashes(hashes, order, end[order])
    new = (content[1:] != content[:-1]) | (length[1:] != length[:-1])
    names = np.zeros(n, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(new)])
    if not new.all():
        # seeds are two symbols apart at least
        order = seeds[ranked(names[seeds], depth // 2 + 1)]
    return Buckets(text, kind, len(alphabet)).sort_from(order)


#: Bytes of runs that are compared at a time.
COMPARED = 1 << 20


def run_prefixes(
    data: np.ndarray, at: np.ndarray, other: np.ndarray, head: np.ndarray, depth: int
) -> np.ndarray:
    """How many bytes each ``at`` shares with its ``other``, up to ``depth`` at least. Both grow
    by one from each to the next within a run; ``head`` says where runs begin, and the end."""
    runs = head[:-1]
    size = np.diff(head) + depth
    first = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(first, size)
    left, right = np.repeat(at[runs], size) + step, np.repeat(other[runs], size) + step
    last = len(data) - 1
    differ = (np.maximum(left, right) > last) | (
        data[np.minimum(left, last)] != data[np.minimum(right, last)]
    )
    # the end stands for a difference
    places = np.append(np.flatnonzero(differ), len(differ))
    run = np.repeat(np.arange(len(runs)), np.diff(head))
    own = first[run] + np.arange(len(at)) - runs[run]
    return places[np.searchsorted(places, own)] - own


def common_prefixes(
    array: np.ndarray, data: np.ndarray, room: np.ndarray, depth: int, hashes: np.ndarray | None = None
) -> np.ndarray:
    """For each suffix, in the order of the text, how many bytes, up to ``depth``, it shares with
    the one before it in the array, which may leave suffixes out; ``room`` says how far a suffix
    may be read.

    In the order of the text, suffixes that follow each other often stand behind suffixes that
    follow each other as well. The bytes of such a run are compared once, and each of its lengths
    is the way to the next difference: a pass over the permuted suffixes. With ``hashes``, only
    suffixes that share the whole depth count, and those whose hashes differ are left out.
    """
    before = np.full(len(data), -1, np.int64)
    before[array[1:]] = array[:-1]
    out = np.zeros(len(data), np.int64)
    at = np.flatnonzero(before >= 0)
    other = before[at]
    most = np.minimum(np.minimum(room[at], room[other]), depth)
    if hashes is not None:
        some = most >= depth
        at, other, most = at[some], other[some], most[some]
        some = span_hashes(hashes, at, at + depth) == span_hashes(hashes, other, other + depth)
        at, other, most = at[some], other[some], most[some]
    if not len(at):
        return out
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (other[1:] != other[:-1] + 1)
    head = np.append(np.flatnonzero(new), len(at))
    reach = np.cumsum(np.diff(head) + depth)
    done = 0
    while done < len(reach):  # as many runs at a time as may be held
        so_far = reach[done - 1] if done else 0
        end = max(int(np.searchsorted(reach, so_far + COMPARED, "right")), done + 1)
        some = slice(head[done], head[end])
        out[at[some]] = run_prefixes(data, at[some], other[some], head[done : end + 1] - head[done], depth)
        done = end
    out[at] = np.minimum(out[at], most)
    if hashes is not None:
        out[out < depth] = 0
    return out
