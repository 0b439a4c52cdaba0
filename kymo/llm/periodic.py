"""Periodic runs: stretches of words that repeat with one period, found in a suffix tree.

A block of whole texts becomes one sequence of word numbers in which no word of one text equals a word of another. Doubling gives
every stretch of 2^k words a name (equal names, equal words), and with them the order of all suffixes and the depth that neighbours
share. The suffix tree is that order's tree of intervals: a node is a range of suffixes, its children are ranges within. At each node
of depth D all leaves but those of its largest child are visited (so a leaf is visited at most log n times): leaf i is the
first or second half of a branching tandem repeat if the suffix D words on, or D words back, lies below the same node and the words
that follow the halves differ. Each such repeat is the last of its run. Rotating it to the left while it stays a repeat (the
number of rotations is found by halving, a stretch being compared by two names) gives the run's start; runs of one stretch are
merged into the one of the smallest period, which is the stretch's smallest period.

Blocks hold a bounded number of bytes, or one longer text; a task holds one block at a time. No shuffle: a text's runs need that text only.

Defined cases: a null or empty text has no words and no runs; repeated rows are searched each; a table without rows gives none; words are
runs of anything but ASCII white space and compared byte by byte; columns of the input stay as they are, inside the column row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import claim

#: A run has at least so many words and at least so many times its period.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that are searched at once, unless one text is longer; visits of leaves that are checked at once.
BLOCK_BYTES, VISITS = 1_000_000, 1_000_000

FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, and where each text's words begin (one entry more than texts)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = parts.flatten()
    there = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return words.filter(there), before[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


class SuffixTree:
    """The suffix tree of several sequences: names of stretches, suffix order, and inner nodes as ranges of it."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        """symbols: non-negative numbers; starts: where each sequence begins, and the end."""
        n = self.n = len(symbols)
        self.first = np.repeat(starts[:-1], np.diff(starts))  # of each position: where its sequence begins
        end = np.repeat(starts[1:], np.diff(starts))
        key = self.first * (int(symbols.max(initial=0)) + 1) + symbols
        rank = np.full(n + 1, -1, dtype=np.int64)
        active = np.argsort(key, kind="stable")
        ordered = key[active]
        new = np.ones(n, dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank[active] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        names, step = [rank.astype(np.int32)], 1
        active = active[~(new & np.append(new[1:], True))]
        while len(active):
            at = active + step
            follow = np.where(at < end[active], rank[np.minimum(at, n)] + 1, 0)
            own = rank[active]
            key = own * (n + 2) + follow
            order = np.argsort(key, kind="stable")
            active, own, key = active[order], own[order], key[order]
            m = np.arange(len(active))
            new_group, new = np.ones(len(m), dtype=bool), np.ones(len(m), dtype=bool)
            new_group[1:] = own[1:] != own[:-1]
            new[1:] = key[1:] != key[:-1]
            group_at = np.maximum.accumulate(np.where(new_group, m, 0))
            rank[active] = own + np.maximum.accumulate(np.where(new, m, 0)) - group_at
            names.append(rank.astype(np.int32))
            active = active[~(new & np.append(new[1:], True))]
            step *= 2
        self.names = names
        self.rank = rank[:n]
        self.order = np.empty(n, dtype=np.int64)
        self.order[self.rank] = np.arange(n)
        self.depth = self._shared()

    def _shared(self) -> np.ndarray:
        """Of each suffix in order: how many words it shares with the one before."""
        depth = np.zeros(self.n, dtype=np.int64)
        near = 1 + np.flatnonzero(self.names[0][self.order[1:]] == self.names[0][self.order[:-1]])
        i, j, total = self.order[near - 1], self.order[near], np.zeros(len(near), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            same = np.where(self.names[k][i] == self.names[k][j], 1 << k, 0)
            i, j, total = i + same, j + same, total + same
        depth[near] = total
        return depth

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of so many words (one at least) at a and b are equal."""
        k = np.frexp(length.astype(np.float64))[1] - 1  # floor(log2(length))
        out = k < len(self.names)
        for level in np.unique(k[out]):
            at = np.flatnonzero(k == level)
            name, last = self.names[level], length[at] - (1 << int(level))
            out[at] = (name[a[at]] == name[b[at]]) & (name[a[at] + last] == name[b[at] + last])
        return out

    def nodes(self) -> np.ndarray:
        """Inner nodes below the root as rows (depth, first, last, first and last of the largest child)."""
        out: list[tuple[int, int, int, int, int]] = []
        open_nodes: list[list[int]] = []  # depth, first, largest child's first and last
        for r, shared in enumerate(np.append(self.depth[1:], 0).tolist()):
            first = r
            while open_nodes and open_nodes[-1][0] > shared:
                depth, low, big, big_end = open_nodes.pop()
                if r - first > big_end - big:
                    big, big_end = first, r
                out.append((depth, low, r, big, big_end))
                first = low
            if shared:
                if open_nodes and open_nodes[-1][0] == shared:
                    top = open_nodes[-1]
                    if r - first > top[3] - top[2]:
                        top[2:] = first, r
                else:
                    open_nodes.append([shared, first, first, r])
        return np.array(out, dtype=np.int64).reshape(-1, 5)

    def _visits(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Nodes' leaves outside of their largest child: leaf, depth, and the node's first and last, in pieces."""
        depth, low, high, big, big_end = self.nodes().T
        at = np.concatenate([low, big_end + 1])
        size = np.concatenate([big - low, high - big_end])
        node = np.tile(np.arange(len(depth)), 2)[size > 0]
        at, size = at[size > 0], size[size > 0]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        for begin in range(0, total, VISITS):
            visit = np.arange(begin, min(begin + VISITS, total))
            part = np.searchsorted(ends, visit, side="right")
            leaf = self.order[at[part] + visit - (ends[part] - size[part])]
            yield leaf, depth[node[part]], low[node[part]], high[node[part]]

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and half length of each tandem repeat whose two halves are followed by different words, each once."""
        n, word, starts, halves = self.n, self.names[0], [], []
        for leaf, depth, low, high in self._visits():
            on = leaf + depth
            there = np.flatnonzero(on < n)
            place = self.rank[on[there]]
            there = there[(low[there] <= place) & (place <= high[there])]
            there = there[word[on[there]] != word[on[there] + depth[there]]]
            starts.append(leaf[there])
            halves.append(depth[there])
            back = leaf - depth
            there = np.flatnonzero(back >= 0)
            place = self.rank[back[there]]
            there = there[(low[there] <= place) & (place <= high[there])]
            there = there[word[leaf[there]] != word[on[there]]]
            starts.append(back[there])
            halves.append(depth[there])
        if not starts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        start, half = np.concatenate(starts), np.concatenate(halves)
        key = np.unique(start * (n + 1) + half)
        return key // (n + 1), key % (n + 1)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and smallest period of each maximal run of two periods or more, in the order of start and period."""
        last, half = self.branching_repeats()
        low, high = self.first[last] if len(last) else last, last.copy()  # the run's start lies between them
        while len(go := np.flatnonzero(low < high)):
            middle = (low[go] + high[go]) // 2
            fits = self.equal(middle, middle + half[go], last[go] + half[go] - middle)
            high[go[fits]] = middle[fits]
            low[go[~fits]] = middle[~fits] + 1
        end = last + 2 * half
        order = np.lexsort((half, end, high))
        start, end, half = high[order], end[order], half[order]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, half = start[new], end[new], half[new]
        order = np.lexsort((half, start))
        return start[order], end[order], half[order]


def _searched(texts: pa.Array, least_words: int, least_periods: int) -> pa.StructArray:
    words, starts = split_words(texts)
    n = len(words)
    start = end = period = np.zeros(0, dtype=np.int64)
    if n:
        start, end, period = SuffixTree(words.dictionary_encode().indices.to_numpy().astype(np.int64), starts).runs()
        long = end - start >= np.maximum(least_words, least_periods * period)
        start, end, period = start[long], end[long], period[long]
    owner = np.searchsorted(starts, start, side="right") - 1
    dropped = np.zeros(n + 1, dtype=np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    stays = np.cumsum(dropped[:n]) == 0
    kept = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(stays)])[starts].astype(np.int32), words.filter(pa.array(stays)))
    found = pa.StructArray.from_arrays([pa.array(x) for x in (start - starts[owner], end - start, period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(len(starts))).astype(np.int32), found)
    return pa.StructArray.from_arrays([pa.array(np.diff(starts)), lists, pc.binary_join(kept, " ")], ["n_words", "runs", "collapsed"])


def periodic(text: Column | str, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> Column:
    """A struct FOUND of each text: its words, its runs by start and period, and the text without the words after each run's first period."""
    if least_periods < 2:
        raise ValueError("a run has at least two periods")

    def run(texts: pa.Array) -> pa.Array:
        claim("periodic")
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        out, begin = [], 0
        while begin < len(texts):
            before = int(size[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(size, before + BLOCK_BYTES, side="right")))
            out.append(_searched(texts.slice(begin, stop - begin), least_words, least_periods))
            begin = stop
        return pa.concat_arrays(out) if out else _searched(texts, least_words, least_periods)

    return F.arrow_udf(run, FOUND)(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def with_runs(docs: DataFrame, text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Each row, as the struct row, with the struct found of its text, see periodic."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), periodic(F.col(text_col), least_words, least_periods).alias("found"))


def foremost(runs: Column) -> Column:
    """Of runs in the order of start and period the first of those with the greatest length over period, compared exactly; null if there is none."""
    longer = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, x: F.when(longer(best, x), x).otherwise(best))
