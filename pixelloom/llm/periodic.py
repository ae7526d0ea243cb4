"""Maximal runs of words (tandem repeats) by the suffix tree of a text, after Stoye and Gusfield.

The tree of a text is held as arrays: suffixes in order, the longest common prefix of neighbours, and the inner nodes as
the intervals of suffixes whose common prefix is no shorter than the node's depth. A node with more than two children
is taken as a chain of two-sided ones of one depth. For each node of depth q the leaves of its smaller side are gone through:
where the suffix q words on, or q words back, is on the other side, a branching tandem repeat of period q ends
there (its right rotation is none). Rotating it to the left, by whole blocks of words of 2^k that are known to be equal, gives the
maximal run; of repeats that give the same run the one with the smallest period stays. Equal words are equal by their text, not by
a hash.

Texts whose words can hold no long enough run build no tree: a run of n words and period q has n - q - GRAM + 1 places in
a row at which a sequence of GRAM words starts that began at most q words before, too.

A text is the work of one task, as a suffix tree needs it whole; tasks hold many texts, a batch at a time.

Defined results: a null or empty text has no words and no runs; every row is a text of its own, whatever its doc_id; a null doc_id is
kept (and never changed by periodic()); no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pixelloom.llm.common import batches_of, strings

GRAM = 3


class Words(NamedTuple):
    """Words of texts: text (bytes), code (equal for equal words) and the first word of each text, with the number of words at the end."""

    text: pa.Array
    code: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        flat = flat.filter(full)
        return cls(flat, flat.dictionary_encode().indices.to_numpy().astype(np.int64), kept[bounds])

    def take(self, at: np.ndarray, first: np.ndarray) -> Words:
        return Words(self.text.take(pa.array(at)), self.code[at], first)


def places(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def periodic(words: Words, doc_ids: list) -> Words:
    """A tenth of the texts, by the crc32 of their doc_id, with words from some place on repeated periodically."""
    at = np.arange(len(words.code))
    for k, doc in enumerate(doc_ids):
        low, n = words.first[k], words.first[k + 1] - words.first[k]
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[low + a : low + n] = low + a + np.arange(n - a) % p
    return words if (at == np.arange(len(at))).all() else words.take(at, words.first)


def doubtful(words: Words, copies: int, least: int) -> np.ndarray:
    """Of each text, whether it may hold a run: necessary, not sufficient."""
    n, owner = len(words.code), places(words.first)
    found = np.zeros(len(words.first) - 1, bool)
    if n < 2:
        return found
    gram = words.code
    for k in range(1, GRAM):  # a code for each sequence of words within a text
        whole = np.minimum(np.arange(n) + k, n - 1)
        gram = np.unique(gram * (n + 1) + words.code[whole], return_inverse=True)[1]
    key = owner * (n + 1) + gram
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    back = np.full(n, n + 1)
    back[order[same]] = order[np.flatnonzero(same) - 1]
    back[order[same]] = order[same] - back[order[same]]
    size, top = 1, int(np.diff(words.first).max()) // copies
    while size <= top:  # periods from size to 2 * size - 1
        periods = np.arange(size, min(2 * size - 1, top) + 1)
        stretch = (np.maximum(least, copies * periods) - periods).min() - GRAM + 1
        if stretch < 1:
            return np.diff(words.first) > 1
        near = back < 2 * size
        edge = np.flatnonzero(np.concatenate([[True], (near[1:] != near[:-1]) | (owner[1:] != owner[:-1]), [True]]))
        long = near[edge[:-1]] & (np.diff(edge) >= stretch)
        found[owner[edge[:-1][long]]] = True
        size *= 2
    return found


class Tree:
    """Suffixes of texts, in order by text and words; texts share no word."""

    def __init__(self, code: np.ndarray):
        n = self.n = len(code)
        self.ranks: list[np.ndarray] = []  # of the sequences of 2^k words from each place; equal for equal ones
        order = np.argsort(code, kind="stable")
        head = np.concatenate([[True], code[order][1:] != code[order][:-1]])
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.ranks.append(rank)
        step, alone = 1, head & np.concatenate([head[1:], [True]])
        open_ = order[~alone]
        while len(open_):
            on = open_ + step
            after = np.where(on < n, rank[np.minimum(on, n - 1)].astype(np.int64) + 1, 0)
            key = rank[open_].astype(np.int64) * (n + 1) + after
            by = np.argsort(key, kind="stable")
            open_, key = open_[by], key[by]
            group = np.concatenate([[True], key[1:] // (n + 1) != key[:-1] // (n + 1)])
            head = np.concatenate([[True], key[1:] != key[:-1]])
            at = np.arange(len(key))
            begin = np.maximum.accumulate(np.where(group, at, 0))
            mine = np.maximum.accumulate(np.where(head, at, 0))
            rank = rank.copy()
            rank[open_] = (key // (n + 1)) + (mine - begin)
            alone = head & np.concatenate([head[1:], [True]])
            open_ = open_[~alone]
            self.ranks.append(rank)
            step *= 2
        self.rank = rank  # each suffix's own
        self.order = np.empty(n, np.int32)
        self.order[rank] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words from a and b on; a <> b."""
        far = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = a + far, b + far
            inside = np.maximum(x, y) < self.n
            same = inside & (self.ranks[k][np.minimum(x, self.n - 1)] == self.ranks[k][np.minimum(y, self.n - 1)])
            far[same] += 1 << k
        return far

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words before a and b, a < b."""
        far, going = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(len(self.ranks) - 1, -1, -1):
            some = going
            while len(some):  # the longest blocks may follow one another
                x, y = a[some] - far[some] - (1 << k), b[some] - far[some] - (1 << k)
                some = some[(x >= 0) & (self.ranks[k][np.maximum(x, 0)] == self.ranks[k][np.maximum(y, 0)])]
                far[some] += 1 << k
        return far

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two-sided inner nodes: depth, and the suffixes' places from low to middle and from middle to high."""
        common = np.zeros(self.n + 1, np.int64)
        common[1:-1] = self.forward(self.order[:-1].astype(np.int64), self.order[1:].astype(np.int64))
        middle = np.flatnonzero(common)
        low, high = np.arange(self.n + 1) - 1, np.arange(self.n + 1) + 1
        low[0], high[-1] = 0, self.n
        low = jumped(low, common, middle, lambda c, own: c >= own)
        high = jumped(high, common, middle, lambda c, own: c > own)
        return common[middle], low[middle], middle, high[middle]


def jumped(to: np.ndarray, common: np.ndarray, some: np.ndarray, over) -> np.ndarray:
    """Pointers to the next place, on one side, that the test doesn't pass over; all jump at once, on the way that those they reach have gone."""
    while len(some):
        some = some[over(common[to[some]], common[some])]
        to[some] = to[to[some]]
    return to


def runs(words: Words, copies: int = 4, least: int = 6, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (words of all texts, end exclusive) and smallest period of each maximal run of at least max(least, copies * period) words, in order."""
    none = np.zeros(0, np.int64)
    some = np.flatnonzero(doubtful(words, copies, least))
    sizes = words.first[some + 1] - words.first[some]
    if not len(some):
        return none, none, none
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(words.first[some] - begin, sizes) + np.arange(sizes.sum())
    tree = Tree(np.repeat(np.arange(len(some)), sizes) * (len(words.code) + 1) + words.code[at])
    depth, low, middle, high = tree.nodes()
    left = middle - low <= high - middle
    from_, to = np.where(left, low, middle), np.where(left, middle, high)
    other, until = np.where(left, middle, low), np.where(left, high, middle)
    found = [(none, none)]
    upto = np.cumsum(to - from_)
    cuts = np.unique([0, *np.searchsorted(upto, np.arange(most, upto[-1] if len(upto) else 0, most)), len(depth)])
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):  # leaves of the smaller sides, about so many at once
        count = (to - from_)[x:y]
        node = np.repeat(np.arange(x, y), count)
        leaf = tree.order[from_[node] + np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)].astype(np.int64)
        for first in (leaf, leaf - depth[node]):  # of the two copies' beginnings
            second = first + depth[node]
            seen = second if first is leaf else first
            inside = (seen >= 0) & (seen < tree.n)
            there = tree.rank[np.clip(seen, 0, tree.n - 1)]
            hit = inside & (there >= other[node]) & (there < until[node])
            found.append((first[hit], depth[node[hit]]))
    start, period = (np.concatenate(v) for v in zip(*found, strict=True))
    end = start + 2 * period
    start = start - tree.backward(start, start + period)
    good = end - start >= np.maximum(least, copies * period)
    start, end, period = start[good], end[good], period[good]
    by = np.lexsort([period, end, start])
    start, end, period = start[by], end[by], period[by]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort([period, start])
    return at[start[by]], at[end[by] - 1] + 1, period[by]


RUNS = "array<struct<start:long,length:long,period:long>>"


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def found_in(docs: DataFrame, change=None, copies: int = 4, least: int = 6) -> DataFrame:
    """Of each row of docs: doc_id, runs (start, length, period, by start) and collapsed (the words joined by one blank, without those that lie in a run after its first period). change: what is done to a batch's words and doc_ids first."""
    return docs.select("doc_id", "text").mapInArrow(kernel(change, copies, least, False), f"doc_id long, runs {RUNS}, collapsed string")


REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame, change=periodic, copies: int = 4, least: int = 6) -> DataFrame:
    """REPORT: of each row the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    return docs.select("doc_id", "text").mapInArrow(kernel(change, copies, least, True), REPORT)


def kernel(change, copies: int, least: int, digests: bool):
    def run(batches):
        for batch in batches_of(batches):
            words = Words.of(strings(batch))
            if change:
                words = change(words, batch.column(0).to_pylist())
            start, end, period = runs(words, copies, least)
            bounds = np.searchsorted(start, words.first)
            edges = np.zeros(len(words.code) + 1, np.int64)
            np.add.at(edges, start + period, 1)
            np.add.at(edges, end, -1)
            kept = np.cumsum(edges)[:-1] == 0
            first = np.concatenate([[0], np.cumsum(kept)])[words.first]
            text = words.text if kept.all() else words.text.filter(pa.array(kept))
            lists = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), text)
            joined = pc.binary_join(lists, pa.scalar(" ", text.type))
            own = start - np.repeat(words.first[:-1], np.diff(bounds))
            rows = [list(zip(own[x:y].tolist(), (end - start)[x:y].tolist(), period[x:y].tolist(), strict=True)) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            if digests:
                yield summary(batch.column(0), rows, joined)
            else:
                named = [[{"start": a, "length": b, "period": c} for a, b, c in r] for r in rows]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.record_batch([batch.column(0), pa.array(named, kind), joined.cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return run


def summary(doc_ids: pa.Array, rows: list[list[tuple[int, int, int]]], collapsed: pa.Array) -> pa.RecordBatch:
    longest = [max(r, key=lambda v: (v[1], -v[0], -v[2])) if r else None for r in rows]
    columns = [[v and v[k] for v in longest] for k in range(3)]
    power = [v and 1000 * v[1] // v[2] for v in longest]
    of_runs = [digest("".join(f"{a},{b},{c}\n" for a, b, c in r).encode()) for r in rows]
    of_words = [digest(v.as_buffer()) for v in collapsed]
    data = [doc_ids, pa.array([len(r) for r in rows], pa.int64()), *(pa.array(c, pa.int64()) for c in (*columns, power)), pa.array(of_runs), pa.array(of_words)]
    return pa.record_batch(data, names=[c.split()[0] for c in REPORT.split(", ")])
