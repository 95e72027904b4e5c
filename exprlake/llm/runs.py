"""Periodic runs of words in whole texts, by Kruskal's rounds over suffix classes in descending order of their common prefix.

The suffixes of a text that share a prefix of l words form a class; as l falls, classes unite. Neighbours of the suffix
array are the edges, their common prefix (LCP) is the weight, and union-find joins the classes, each of which keeps its
positions in order, the smaller set going into the larger. Where a union makes two positions i < j neighbours, their common
prefix is exactly the level l; a distance j - i of at most l is a square, so both positions seed a run of period
j - i that ends at j + l. Positions between them would have a shorter period, so a seed's period is the smallest one, and
a seed that cannot be extended to the left is a run: each run is found once, and no run is missed.

A run of at least `least` words has an LCP of half of that, so only positions whose first least / 2 words stand twice in the
text need to be sorted; the others are left out by a hash, and the remaining ones are ordered by prefix doubling, for many texts
at once. Every text is worked on by itself in the task that reads it: nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exprlake.llm.common import text_rows

#: Words that are sorted together at most, unless one text is longer; positions of an ordered list that is kept in one piece.
PART_WORDS, PIECE = 400_000, 2_048
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Neither a position nor a neighbour.
NONE = 1 << 62


class Positions:
    """An ordered set of positions in pieces, so that an insertion moves few of them."""

    def __init__(self, items: list[int]):
        self.pieces = [items[k : k + PIECE] for k in range(0, len(items), PIECE)]
        self.first = [piece[0] for piece in self.pieces]
        self.size = len(items)

    def __len__(self) -> int:
        return self.size

    def __iter__(self):
        for piece in self.pieces:
            yield from piece

    def put(self, x: int) -> tuple[int, int]:
        """Add x; its neighbours before and after."""
        at = max(0, bisect_right(self.first, x) - 1)
        piece = self.pieces[at]
        k = bisect_left(piece, x)
        before = piece[k - 1] if k else (self.pieces[at - 1][-1] if at else -NONE)
        after = piece[k] if k < len(piece) else (self.first[at + 1] if at + 1 < len(self.first) else NONE)
        piece.insert(k, x)
        self.first[at] = piece[0]
        self.size += 1
        if len(piece) > 2 * PIECE:
            self.pieces[at : at + 1] = [piece[:PIECE], piece[PIECE:]]
            self.first[at : at + 1] = [piece[0], piece[PIECE]]
        return before, after


def _repeated(words: np.ndarray, doc: np.ndarray, starts: np.ndarray, gram: int) -> np.ndarray:
    """Those of starts whose first gram words may stand twice in their text, by a hash; none that do is left out."""
    odd = np.random.default_rng(13).integers(1, 1 << 62, gram + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = doc.astype(np.uint64)[starts] * odd[gram]
    w = words.astype(np.uint64)
    w = (w + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    w ^= w >> np.uint64(29)
    for j in range(gram):
        h += w[starts + j] * odd[j]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return np.sort(starts[order[np.r_[same, False] | np.r_[False, same]]])


def _suffixes(words: np.ndarray, doc: np.ndarray, starts: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, and each one's LCP with the next (0 where it is below gram), for the starts that share gram words."""
    known = np.unique(np.concatenate([starts, starts + gram]))  # what a prefix doubled looks at
    index = np.full(len(words) + gram + 1, -1, np.int32)
    index[known] = np.arange(len(known), dtype=np.int32)
    keys = [words[np.minimum(known + j, len(words) - 1)] for j in range(gram)] + [doc[np.minimum(known, len(words) - 1)]]
    order = np.lexsort(keys[gram - 1 :: -1] + [keys[gram]])
    new = np.r_[True, np.any([np.diff(k[order]) != 0 for k in keys], axis=0)]
    rank = np.empty(len(known), np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    ranks, k = [rank], gram
    open_ = index[starts]
    while True:
        tally = np.bincount(rank[open_], minlength=1)
        open_ = open_[tally[rank[open_]] > 1]
        if not len(open_):
            break
        after = rank[index[known[open_] + k]]
        order = np.lexsort((after, rank[open_]))
        open_, after, old = open_[order], after[order], rank[open_][order]
        group = np.r_[True, np.diff(old) != 0]
        part = group | np.r_[True, np.diff(after) != 0]
        at = np.arange(len(open_))
        rank = rank.copy()
        rank[open_] = old + at[part][np.cumsum(part) - 1] - at[group][np.cumsum(group) - 1]
        ranks.append(rank)
        k *= 2
    sa = starts[np.argsort(rank[index[starts]], kind="stable")]
    i, j = sa[:-1], sa[1:]
    lcp = np.zeros(len(i), np.int64)
    for level in reversed(range(len(ranks))):
        a, b = index[i + lcp], index[j + lcp]
        lcp += ((a >= 0) & (b >= 0) & (ranks[level][a] == ranks[level][b])) * (gram << level)
    go = lcp >= gram
    for _ in range(gram - 1):
        go &= words[np.minimum(i + lcp, len(words) - 1)] == words[np.minimum(j + lcp, len(words) - 1)]
        lcp += go
    return sa, np.where(lcp >= gram, lcp, 0)


def find_runs(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least least words.

    words holds the word numbers, from 1 on, of one text after the other with a 0 after each text, doc the number of each word's text."""
    gram = max(1, -(-least // 2))
    place = np.arange(max(0, len(words) - gram))
    starts = place[(doc[place] == doc[place + gram]) & (words[place] > 0)]  # all gram words are of one text
    starts = _repeated(words, doc, starts, gram) if len(starts) else starts
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    sa, lcp = _suffixes(words, doc, starts, gram)
    edges = np.argsort(-lcp, kind="stable")
    edges = edges[: int((lcp > 0).sum())]
    parent = list(range(len(sa)))
    sets: list = [[x] for x in sa.tolist()]
    found = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, l in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = root(k), root(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        parent[b] = a
        large, small = sets[a], sets[b]
        sets[b] = None
        if isinstance(large, list) and len(large) + len(small) > 2 * PIECE:
            large = sets[a] = Positions(large)
        if isinstance(large, list):
            last, small = -1, [*small, NONE]
            for m in range(len(small) - 1):
                x = small[m]
                at = bisect_left(large, x)
                if at and large[at - 1] != last and x - large[at - 1] <= l:
                    found.append((large[at - 1], x, l))
                if at < len(large) and large[at] - x <= l and small[m + 1] > large[at]:
                    found.append((x, large[at], l))
                large.insert(at, x)
                last = x
        else:
            last, small = -1, [*small, NONE]
            for m in range(len(small) - 1):
                x = small[m]
                before, after = large.put(x)
                if before != last and x - before <= l:
                    found.append((before, x, l))
                if after - x <= l and small[m + 1] > after:
                    found.append((x, after, l))
                last = x
    if not found:
        return np.zeros((0, 3), np.int64)
    i, j, l = np.array(found, np.int64).T
    first = (i == 0) | (words[i - 1] != words[j - 1]) | (doc[np.maximum(i - 1, 0)] != doc[i])
    runs = np.stack([i, j - i + l, j - i], axis=1)[first & (j - i + l >= least)]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _parts(sizes: list[int]) -> list[tuple[int, int]]:
    """Ranges of texts of about PART_WORDS words together."""
    out, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if total and total + n > PART_WORDS:
            out.append((start, k))
            start, total = k, 0
        total += n
    return [*out, (start, len(sizes))]


def _of_texts(texts: list[bytes], least: int):
    """For every text its number of words, its runs, and its words without repeats joined by one space."""
    split = [t.split() for t in texts]  # at ASCII white space only
    sizes = [len(w) for w in split]
    for low, high in _parts(sizes):
        number = defaultdict(count(1).__next__)
        n = np.array(sizes[low:high], np.int64)
        offset = np.r_[0, np.cumsum(n + 1)]
        words = np.zeros(int(offset[-1]), np.int64)
        for k in range(low, high):
            if sizes[k]:
                words[offset[k - low] : offset[k - low] + sizes[k]] = np.fromiter(map(number.__getitem__, split[k]), np.int64, sizes[k])
        doc = np.repeat(np.arange(high - low), n + 1)
        runs = find_runs(words, doc, least)
        of = doc[runs[:, 0]]
        bounds = np.searchsorted(of, np.arange(high - low + 1))
        for k in range(low, high):
            mine, w = runs[bounds[k - low] : bounds[k - low + 1]] - [offset[k - low], 0, 0], split[k]
            if len(mine):
                step = np.zeros(sizes[k] + 1, np.int64)
                np.add.at(step, mine[:, 0] + mine[:, 2], 1)
                np.add.at(step, mine[:, 0] + mine[:, 1], -1)
                w = compress(w, (np.cumsum(step)[:-1] == 0).tolist())
            yield sizes[k], mine, b" ".join(w)
            split[k] = None


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """Per row: key, n_words, runs (start, length, period, by start and period), collapsed (the text without repeats).

    Words stand between ASCII white space. A run is a stretch of at least `least` words and of two periods whose words are equal to those a
    period before, that no neighbouring word extends; period is its smallest one. Collapsed drops each word that a run contains after the
    run's first period, and joins the others by one space. A null or empty text has no words and an empty collapsed
    text; so has a text of white space. Repeated rows and rows with a null key have a result each. Texts are worked on whole; time and memory
    grow with a text's words times their logarithm, also where all words are equal. Only two columns are read, so
    other columns never clash. An empty table gives no rows.
    """
    rows = text_rows(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text")))

    def find(batches):
        for batch in batches:
            done = list(_of_texts(batch.column(1).to_pylist(), least))
            if done:
                runs = np.concatenate([r for _, r, _ in done])
                items = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], fields=list(RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for _, r, _ in done])].astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _, _ in done], pa.int64()), lists, pa.array([t for _, _, t in done], pa.binary())], ["key", "n_words", "runs", "collapsed"])

    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(find, f"key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
