"""N-gram Jaccard self-join by PartEnum signatures.

A document's set holds the 64-bit hashes of its distinct word shingles. Sets fall into size bands so that two sets of
similarity g have sizes in one band or in neighbouring ones; a band's pair threshold becomes a Hamming bound k. The
feature domain is cut into n1 parts of n2 sub-parts, and each subset of n2 - k2 sub-parts of a part gives one signature
of the set's projection on it. If k < n1 * (k2 + 1), two sets within k differ in at most k2 sub-parts of some part and
share a signature. An empty projection says nothing and is not emitted: a set whose non-empty sub-parts would allow
k differences to hide all of them ("thin") emits a further family under another cut of the domain, which any thin partner
emits too. No pair within the threshold is lost.

Groups are never expanded into all pairs. Equal sets are one class by fingerprint. Per signature, each further class is
compared with one pivot; classes that this connects need no further comparison. Where classes of different components
still share a signature, small groups list their pairs, and large ones are compared in blocks of bounded size that
return edges of local components only. Every candidate is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import components, release, stage, text_rows

#: Characters of text hashed as one unit, and words of a very long text hashed at a time.
UNIT_CHARS, LONG_WORDS = 1_000_000, 100_000
#: Documents of the sample that finds common shingles, times that one occurs there, and bits of the table of them.
COMMON_SAMPLE, COMMON_TIMES, COMMON_BITS = 10_000, 6, 1 << 22
#: Bits of the filter over the classes to compare: its size is fixed, a fuller one only lets more sets through.
BLOOM_BITS = 1 << 25
#: Bits of the table of rows that may go: of fixed size too, so at most 2 ** 19 words of 64 bits; a fuller one only sends more rows to the exact test.
GONE_BITS = 25
#: Cuts of the feature domain before thin sets share one signature.
SEEDS = 8
#: Classes of one signature up to which pairs are listed; classes and shingles to a block of a larger group; shingles multiplied at a time.
SMALL_GROUP, BLOCK, BLOCK_SHINGLES, COLUMNS = 32, 512, 2_000_000, 16_384

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Random values of the bytes and an odd base: the hash of a byte range is the sum of value * base ** place, mixed.
_BYTE = _mix(np.arange(256, dtype=_U) + _U(0xA0761D6478BD642F))
_BASE = 0x9FB21C651E98DF25
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, for n places at least."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, _U)
            factors[0] = 1
            out.append(np.multiply.accumulate(factors))
        _tables[:] = out
    return _tables[0], _tables[1]


def _ranges(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of all runs of n words, one blank between words."""
    joined = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _powers(len(joined))
    total = np.empty(len(joined) + 1, _U)
    total[0] = 0
    np.cumsum(_BYTE[joined] * up[: len(joined)], out=total[1:])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    m = len(words) - n + 1
    return _mix((total[ends[n - 1 :]] - total[starts[:m]]) * down[starts[:m]])


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; fewer words count as one shingle, no words as none.

    Words are runs of anything but ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    n = min(n, len(words))
    if len(words) <= LONG_WORDS:
        h = _ranges(words, n)
    else:
        h = np.concatenate([_ranges(words[i : i + LONG_WORDS + n - 1], n) for i in range(0, len(words) - n + 1, LONG_WORDS)])
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    with np.errstate(over="ignore"):
        a, b = _mix(h ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U), _mix(h ^ _U(0x14057B7EF767814F)).sum(dtype=_U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


@lru_cache(maxsize=8)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First sizes of the size bands, and each band's Hamming bound for a pair whose smaller set lies in it."""
    low, first, bound = 1, [], []
    while low < 1 << 40:
        high = low * 100 // percent
        first.append(low)
        bound.append((high + high * 100 // percent) * (100 - percent) // (100 + percent))
        low = high + 1
    return np.array(first), np.array(bound)


@lru_cache(maxsize=4096)
def cut(k: int) -> tuple[int, int, int]:
    """n1, n2, k2 for Hamming bound k, with n1 * (k2 + 1) > k."""
    if k <= 3:
        return 1, k + 2, k
    if k <= 8:
        return (k + 3) // 2, 3, 1
    return (k + 2 + max(2, -(-(k + 1) // 12))) // 2, 2, 1


@lru_cache(maxsize=64)
def _subsets(n2: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n2), size)))


def _name(band, seed: int, slot: np.ndarray) -> np.ndarray:
    return _mix(slot.astype(_U) + (np.asarray(band * 16 + seed, dtype=_U) << _U(40)))


def _family(h: np.ndarray, band: int, k: int, seed: int) -> tuple[np.ndarray, bool]:
    """The signatures of one cut of the domain for one set and band, and whether the set is thin there."""
    n1, n2, k2 = cut(k)
    subsets = _subsets(n2, n2 - k2)
    place = ((_mix(h ^ _U(0xD6E8FEB86659FD93 + seed)) >> _U(32)) * _U(n1 * n2) >> _U(32)).astype(np.int64)
    sums = np.zeros(n1 * n2, _U)
    np.add.at(sums, place, h)
    full = (np.bincount(place, minlength=n1 * n2) > 0).reshape(n1, n2)
    some = full[:, subsets].any(axis=2)
    total = sums.reshape(n1, n2)[:, subsets].sum(axis=2, dtype=_U)
    slot = np.arange(total.size).reshape(total.shape)
    return _mix(total ^ _name(band, seed, slot))[some], bool(np.minimum(full.sum(axis=1), k2 + 1).sum() <= k)


def signatures(sets: list[np.ndarray], percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of every set, and the set's position for each.

    The first cut leaves out the features that the table common marks, as two sets differ at most as much on the others; thin
    sets go on with further cuts of all features."""
    first, bound = bands(percent)
    sizes = np.array([len(h) for h in sets])
    own = np.searchsorted(first, sizes, side="right") - 1
    sig, owner = [], []
    rare = [h[~common[(h >> _U(64 - 22)).astype(np.int64)]] for h in sets]
    flat = np.concatenate(rare)
    of = np.repeat(np.arange(len(sets)), [len(h) for h in rare])
    spot = _mix(flat ^ _U(0xD6E8FEB86659FD93)) >> _U(32)
    low, high = (flat & _U(0xFFFFFFFF)).astype(np.float64), (flat >> _U(32)).astype(np.float64)
    for band in (own, own - 1):
        k = np.where((band >= 0) & (sizes > 0), bound[np.maximum(band, 0)], 0)
        wide = k > 8  # two sub-parts to a part: each sub-part is a signature, and all sets are summed at once
        parts = np.array([2 * cut(int(x))[0] if x > 8 else 0 for x in k])
        base = np.cumsum(parts) - parts
        mine = wide[of]
        key = base[of[mine]] + (spot[mine] * parts[of[mine]].astype(_U) >> _U(32)).astype(np.int64)
        slots = int(parts.sum())
        full = np.bincount(key, minlength=slots) > 0
        total = np.bincount(key, low[mine], slots).astype(_U) + (np.bincount(key, high[mine], slots).astype(_U) << _U(32))
        at = np.repeat(np.arange(len(sets)), parts)
        name = _name(band[at], 0, np.arange(slots) - base[at])
        sig.append(_mix(total ^ name)[full])
        owner.append(at[full])
        filled = np.bincount(at[full], minlength=len(sets))
        for d in np.flatnonzero((k > 0) & (~wide | (filled <= k))):
            for seed in range(1 if wide[d] else 0, SEEDS):
                found, thin = _family(sets[d] if seed else rare[d], int(band[d]), int(k[d]), seed)
                sig.append(found)
                owner.append(np.full(len(found), d))
                if not thin:
                    break
            else:
                sig.append(_name(int(band[d]), SEEDS, np.array([0])))
                owner.append(np.array([d]))
    return np.concatenate(sig), np.concatenate(owner)


def _units(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    start, held, size = 0, [], 0
    for k, t in enumerate(column.to_pylist()):
        t = t or ""
        if held and size + len(t) > UNIT_CHARS:
            yield start, held
            start, held, size = k, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def fingerprints(docs: DataFrame, key: str, text: str, n: int, row: bool = False) -> DataFrame:
    """key, n_shingles, f, f2: the size and the 128-bit fingerprint of every document's set; with row also r, r2, a hash of the whole row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, f, f2 = [], [], []
            for _, texts in _units(batch.column(1)):
                for t in texts:
                    h = shingles(t, n)
                    a, b = _fingerprint(h)
                    size.append(len(h))
                    f.append(a)
                    f2.append(b)
            cols = [batch.column(0), pa.array(size, pa.int64()), pa.array(f, pa.int64()), pa.array(f2, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, [key, "n_shingles", "f", "f2", "r", "r2"][: len(cols)])

    kind, more = docs.schema[key].dataType.simpleString(), [c.alias(n) for c, n in zip(row_hash(docs), ("r", "r2"), strict=True)] if row else []
    return text_rows(docs).select(key, text, *more).mapInArrow(run, f"`{key}` {kind}, n_shingles long, f long, f2 long" + ", r long, r2 long" * row)


def row_hash(docs: DataFrame) -> list[Column]:
    """128 bits of a whole row, as two longs."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def _common(docs: DataFrame, key: str, text: str, n: int) -> np.ndarray:
    """A table of fixed size that marks shingles which many documents of a bounded sample hold.

    Which ones it marks changes the number of candidates only."""
    total = docs.count()
    sample = docs
    if total > COMMON_SAMPLE:
        sample = docs.where(F.pmod(F.xxhash64(key, F.lit(13)), F.lit(1 << 30)) < int((1 << 30) * COMMON_SAMPLE / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _units(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t, n) for t in texts]).view(np.int64))], ["h"])

    often = sample.select(text).mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON_TIMES)
    marked = often.select(F.shiftrightunsigned("h", 64 - 22).alias("at")).distinct().toArrow()["at"].to_numpy()
    table = np.zeros(COMMON_BITS, bool)
    table[marked] = True
    return table


def _signature_rows(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    common = docs.sparkSession.sparkContext.broadcast(np.packbits(_common(docs, key, text, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # equal sets of one task send their signatures once
        table = np.unpackbits(common.value).astype(bool)
        for batch in batches:
            for _, texts in _units(batch.column(0)):
                sets, names = [], []
                for t in texts:
                    h = shingles(t, n)
                    f = _fingerprint(h)
                    if len(h) and f not in seen:
                        seen.add(f)
                        sets.append(h)
                        names.append(f[0])
                if sets:
                    sig, owner = signatures(sets, percent, table)
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.array(names, np.int64)[owner])], ["sig", "f"])

    return docs.select(text).mapInArrow(run, "sig long, f long")


def _bits(f: np.ndarray) -> np.ndarray:
    f = f.view(_U)
    return np.stack([(_mix(f + _U(i)) % _U(BLOOM_BITS)).astype(np.int64) for i in range(4)])


def _filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the column f of nodes, as 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = np.zeros(BLOOM_BITS // 64, _U) if words is None else words
            at = _bits(batch.column(0).to_numpy(zero_copy_only=False)).ravel()
            np.bitwise_or.at(words, at // 64, _U(1) << (at % 64).astype(_U))
        if words is not None:
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["at", "word"])

    found = nodes.select("f").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, _U)
    words[found["at"].to_numpy()] = found["word"].to_numpy().view(_U)
    return words


def _sets(docs: DataFrame, key: str, text: str, n: int, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """f, node, size, h of every class whose f is in nodes.

    One document of each class is read again: a filter over their keys' hashes tells Python which texts to hash."""
    chosen = prints.where("n_shingles > 0").join(nodes, "f", "left_semi").groupBy("f", "f2").agg(F.min(F.xxhash64(key)).alias("k"))
    words = docs.sparkSession.sparkContext.broadcast(_filter(chosen.select(F.col("k").alias("f"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            at = _bits(batch.column(1).to_numpy(zero_copy_only=False))
            hit = (words.value[at // 64] >> (at % 64).astype(_U) & _U(1)).all(axis=0)
            for _, texts in _units(batch.column(0).filter(pa.array(hit))):
                f, f2, sets = [], [], []
                for t in texts:
                    h = shingles(t, n)
                    a, b = _fingerprint(h)
                    if len(h) and (a, b) not in seen:
                        seen.add((a, b))
                        f.append(a)
                        f2.append(b)
                        sets.append(h)
                if f:
                    offsets = np.zeros(len(sets) + 1, np.int32)
                    np.cumsum([len(h) for h in sets], out=offsets[1:])
                    h = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(f2, pa.int64()), h], ["f", "f2", "h"])

    found = docs.select(text, F.xxhash64(key).alias("k")).mapInArrow(run, "f long, f2 long, h array<long>")
    found = found.join(nodes, "f", "left_semi").dropDuplicates(["f", "f2"])
    return found.select("f", node("f", "f2").alias("node"), F.size("h").alias("size"), "h")


def node(f: str, f2: str):
    """One sortable name for a 128-bit class."""
    return F.concat(F.lpad(F.hex(f), 16, "0"), F.lpad(F.hex(f2), 16, "0"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (p, f) of classes within the threshold, as edges a, b between nodes."""
    left = sets.select(F.col("f").alias("p"), F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("h").alias("ha"))
    right = sets.select("f", F.col("node").alias("b"), "size", "h")
    both = pairs.join(left, "p").join(right, "f")
    both = both.where(100 * F.least("size", "size_a") >= percent * F.greatest("size", "size_a"))
    both = both.withColumn("common", F.size(F.array_intersect("h", "ha")))
    return both.where(100 * F.col("common") >= percent * (F.col("size") + F.col("size_a") - F.col("common"))).select("a", "b")


def _blocked(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges a, b that connect what all links within large signature groups connect, by products of bounded blocks.

    open_ has sig, f, c (the class's component so far). Groups that share classes form a cluster; its largest component is
    its core, whose members need no comparison with each other. Every other class meets all classes of its cluster, block
    by block; a task holds two blocks."""
    firsts = stage(open_.groupBy("sig").agg(F.min("f").alias("b")), "firsts")  # written, so that a large group's join can be split
    stars = firsts.join(open_, "sig").select(F.col("f").alias("a"), "b").distinct()
    clusters = components(stars)
    placed = open_.select("f", "c").distinct().join(clusters.withColumnsRenamed({"node": "f", "root": "cluster"}), "f")
    core = placed.groupBy("cluster", "c").count().groupBy("cluster").agg(F.max_by("c", F.struct("count", "c")).alias("core"))
    placed = placed.join(core, "cluster").join(sets.select("f", "size"), "f")
    placed = stage(placed.select("cluster", "f", "size", (F.col("c") == F.col("core")).alias("in_core")), "clusters")
    blocks = lambda x: F.ceil(F.greatest(F.count_if(x) / BLOCK, F.sum(F.when(x, F.col("size")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    counts = placed.groupBy("cluster").agg(blocks(~F.col("in_core")).alias("rest"), blocks(F.col("in_core")).alias("cores"))
    placed = placed.drop("size").join(counts, "cluster").join(sets.select("f", "node", "size", "h"), "f")
    spot = F.xxhash64("f", F.lit(17))
    placed = placed.withColumn("spot", F.when(F.col("in_core"), F.pmod(spot, "cores")).otherwise(F.col("cores") + F.pmod(spot, "rest")).cast("int"))
    left = placed.where("not in_core").withColumn("i", F.col("spot")).withColumn("j", F.explode(F.expr("sequence(0, cores + rest - 1)"))).where("j <= i")
    right = placed.withColumn("j", F.col("spot")).withColumn("i", F.explode(F.expr("sequence(cores, cores + rest - 1)"))).where("j <= i")
    pairs = left.withColumn("left", F.lit(True)).unionByName(right.withColumn("left", F.lit(False))).select("cluster", "i", "j", "left", "node", "size", "h")

    def product(table: pa.Table) -> pa.Table:
        at = table["left"].to_numpy()
        a, b = table.filter(pa.array(at)), table.filter(pa.array(~at))
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})
        sides = []
        for t in (a, b):
            h = t["h"].combine_chunks()
            sides.append((np.repeat(np.arange(len(t)), np.diff(h.offsets.to_numpy())), h.flatten().to_numpy()))
        both = np.intersect1d(sides[0][1], sides[1][1])
        common = np.zeros((len(a), len(b)))
        for low in range(0, len(both), COLUMNS):
            part = both[low : low + COLUMNS]
            dense = []
            for (of, h), t in zip(sides, (a, b), strict=True):
                spot = np.minimum(np.searchsorted(part, h), len(part) - 1)
                hit = part[spot] == h
                x = np.zeros((len(t), len(part)), np.float32)
                x[of[hit], spot[hit]] = 1
                dense.append(x)
            common += dense[0] @ dense[1].T  # exact: at most COLUMNS a step
        n = common.astype(np.int64)
        total = a["size"].to_numpy().astype(np.int64)[:, None] + b["size"].to_numpy().astype(np.int64) - n
        x, y = np.nonzero(100 * n >= percent * total)
        names, node_of = np.unique(np.array(a["node"].to_pylist() + b["node"].to_pylist()), return_inverse=True)
        u, w, low = node_of[x], node_of[len(a) + y], np.arange(len(names))
        while True:
            new = low.copy()
            np.minimum.at(new, u, low[w])
            np.minimum.at(new, w, new[u])
            new = new[new]
            if (new == low).all():
                break
            low = new
        tied = np.flatnonzero(low != np.arange(len(low)))
        return pa.table({"a": pa.array(names[tied].tolist(), pa.string()), "b": pa.array(names[low[tied]].tolist(), pa.string())})

    return pairs.groupBy("cluster", "i", "j").applyInArrow(product, "a string, b string")


def links(docs: DataFrame, key: str, text: str, n: int, percent: int, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between classes that connect exactly what all pairs within the threshold connect; and their components."""
    by = Window.partitionBy("sig").orderBy("f")
    rows = _signature_rows(docs, key, text, n, percent)
    rows = rows.select("sig", "f", F.first("f").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.lag("f").over(by).alias("before"))
    shared = stage(rows.where("f <> p and f <> before").select("sig", "f", "p"), "shared")
    nodes = shared.select("f").unionByName(shared.select(F.col("p").alias("f"))).distinct()
    sets = stage(_sets(docs, key, text, n, prints, nodes), "sets")
    tested = stage(shared.select("p", "f").distinct(), "pairs")
    found = stage(_verified(tested, sets, percent), "links")
    roots = components(found)  # a table of its own
    of = sets.select("f", "node").join(roots, "node", "left").select("f", F.coalesce("root", "node").alias("c"))
    members = shared.select("sig", "f").unionByName(shared.groupBy("sig").agg(F.first("p").alias("f")))
    placed = stage(members.join(of, "f"), "placed")
    release(shared)
    apart = placed.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high").select("sig", "n")
    open_ = stage(placed.join(apart, "sig"), "open")
    release(placed)
    if open_.isEmpty():
        release(open_, tested, sets)
        return found, roots
    few = open_.where(F.col("n") <= SMALL_GROUP)
    pairs = few.join(few.select("sig", F.col("f").alias("p"), F.col("c").alias("pc")), "sig").where("c < pc")
    pairs = pairs.select(F.least("p", "f").alias("p"), F.greatest("p", "f").alias("f")).distinct().join(tested, ["p", "f"], "left_anti")
    more = _verified(pairs, sets, percent)
    many = open_.where(F.col("n") > SMALL_GROUP)
    if not many.isEmpty():
        more = more.unionByName(_blocked(many, sets, percent))
    first, found = found, stage(found.unionByName(more), "links")
    release(first, roots, open_, tested, sets)
    return found, components(found)


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """Per row of docs: key, n_shingles, component (smallest key reachable by links), f, f2 (the class).

    Two rows link when 100 * |intersection| >= percent * |union| of their sets of distinct n-word shingles. A null text
    is empty; an empty set links with nothing and its component is its own key. Rows with a null key take part, and
    their component is the smallest key that is not null (null if there is none). Repeated rows and equal sets of other
    texts link by definition. Only key and text are read, so other columns never clash. An empty table gives no rows.
    """
    prints = stage(fingerprints(docs, key, text, n), "prints")
    _, roots = links(docs, key, text, n, percent, prints)
    named = prints.withColumn("node", node("f", "f2"))
    classes = named.where("n_shingles > 0").groupBy("node").agg(F.min(key).alias("low")).join(roots, "node", "left")
    classes = stage(classes.select("node", "low", F.coalesce("root", "node").alias("root")), "classes")
    least = stage(classes.groupBy("root").agg(F.min("low").alias("component")), "components")  # written, so that a large component's join can be split
    named_components = classes.join(least, "root").select("node", "component")
    out = named.join(named_components, "node", "left")
    return out.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col(key)).alias("component"), "f", "f2")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, that stay when each component of links keeps one row.

    The row with the smallest key stays, null last; among rows of one key, the one whose whole row hashes lowest. Rows
    without words all stay.
    """
    prints = stage(fingerprints(docs, key, text, n, row=True), "prints")
    found, roots = links(docs, key, text, n, percent, prints)
    best = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("low"), "r", "r2"))
    classes = prints.where("n_shingles > 0").groupBy("f", "f2").agg(F.count("*").alias("rows"), best.alias("best")).withColumn("node", node("f", "f2"))
    classes = stage(classes.join(roots, "node", "left").select("f", "f2", "rows", "best", F.coalesce("root", "node").alias("root")), "classes")
    groups = classes.groupBy("root").agg(F.sum("rows").alias("rows"), F.min("best").alias("best")).where("rows > 1")
    stays = classes.select("f", "f2", "root").join(groups, "root").select("f", "f2", F.col("best.r").alias("kept"), F.col("best.r2").alias("kept2"))
    rows = prints.where("n_shingles > 0").join(stays, ["f", "f2"]).groupBy("r", "r2").agg(F.count("*").alias("copies"), F.max((F.col("r") == F.col("kept")) & (F.col("r2") == F.col("kept2"))).alias("stays"))
    named = stage(rows.where("not stays or copies > 1").select("r", "r2", "stays"), "named")  # rows that go, and those of which one copy stays
    release(found, roots, prints, classes)
    return _without(docs, named)


def _without(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of docs that named (r, r2, stays: hashes of whole rows) does not name, and one row for each name with stays.

    A table of bits of fixed size tells which rows may be named: only those are shuffled for the exact test."""
    spot = F.col("r").bitwiseAND(F.lit((1 << GONE_BITS) - 1))
    word, bit = F.shiftright(spot, 6), spot.bitwiseAND(F.lit(63)).cast("int")
    table = named.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(r & 63 as int))")).alias("bits"))
    r, r2 = row_hash(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), r.alias("r"), r2.alias("r2")).withColumn("word", word)
    rows = rows.join(F.broadcast(table), "word", "left")  # 2 ** 19 rows of two numbers at most
    hit = F.coalesce(F.getbit("bits", bit) == 1, F.lit(False))
    maybe = rows.where(hit).select("row", "r", "r2").join(named, ["r", "r2"], "left").where("coalesce(stays, true)")
    turn = F.when(F.col("stays"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())  # rows that are not named are no copies
    maybe = maybe.withColumn("turn", turn).dropDuplicates(["r", "r2", "turn"])
    return rows.where(~hit).select("row").unionByName(maybe.select("row")).select("row.*")
