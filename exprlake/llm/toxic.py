"""Toxicity by a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (3 to 6 code points, lower-cased, white space as blanks), hashed to 2^20
slots. Counts of present features by class give each slot's smoothed log-count ratio; the slots whose ratio is
significant take part, and a logistic regression is fitted on their presence times ratio. The fit uses a bounded
sample of labelled rows (FIT_ROWS); scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from exprlake.llm.common import text_rows

#: Rows of the fitting sample on average, slots of the hash, n-gram lengths.
FIT_ROWS, BITS, LENGTHS = 24_000, 20, (3, 4, 5, 6)
#: Count smoothing, least |z| of a ratio that takes part, ridge strength, most steps of the regression and steps that it remembers.
SMOOTH, LEAST_Z, RIDGE, STEPS, MEMORY = 0.5, 3.0, 1e-3, 100, 8
THRESHOLD = 0.3
UNIT_CHARS = 250_000


def remainder(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def _features(texts: list[str], keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of every distinct present feature, of the kept slots only if keep is given."""
    lowered = [f" {t.lower()} " for t in texts]
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in lowered])
    ends = np.cumsum(sizes)
    c = np.where(c <= 32, np.uint32(32), c)
    h, found = c, []
    for n in range(2, LENGTHS[-1] + 1):
        h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
        if n not in LENGTHS:
            continue
        slot = ((h ^ (h >> np.uint32(15))) * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS)
        at = np.flatnonzero(keep[slot]) if keep is not None else np.arange(len(slot))
        of = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[of]
        found.append((of[inside] << BITS) + slot[at[inside]])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def _units(texts: list) -> Iterator[tuple[int, list[str]]]:
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > UNIT_CHARS:
            yield start, held
            start, held, size = k, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, held


def _class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows with each slot by class: two arrays over the slots, of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for start, texts in _units(batch.column(0).to_pylist()):
                of, slot = _features(texts, None)
                np.add.at(counts, (label[start + of], slot), 1)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], ["slot", "clean", "toxic"])

    rows = sample.select("text", "label").mapInArrow(run, "slot long, clean long, toxic long")
    rows = rows.groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, 1 << BITS))
    counts[0, rows["slot"].to_numpy()] = rows["clean"].to_numpy()
    counts[1, rows["slot"].to_numpy()] = rows["toxic"].to_numpy()
    return counts[0], counts[1]


def _parts(sizes: np.ndarray, most: int = 1_000_000) -> list[tuple[slice, slice]]:
    """Runs of rows and their runs of entries, of about most entries each, so that products of parts stay small."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.unique(np.concatenate([np.searchsorted(ends, np.arange(0, ends[-1], most)), [len(sizes)]]))
    return [(slice(a, b), slice(ends[a], ends[b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _regression(at: np.ndarray, sizes: np.ndarray, ratio: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge, by L-BFGS, on the presence of features times their ratio.

    at lists the features of all rows in turn, sizes how many of them each row has."""
    width, n = len(ratio), len(y)
    parts = _parts(sizes)

    def cost(x: np.ndarray) -> tuple[float, np.ndarray]:
        z, scaled = np.full(n, x[-1]), x[:-1] * ratio
        for rows, entries in parts:
            of = np.repeat(np.arange(rows.stop - rows.start), sizes[rows])
            z[rows] += np.bincount(of, scaled[at[entries]], rows.stop - rows.start)
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        slope = np.zeros(width)
        for rows, entries in parts:
            slope += np.bincount(at[entries], np.repeat(gap[rows], sizes[rows]), width)
        value = np.mean(np.logaddexp(0, z) - y * z) + RIDGE / 2 * x[:-1] @ x[:-1]
        return value, np.append(RIDGE * x[:-1] + slope * ratio / n, gap.mean())

    x = np.append(np.zeros(width), np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    value, g = cost(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []  # the last moves, with the change of the gradient
    for _ in range(STEPS):
        if np.abs(g).max() < 1e-6:
            break
        d, held = g.copy(), []
        for s, t in reversed(steps):
            a = s @ d / (s @ t)
            held.append(a)
            d -= a * t
        d *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, np.sqrt(g @ g))
        for (s, t), a in zip(steps, reversed(held), strict=True):
            d += s * (a - t @ d / (s @ t))
        size, slope = 1.0, g @ d
        while True:
            new, new_g = cost(x - size * d)
            if new <= value - 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, t = -size * d, new_g - g
        x, value, g = x + s, new, new_g
        if s @ t > 1e-16:
            steps = [*steps[-MEMORY + 1 :], (s, t)]
    return x[:-1], float(x[-1])


def _gathered(places: pa.ChunkedArray, order: np.ndarray, width: type) -> tuple[np.ndarray, np.ndarray]:
    """The number of entries of every row in the given order, and all entries in turn."""
    each = []
    for chunk in places.chunks:
        offsets = np.frombuffer(chunk.buffers()[1], np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        values = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        each += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.array([len(each[k]) for k in order], np.int64)
    out, start = np.empty(int(sizes.sum()), np.uint8), 0
    for k, size in zip(order, sizes, strict=True):
        out[start : start + size] = each[k]
        start += size
    return sizes // np.dtype(width).itemsize, out.view(width)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The model: weight of every slot, the kept slots and the intercept.

    Only rows of labels whose crc32 remainder is not 2 are read. A key labelled more than once is toxic if any label says so;
    null keys and labels are left out. Beyond FIT_ROWS labelled keys, a hash of the key draws that many on average.
    """
    docs = text_rows(docs)
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (remainder(F.col(key)) != 2))
    marks = marks.groupBy(key).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    n = marks.count()
    if n > FIT_ROWS:
        marks = marks.where(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1 << 30)) < int((1 << 30) * FIT_ROWS / n))
    sample = docs.select(key, F.col(text).alias("text")).join(F.broadcast(marks.select(key, "label")), key)  # about FIT_ROWS rows of two numbers
    clean, toxic = _class_counts(sample)
    rows = sample.select(F.count("*"), F.sum("label")).first()
    n, n_toxic = int(rows[0]), int(rows[1] or 0)
    if not n_toxic or n_toxic == n:
        return {"weight": np.zeros(1 << BITS, np.float32), "keep": np.zeros(1 << BITS, bool), "bias": float("inf") if n_toxic else -float("inf")}
    # log-count ratio of presence, each class's counts taken against its rows
    ratio = np.log((toxic + SMOOTH) / (n_toxic + 2 * SMOOTH)) - np.log((clean + SMOOTH) / (n - n_toxic + 2 * SMOOTH))
    z = np.where(toxic + clean > 0, np.abs(ratio) / np.sqrt(1 / (toxic + SMOOTH) + 1 / (clean + SMOOTH)), 0)
    best = np.flatnonzero(z >= LEAST_Z)
    keep = np.zeros(1 << BITS, bool)
    keep[best] = True
    spark = docs.sparkSession
    kept = spark.sparkContext.broadcast((keep, best))
    width = np.uint16 if len(best) <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _units(batch.column(1).to_pylist()):
                of, slot = _features(texts, kept.value[0])
                at = np.searchsorted(kept.value[1], slot).astype(width)
                cuts = np.searchsorted(of, np.arange(len(texts) + 1))
                places = pa.array([at[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2).cast(pa.int32()), places], ["k", "label", "places"])

    data = sample.select(F.col(key).cast("string"), "text", "label").mapInArrow(run, "k string, label int, places binary").toArrow()
    rows = data.select(["k", "label"]).append_column("row", pa.array(np.arange(data.num_rows)))
    order = rows.sort_by([("k", "ascending"), ("label", "ascending")])["row"].to_numpy()  # the order of the sum, so that reruns agree
    y = data["label"].to_numpy().astype(float)[order]
    sizes, at = _gathered(data["places"], order, width)
    del data, rows
    pa.default_memory_pool().release_unused()
    w, bias = _regression(at, sizes, ratio[best], y)
    weight = np.zeros(1 << BITS, np.float32)
    weight[best] = w * ratio[best]
    return {"weight": weight, "keep": keep, "bias": bias}


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """row (docs' columns as a struct) and score (0 to 1). A null text counts as empty and gets the intercept's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    rows = text_rows(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores = []
            for _, texts in _units(batch.column(0).field(place).to_pylist()):
                of, slot = _features(texts, m["keep"])
                z = np.bincount(of, m["weight"][slot].astype(np.float64), len(texts)) + m["bias"]
                with np.errstate(over="ignore"):
                    scores.append(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["row", "score"])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Per row of docs: key, held_out, score, predicted (1 from THRESHOLD on).

    Inputs of a score are the text alone. Null and empty texts get a score too; null or repeated keys pass through row by row; a
    null key is not held out. Without labels, or with one class only, every score is 0 (1 if all labels are toxic).
    """
    model = fit(docs, labels, key, text, label)
    scored = score(docs.select(key, text), model, text).select("row.*", "score")
    return scored.select(key, (remainder(F.col(key)) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs, with their columns, whose score is below THRESHOLD."""
    model = fit(docs, labels, key, text, label)
    return score(docs, model, text).where(F.col("score") < THRESHOLD).select("row.*")
