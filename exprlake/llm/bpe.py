"""BPE encoding and decoding with a pair occurrence index.

A partition is read in units of bounded size. The distinct new words of a unit are laid out as one
chain of symbols; an index maps each merge rank to all positions of its pair in that chain. Active ranks are applied in
ascending order, each at all its positions, and only the neighbouring pairs of a merged position are re-indexed. Words
are remembered between units in a memo of bounded size, which changes speed only.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from exprlake.llm.common import text_rows

#: White space of the vocabulary's patterns (the Unicode White_Space property); str.split also cuts at \x1c-\x1f.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of the younger half of the memo, characters of text encoded as one unit, and bytes of new words in one index.
MEMO, UNIT_CHARS, INDEX_BYTES = 200_000, 1_000_000, 300_000


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairIndexCodec:
    """Encoder and decoder for one vocabulary file (JSON: normaliser NFC and lower case, word-end suffix)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.inner = [vocab[s] for s in byte_symbols()]
        self.final = [vocab[s + end] for s in byte_symbols()]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {}
        for r, (a, b, _) in enumerate(self.merges):
            self.rank[a, b] = r  # a repeated pair takes its last rank
        self.is_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+").findall
        self.chunks = regex.compile(rf"[^{SPACE}]+").findall
        self.width = np.uint16 if max(self.tokens) < 65_536 else np.uint32
        self.first_rank = np.full((256, 2, 256), -1, dtype=np.int32)  # of a byte and the next, which is inside (0) or ends (1) the word
        sides = (self.inner, self.final)
        for x in (0, 1):
            for left in range(256):
                for right in range(256):
                    self.first_rank[left, x, right] = self.rank.get((self.inner[left], sides[x][right]), -1)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, chunk: str) -> list[str]:
        """Normalised words of a text without white space and special tokens."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")  # lower case has no final sigma
        return self.pieces(chunk.lower())

    def split(self, text: str) -> list[str]:
        """Chunks between white space; a special token is a chunk of its own."""
        if "<|" not in text:
            return self._bare(text)
        found, at = [], 0
        for m in self.is_special.finditer(text):
            found += self._bare(text[at : m.start()])
            found.append("\x00" + m.group())
            at = m.end()
        return found + self._bare(text[at:])

    def _bare(self, text: str) -> list[str]:
        found = self.chunks(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return [c if c[0] != "\x00" else "\x00\x00" + c[1:] for c in found] if "\x00" in text else found

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        chunks = [self.split(t) for t in texts]
        memo, older = self.memo, self.older
        new = set(chain.from_iterable(chunks)).difference(memo)
        known = new.intersection(older)
        memo.update((c, older[c]) for c in known)
        parts = {}
        for c in sorted(new - known):
            if c[0] != "\x00":
                parts[c] = self.words(c)
            elif c[1:] in self.special:
                memo[c] = np.array([self.special[c[1:]]], self.width).tobytes()
            else:
                parts[c] = self.words(c[1:])
        words = list(dict.fromkeys(chain.from_iterable(parts.values())))
        ids = dict(zip(words, self.encode_words(words), strict=True))
        for c, ws in parts.items():
            memo[c] = ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])
        return [np.frombuffer(b"".join(map(memo.__getitem__, c)), self.width) for c in chunks]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of every word; words of INDEX_BYTES together, or one longer word, share a pair occurrence index."""
        out, held, size = [], [], 0
        for w in words:
            raw = w.encode("utf-8")
            if held and size + len(raw) > INDEX_BYTES:
                out += self._indexed(held)
                held, size = [], 0
            held.append(raw)
            size += len(raw)
        return out + self._indexed(held) if held else out

    def _indexed(self, raws: list[bytes]) -> list[bytes]:
        lengths = np.array([len(r) for r in raws])
        flat = np.frombuffer(b"".join(raws), np.uint8)
        n, stops = len(flat), np.cumsum(lengths)
        starts, last = stops - lengths, np.zeros(len(flat), np.int8)
        last[stops - 1] = 1
        sym = np.where(last, np.array(self.final)[flat], np.array(self.inner)[flat]).tolist()
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[stops - 1] = prv[starts] = -1
        owner = np.repeat(np.arange(len(raws)), lengths).tolist()
        first = np.where(last[:-1], -1, self.first_rank[flat[:-1], last[1:], flat[1:]])
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        ranks, cuts = np.unique(first[places], return_index=True)
        at = {r: x.tolist() for r, x in zip(ranks.tolist(), np.split(places, cuts[1:]), strict=True)} if len(ranks) else {}
        nxt, prv = nxt.tolist(), prv.tolist()
        rank, merges, push = self.rank.get, self.merges, heapq.heappush
        heap = list(at)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            if r not in at:
                continue
            places = at.pop(r)
            places.sort()
            a, b, new = merges[r]
            waits = set()  # words in which a merge made a pair of lower rank: that one comes first
            for i in places:
                j = nxt[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                if waits and owner[i] in waits:
                    if r not in at:
                        at[r] = []
                        push(heap, r)
                    at[r].append(i)
                    continue
                sym[i], sym[j] = new, -1
                nxt[i] = k = nxt[j]
                if k >= 0:
                    prv[k] = i
                    x = rank((new, sym[k]))
                    if x is not None:
                        if x in at:
                            at[x].append(i)
                        else:
                            at[x] = [i]
                            push(heap, x)
                        if x < r:
                            waits.add(owner[i])
                p = prv[i]
                if p >= 0:
                    x = rank((sym[p], new))
                    if x is not None:
                        if x in at:
                            at[x].append(p)
                        else:
                            at[x] = [p]
                            push(heap, x)
                        if x < r:
                            waits.add(owner[i])
        sym = np.array(sym)
        left = sym >= 0
        ends = np.cumsum(left)[stops - 1] * np.dtype(self.width).itemsize
        packed, out, s = sym[left].astype(self.width).tobytes(), [], 0
        for e in ends.tolist():
            out.append(packed[s:e])
            s = e
        return out

    def decode(self, ids) -> str:
        """The tokens' strings, joined by one space; ids outside the vocabulary are left out."""
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join(t for i in ids if (t := self.tokens.get(i)) is not None)


@lru_cache(maxsize=4)
def codec(path: str) -> PairIndexCodec:
    return PairIndexCodec(path)


def _units(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > UNIT_CHARS:
            yield start, k
            start, size = k, 0
        size += len(t)
    yield start, len(texts)


def _encoded(texts: list[str], path: str) -> tuple[pa.Array, list[np.ndarray]]:
    ids = codec(path).encode_batch(texts)
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))), ids


def encode(df: DataFrame, key: str, text: str, path: str, decoded: bool = False) -> DataFrame:
    """Ids of every whole text: columns key, ids array<int>, and with decoded also the decoded string.

    A null text counts as empty and gives an empty array and an empty string. Only key and text are read, so other
    columns of df never clash; a null or repeated key is passed through row by row. path is the vocabulary file,
    which every executor can read.
    """
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField("decoded", T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _units(texts):
                if a == b:
                    continue
                column, ids = _encoded(texts[a:b], path)
                cols = [batch.column(0).slice(a, b - a), column]
                if decoded:
                    cols.append(pa.array([codec(path).decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, out.names)
        codec(path).older = {}  # a worker that goes on with other tasks holds one half of the memo only

    return text_rows(df).select(key, text).mapInArrow(run, out)


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """The decoded string of every array of ids: columns key, decoded. A null array counts as empty."""
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], out.names)

    return text_rows(df).select(key, ids).mapInArrow(run, out)
