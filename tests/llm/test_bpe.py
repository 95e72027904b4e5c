"""BPE against the tokenizers library, whose vocabulary file it reads."""

import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer

from exprlake.llm import bpe, queries  # noqa: E402

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", "   ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΟΔΟΣ", "İstanbul ǅ", "a\x1cb \x1d c", "é e\u0301 x\u00a0\u2003y", "\x00\x00 a\x00", "x'S don't we'LL 've'", "١٢٣ 123 ½", "日本語 한국어", "👍🏽 emoji!!", "a" * 5000, "ab" * 3000, "Å Ω ﬁ", "<|endoftext", "\ufeffhi", "\x85x\xa0y"]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def test_odd_texts_and_clashing_columns(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(ODD)] + [(None, "null key", "x", 1), (3, None, "x", 1), (3, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    found = bpe.encode(docs, "doc_id", "text", PATH, decoded=True).collect()
    assert len(found) == len(rows)
    want = sorted((str(k), *map(str, expected(t))) for k, t, *_ in rows)
    assert sorted((str(r[0]), str(r[1]), r[2]) for r in found) == want
    again = bpe.decode(bpe.encode(docs, "doc_id", "text", PATH), "doc_id", "ids", PATH)
    assert sorted(r["decoded"] for r in again.collect()) == sorted(w[2] for w in want)


def test_random_words_share_one_index():
    rng = random.Random(1)
    texts = ["".join(rng.choice("etaoin shrdlu'ÉßΣ0!<|") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    codec = bpe.PairIndexCodec(PATH)
    assert [x.tolist() for x in codec.encode_batch(texts)] == [expected(t)[0] for t in texts]


def test_digests_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Hello world")], "doc_id long, text string")
    ids, decoded = expected("Hello world")
    row = queries.bpe_digests(docs).first()
    assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert queries.bpe_digests(docs.limit(0)).count() == 0
