"""Periodic runs against a quadratic search, and the query against it on planted documents."""

import hashlib
import random
import zlib

import pytest

from exprlake.llm import queries, runs

SF = "/root/testdata/sf0.001"


def plain_runs(w, least=12):
    """(start, length, period) of all runs, by trying every period at every place."""
    n, out = len(w), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            if length >= max(least, 2 * p) and not any(all(w[s + k] == w[s + k + q] for k in range(length - q)) for q in range(1, p)):
                out.add((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("piece", [2048, 2])
def test_equal_to_the_quadratic_search(piece, monkeypatch):
    monkeypatch.setattr(runs, "PIECE", piece)
    draw = random.Random(7)
    for _ in range(300):
        texts = []
        for _ in range(draw.randint(0, 5)):
            n, letters = draw.choice([0, 1, 11, 12, 40, 90]), "abcde"[: draw.choice([1, 2, 2, 3, 5])]
            w = [draw.choice(letters) for _ in range(n)]
            if n and draw.random() < 0.5:
                a = draw.randrange(n)
                p = 1 + draw.randrange((n - a) // 3 + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        least = draw.choice([2, 5, 12])
        got = list(runs._of_texts([" ".join(w).encode() for w in texts], least))
        for w, (n, found, text) in zip(texts, got, strict=True):
            assert n == len(w) and [tuple(r) for r in found.tolist()] == plain_runs(w, least)
            assert text.decode() == collapsed(w, plain_runs(w, least))


def test_a_very_long_text_of_one_word_and_of_two():
    one, two = (list(runs._of_texts([(w * 60_000).encode()], 12))[0] for w in ("a ", "a b "))
    assert one[1].tolist() == [[0, 60_000, 1]] and one[2] == b"a"
    assert two[1].tolist() == [[0, 120_000, 2]] and two[2] == b"a b"


def test_nulls_repeats_and_clashing_names(spark):
    line = "one two three four five six "
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n ", 0), (4, line * 3, 0), (4, line * 3, 1), (None, line * 2, 0), (5, "a b " * 12, 0), (6, "a b", 0)]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int")).collect()
    of = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    six = "one two three four five six"
    assert of[:3] == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], "")]
    assert of[3] == of[4] == (4, 18, [(0, 18, 6)], six)
    assert of[5:] == [(None, 12, [(0, 12, 6)], six), (5, 12, [(0, 12, 1)], "a b"), (6, 2, [], "a b")]


def test_empty_table(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_the_quadratic_search(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for r in queries.op13_runs(spark, SF).collect():
        h = zlib.crc32(str(r["doc_id"]).encode())
        w = (texts[r["doc_id"]] or "").encode().split()
        n, g = len(w), h // 10
        if n > 1_500:
            continue  # the quadratic search would take minutes
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        w = [x.decode() for x in w]
        found = plain_runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        digest = hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest()
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == digest and r["collapsed_sha256"] == hashlib.sha256(collapsed(w, found).encode()).hexdigest()
        seen += bool(found)
    assert seen >= 10


def test_query_on_documents_without_words(spark, tmp_path):
    """Every tenth document has runs planted by its number; one without words has none to repeat, and no error."""
    tenth = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [*zip(tenth, ("", " \t\n ", None, "a b c d"), strict=True), (10_001, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in queries.op13_runs(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert {k: (r["n_runs"], r["start"], r["n_words"]) for k, r in found.items()} == {k: (0, None, len((t or "").split())) for k, t in rows}
    assert all((r["runs_sha256"], r["collapsed_sha256"] == empty) == (empty, r["n_words"] == 0) for r in found.values())
