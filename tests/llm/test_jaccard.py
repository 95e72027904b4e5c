"""The Jaccard join against brute force, and the signatures' completeness."""

import random
from itertools import combinations

import numpy as np
import pytest

from exprlake.llm import jaccard


def brute(rows, n, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {b" ".join(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    keys = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            keys[find(i)] = min(k, keys.get(find(i), k))
    out = sorted(((k, len(s), keys.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)
    return out, sorted((str(keys.get(i)) for i in {find(i) for i, s in enumerate(sets) if s}))


def corpus(seed, near=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    base = [[word() for _ in range(rng.choice([0, 1, 3, 4, 5, 8, 12, 40, 120]))] for _ in range(40)]
    rows = [" ".join(b) for b in base]
    for b in base[:20]:  # copies with a few changed words
        for _ in range(3):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                if c:
                    c[rng.randrange(len(c))] = word()
            rows.append("  ".join(c).upper())
    long = [word() for _ in range(150)]
    for _ in range(near):  # one large group around the threshold
        c = list(long)
        for _ in range(rng.randint(0, 6)):
            c[rng.randrange(len(c))] = word()
        rows.append(" ".join(c))
    passage = " ".join(word() for _ in range(60))
    rows += [f"{passage} {' '.join(word() for _ in range(rng.randint(5, 60)))}" for _ in range(50)]
    rows += [None, "", " \t ", "one", "one", "ONE"]
    keyed = [(i, t) for i, t in enumerate(rows)] + [(None, rows[45]), (7, rows[50]), (7, rows[50]), (None, None)]
    rng.shuffle(keyed)
    return keyed


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_components_equal_brute_force(spark, n, percent):
    rows = corpus(n)
    docs = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], "doc_id long, text string, f int, node string")
    found = jaccard.join_components(docs, n=n, percent=percent).select("doc_id", "n_shingles", "component").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, n, percent)[0]
    kept = jaccard.keep_one(docs, n=n, percent=percent)
    assert kept.columns == docs.columns
    words = [r["doc_id"] for r in kept.collect() if (r["text"] or "").split()]
    assert sorted(map(str, words)) == brute(rows, n, percent)[1]
    assert sum(not (r["text"] or "").split() for r in kept.collect()) == sum(not (t or "").split() for _, t in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_components(docs).count() == 0 and jaccard.keep_one(docs).count() == 0


@pytest.mark.parametrize("share_common", [0.0, 0.5, 1.0])
def test_pairs_within_the_threshold_share_a_signature(share_common):
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        for size in [1, 5, 6, 7, 9, 12, 20, 33, 60, 150, 400]:
            for _ in range(25):
                a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
                common = np.zeros(jaccard.COMMON_BITS, bool)
                common[(a[: int(share_common * size)] >> np.uint64(42)).astype(int)] = True
                drop = rng.integers(0, size * (100 - percent) // 100 + 1)
                b = a[: size - drop]
                add = int(rng.integers(0, 1 + max(0, len(b) * 100 // percent - size)))
                b = np.concatenate([b, rng.integers(0, 1 << 63, add, dtype=np.uint64) * np.uint64(2)])
                inter, union = size - drop, size + add
                if 100 * inter < percent * union or (drop == 0 and add == 0):
                    continue
                sig, of = jaccard.signatures([np.sort(a), np.sort(b)], percent, common)
                assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_long_texts_hash_in_parts_alike(monkeypatch):
    text = " ".join(str(i * i % 1009) for i in range(5000))
    whole = jaccard.shingles(text, 4)
    monkeypatch.setattr(jaccard, "LONG_WORDS", 97)
    assert (jaccard.shingles(text, 4) == whole).all()
    words = text.split()
    assert len(whole) == len({tuple(words[i : i + 4]) for i in range(len(words) - 3)})
