import hashlib
import random

import numpy as np
import pytest

from lotwise.llm import suffix_dedup
from lotwise.llm.suffix_dedup import Suffixes, remove_repeats, remove_spans


def brute(texts, length):
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p:p + length]] = seen.get(t[p:p + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 30))) for _ in range(4)]
    texts = [None, "", "short", "aaaa" * 30, "ab" * 60]
    for _ in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 20))) for _ in range(2)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(passages))
        texts.append(" ".join(parts))
    return texts + texts[10:14] + [texts[12]] * 3


@pytest.mark.parametrize("limit", [1, 4, 4096])
def test_matches_brute_force(spark, limit):
    texts = corpus(limit)
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(docs, length=20, seed=6, group_limit=limit).collect()
    want = brute([(t or "").encode() for t in texts], 20)
    expect = sorted((str(i) if i is not None else "", *w) for (i, _), w in zip(rows, want))
    assert sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == expect
    assert sum(w[1] for w in want) > 100


def test_small_segments_and_sorts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 200)
    offsets = np.array([0, 5, 5, 300, 1000, 1010])
    parts = list(suffix_dedup.segments(offsets, 20, limit=100))
    seen = sorted(p for lo, hi, a, b in parts for d in range(lo, hi)
                  for p in range(max(a, offsets[d]), min(b, offsets[d + 1]) - 19))
    assert seen == [p for a, b in zip(offsets, offsets[1:]) for p in range(a, b - 19)]
    monkeypatch.setattr(suffix_dedup.segments, "__defaults__", (150,))
    texts = corpus(9) + ["".join(random.Random(8).choice("ab ") for _ in range(900))] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = remove_repeats(docs, length=20, seed=6).collect()
    want = brute([(t or "").encode() for t in texts], 20)
    assert sorted((int(r.id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == [
        (i, *w) for i, w in enumerate(want)]


def test_suffixes_sort_like_bytes():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    at = rng.permutation(2900)[:700]
    group = np.sort(rng.integers(0, 40, 700))
    got = Suffixes(buf, 50).sort(at, group)
    for g in range(40):
        mine = [buf[p:p + 50].tobytes() for p in got[group == g]]
        assert mine == sorted(mine)
        assert sorted(got[group == g]) == sorted(at[group == g])


def test_a_lying_hash_is_caught(monkeypatch):
    buf = np.frombuffer(b"abcdefghij" + b"abcdefghix", np.uint8)
    monkeypatch.setattr(Suffixes, "hashes", lambda self, at, size: np.zeros(len(at), np.uint64))
    owner, number = suffix_dedup.repeated_starts(
        buf, np.array([0, 10, 20]), np.array([0, 0]), np.array([0, 0]), np.array([1, 1]), 10)
    assert len(owner) == 0


def test_remove_spans_merges_touching_runs():
    assert remove_spans(b"0123456789", [(2, 4), (4, 6), (8, 9)]) == (5, 2, b"01679")
    assert remove_spans(b"01", []) == (0, 0, b"01")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs, length=20, seed=6).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_query_removes_400_bytes_not_50_words(spark, tmp_path):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shorter = " ".join([word(6) for _ in range(56)] + [word(7)])
    longer = " ".join([word(6) for _ in range(56)] + [word(8)])
    assert (len(shorter), len(longer)) == (399, 400)
    texts = [f"{a}<{passage}>{b}" for passage, a, b in
             ((shorter, "A", "B"), (shorter, "C", "D"), (longer, "E", "F"), (longer, "G", "H"))]
    # the marks differ too, else they would lengthen the passages
    texts = [t.replace("<", str(i)).replace(">", str(i)) for i, t in enumerate(texts)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    kept = texts[:2] + ["E22F", "G33H"]
    for i, text in rows:
        removed = len(text) - len(kept[i])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(text), removed, int(removed > 0))
        assert got[i].kept_sha256 == hashlib.sha256(kept[i].encode()).hexdigest()
