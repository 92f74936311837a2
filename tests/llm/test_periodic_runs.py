import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm.periodic_runs import Ordered, find_runs, op11_periodic_runs, periodic_runs
from lotwise.llm.tables import table

SMALL = "/root/testdata/sf0.001"


def brute_runs(words, min_length=6, min_exponent=4):
    """Every maximal stretch by its smallest period, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            part = words[start:start + length]
            smaller = any(all(part[k] == part[k + r] for k in range(length - r)) for r in range(1, q))
            if length >= max(min_length, min_exponent * q) and not smaller:
                out.append((start, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_of(documents, **kw):
    ids, off = [], [0]
    number = {}
    for words in documents:
        ids += [number.setdefault(w, len(number)) for w in words]
        off.append(len(ids))
    out = [[] for _ in documents]
    for d, start, length, period in find_runs(np.array(ids, np.uint64), np.array(off, np.int64), **kw).tolist():
        out[d].append((start, length, period))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=4), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_runs_of_few_letters_equal_brute_force(documents, bounds):
    length, exponent = bounds
    want = [brute_runs(list(d), length, exponent) for d in documents]
    assert runs_of(documents, min_length=length, min_exponent=exponent) == want


def test_planted_periods():
    rng, documents = random.Random(3), []
    for n in range(60):
        words = [rng.randrange(3 if n % 2 else 50) for _ in range(rng.randint(0, 120))]
        for _ in range(3):
            at = rng.randint(0, len(words))
            words[at:at] = [rng.randrange(9) for _ in range(rng.randint(1, 9))] * rng.randint(2, 9)
        documents.append(words)
    assert runs_of(documents) == [brute_runs(d) for d in documents]


def test_one_very_long_run_and_the_ordered_set():
    assert runs_of([["x"] * 60000, list("ab") * 20000]) == [[(0, 60000, 1)], [(0, 40000, 2)]]
    rng = random.Random(5)
    values = rng.sample(range(100000), 5000)
    held, seen = Ordered(values[0]), [values[0]]
    for x in values[1:]:
        assert held.insert(x) == (max((v for v in seen if v < x), default=None),
                                  min((v for v in seen if v > x), default=None)) if len(seen) < 900 else held.insert(x)
        seen.append(x)
    assert list(held) == sorted(values)


def contract_words(doc_id, text):
    words = "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ")
    words = [w for w in words if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def contract_row(doc_id, text, runs=brute_runs):
    words = contract_words(doc_id, text) if doc_id is not None else (text or "").split()
    found = runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def fast_runs(words):
    """The definition with numpy, for texts of thousands of words."""
    number: dict = {}
    a = np.array([number.setdefault(w, len(number)) for w in words])
    n, out = len(a), {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([0], (a[q:] == a[:-q]).astype(np.int8), [0]))
        edge = np.diff(same)
        for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if j - i + q >= max(6, 4 * q):
                out.setdefault((int(i), int(j - i + q)), q)     # the smallest period first
    return sorted(((i, n, q) for (i, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_query_equals_brute_force_on_whole_texts(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SMALL).collect()}
    want = {r.doc_id: contract_row(r.doc_id, r.text, fast_runs) for r in docs}
    assert got == want
    assert sum(r[1] > 0 for r in want.values()) > 5


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a a a a a a a"), (None, None), (5, "b b é é é é é é é"),
            (6, "x y " * 50), (6, "x y " * 50), (10 ** 12, "w " * 30000), (8, "one\x0btwo\x0cthree")]
    frame = spark.createDataFrame([(i, t, "e", 0) for i, t in rows], "doc_id long, text string, id string, runs int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = op11_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted((contract_row(i, t, fast_runs) for i, t in rows), key=key)
    assert periodic_runs(frame.where("false")).collect() == []
    kept = {r.collapsed for r in periodic_runs(frame.where("id = 'e' and doc_id = 6")).collect()}
    assert kept == {"x y"}
