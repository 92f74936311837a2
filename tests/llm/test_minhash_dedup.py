import random
import re

import pytest

from lotwise.llm import minhash_dedup
from lotwise.llm.minhash_dedup import keep_one, keyed, near_duplicates, op6_minhash_dedup
from lotwise.llm.tables import table

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """(id, n, component) per row, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def as_key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def corpus(seed, crowd=0):
    """Near copies, a passage that ``crowd`` documents share, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉß") for _ in range(rng.randint(1, 7)))
    rows, passage = [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "a b c d e")], \
        [word() for _ in range(40)]
    for i in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        for k in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                text[rng.randrange(len(text))] = word()
            rows.append((i * 20 + k, " ".join(text)))
    for i in range(crowd):
        rows.append((1000 + i, " ".join(passage + [word() for _ in range(rng.randint(5, 40))])))
    return rows + [rows[10], (None, rows[12][1]), (None, word() * 3)]


@pytest.mark.parametrize("giant", [64, 2])
def test_matches_brute_force(spark, giant):
    rows = corpus(giant, crowd=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(keyed(docs), giant=giant).collect()
    found = [(int(r.id) if r.id else None, r.n, r.component_id) for r in got]
    assert as_key(found) == as_key(brute(rows))


@pytest.mark.parametrize("giant", [1, 64])
def test_prefix_search_alone_is_exact(spark, giant):
    rows = [r for r in corpus(5, crowd=30) if r[0] is not None and shingles(r[1])]
    texts = spark.createDataFrame([(i, (t or "").encode()) for i, (_, t) in enumerate(rows)], "node long, text binary")
    members = texts.selectExpr("node", "node AS root")
    pairs = {(r.a, r.b) for r in minhash_dedup.prefix_pairs(members, texts, 75, 5, giant).collect()}
    sets = [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                assert (j, i) in pairs or (i, j) in pairs


def test_a_large_group_around_the_threshold(spark):
    """Copies of one text with so many changes that about half of them link."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            text[rng.randrange(120)] = f"x{rng.randrange(300)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(keyed(docs)).collect()
    assert as_key([(int(r.id), r.n, r.component_id) for r in got]) == as_key(brute(rows))


def test_whole_table(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    got = op6_minhash_dedup(spark, SMALL).collect()
    assert as_key([(r.doc_id, r.n_shingles, r.component_id) for r in got]) == as_key(
        brute([(r.doc_id, r.text) for r in docs]))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_one_carries_all_columns(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, n string, node string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = [d for d, n, c in brute(rows) if d == c or (d is None and c is None)]
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(set(x for x in want if x is not None))


def test_keep_one_keeps_one_of_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(["y"] + words[1:])]
    other = " ".join(f"v{i}" for i in range(30))
    for ids in ([None] * 3, [7] * 3, [None, 9, 8], [7, 7, None]):
        docs = spark.createDataFrame([(i, t) for i, t in zip(ids, near)] * 2 + [(7, other), (None, ""), (None, "")],
                                     "doc_id long, text string")
        got = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
        assert [t for _, t in got].count("") == 2 and (7, other) in got and len(got) == 4
        least = min((i for i in ids if i is not None), default=None)
        assert any(i == least and t in near for i, t in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(keyed(docs)).collect() == []
