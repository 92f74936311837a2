import hashlib
import random

import pytest

from lotwise.llm import exact_dedup
from lotwise.llm.exact_dedup import digest_rows, groups, keep_unique, new_index, verdicts


def rows():
    rng = random.Random(3)
    texts = ["", None, "a", "A", "é" * 5000] + [f"text {i}" for i in range(20)]
    out = [(i, rng.choice(texts)) for i in range(120)] + [(5, "a"), (5, "a"), (None, "a"), (None, "only null")]
    return out + [(None, "only null")]


def brute(data):
    groups_ = {}
    for i, (doc_id, text) in enumerate(data):
        groups_.setdefault(text or "", []).append((doc_id is not None, doc_id or 0, i))
    out = []
    for text, members in groups_.items():
        has, top, winner = max(members)
        for known, doc_id, i in members:
            out.append((doc_id if known else None, top if has else None, len(members), i == winner,
                        hashlib.sha256(text.encode()).hexdigest()))
    return out


def order(found):
    return sorted(found, key=repr)


def run(spark, data, batches=2):
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = digest_rows(docs)
    index = new_index(spark)
    index.feed(found, batches)
    return index, [tuple(r) for r in verdicts(found, index).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_matches_brute_force(spark, batches):
    _, got = run(spark, rows(), batches)
    assert order(got) == order(brute(rows()))


def test_later_batches_go_through_the_anti_join(spark, monkeypatch):
    plans, unseen = [], exact_dedup.DigestIndex.unseen

    def watched(self, batch):
        out = unseen(self, batch)
        plans.append((batch.count(), out.count(), out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(exact_dedup.DigestIndex, "unseen", watched)
    run(spark, rows())
    (first, new, _), (second, left, plan) = plans
    assert first == new and 0 < second and left < second
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_empty_table(spark):
    assert run(spark, [])[1] == []


def test_a_second_batch_is_compared_with_the_index(spark):
    index, _ = run(spark, [(1, "x"), (2, "y")])
    batch = spark.createDataFrame([(3, "x"), (4, "z"), (5, "z")], "doc_id long, text string")
    assert [r.doc_id for r in keep_unique(batch, index).collect()] == [5]
    assert index.read().count() == 3
    assert keep_unique(batch, index).collect() == []
    index.append(groups(digest_rows(batch)))
    assert index.read().count() == 3


def test_the_index_is_not_moved_by_the_anti_join(spark):
    index, _ = run(spark, [(i, f"t{i}") for i in range(50)])
    batch = groups(digest_rows(spark.createDataFrame([(9, "t1"), (60, "new")], "doc_id long, text string")))
    plan = index.unseen(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert "Bucketed: true" in plan


def test_keep_unique_carries_clashing_columns(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows()],
                                 "doc_id long, text string, digest string, copies int")
    kept = keep_unique(docs, new_index(spark))
    assert kept.columns == docs.columns
    want = sorted((d is not None, d or 0, t or "") for (d, _, _, k, _), t in zip(brute(rows()), texts_of(rows())) if k)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == want


def texts_of(data):
    """Texts in the order in which ``brute`` lists its rows."""
    order_ = {}
    for _, text in data:
        order_.setdefault(text or "", []).append(text or "")
    return [t for members in order_.values() for t in members]


def test_digest_is_sha256_of_the_text(spark):
    got = spark.createDataFrame([("é",)], "text string").select(exact_dedup.digest()).first()[0]
    assert bytes(got) == hashlib.sha256("é".encode()).digest()
