import collections
import json
import pathlib

import corpus_pipeline
from lotwise.llm.tables import cut, table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage is judged on what its predecessor kept."""
    import re
    from .test_minhash_dedup import shingles
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    frames = [docs]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(cut(stage(spark, frames[-1], FOLDER), f"test-{number}"))
    before, good, unique, apart, mixed, packed = (f.collect() for f in frames)
    assert all(f.columns == columns for f in frames[:-1])

    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    kept = {r.doc_id for r in good}
    judged = [(r.doc_id in kept) == (labels[r.doc_id] == 1) for r in before if r.doc_id in labels]
    assert sum(judged) >= 0.95 * len(judged)

    top = {}
    for r in good:
        top[r.text] = max(top.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in unique) == sorted(top.values())

    sets = {r.doc_id: shingles(r.text) for r in unique}
    left = {r.doc_id for r in apart}

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return 100 * both >= 75 * len(sets[a] | sets[b]) and both > 0

    assert not any(alike(a, b) for a in left for b in left if a < b)
    for gone in set(sets) - left:
        assert any(alike(gone, b) for b in sets if b != gone)

    assert {r.doc_id for r in mixed} <= left
    assert max(collections.Counter(r.doc_id for r in mixed).values()) <= 3
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert abs(sum(size(r.text) for r in mixed) / sum(size(r.text) for r in apart) - 1) < 0.2

    tokens = collections.Counter()
    for r in packed:
        if r.start == 0:
            tokens[r.doc_id] += 1
    assert tokens == collections.Counter(r.doc_id for r in mixed)


def test_order_and_names():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["classify", "exact", "near", "mix", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_nothing_else_imports_the_package():
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in (root / "lotwise").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lotwise.llm" not in path.read_text(), path


def test_empty_documents(spark):
    docs = table(spark, FOLDER, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, FOLDER), "empty")
        assert docs.count() == 0
    assert json.dumps(docs.columns)
