import zlib

import numpy as np
import pytest

from lotwise.llm.quality_classifier import (dual_descent, feature_sets, fit, held_out, keep_good, log_ratios,
                                            op9_quality_classifier, score, train)
from lotwise.llm.tables import table

FOLDER = "/root/testdata/sf0.01"


def sets_of(texts):
    data = [t.encode() for t in texts]
    return feature_sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))


def test_features_do_not_depend_on_the_batch():
    texts = ["a b c d", "", "x", "  \n", "É!! *** a a a", "a b c d"]
    alone = [sets_of([t])[0].tolist() for t in texts]
    assert [s.tolist() for s in sets_of(texts)] == alone
    assert alone[1] == alone[3] == [0] and alone[0] == alone[5]


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    sets = [np.arange(3) for _ in range(60)]
    values = [rng.normal(size=3) for _ in range(60)]
    signs = np.array([1.0 if v[0] + 0.3 * rng.normal() > 0 else -1.0 for v in values])
    w = dual_descent(sets, values, signs, 3, cost=0.5, epochs=2000)

    def loss(w):
        return w @ w / 2 + 0.5 * sum(max(0, 1 - s * (w @ v)) for s, v in zip(signs, values))

    best = loss(w)
    assert all(best <= loss(w + rng.normal(size=3) * scale) + 1e-3 for scale in (1, .1, .01) for _ in range(200))


def test_ratios():
    sets = [np.array([0, 1]), np.array([0, 2])]
    ratio = log_ratios(sets, np.array([1, 0]), 4, 1.0)
    assert ratio[1] == pytest.approx(np.log(2)) and ratio[2] == pytest.approx(-np.log(2)) and ratio[3] == 0


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    got = op9_quality_classifier(spark, FOLDER).collect()
    assert len(got) == table(spark, FOLDER, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    own = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in own]) >= 0.97


def test_only_the_other_folds_are_learnt(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 5) = 0 "
                                "THEN 1 - quality ELSE quality END AS quality")
    one, two = train(docs, labels), train(docs, flipped)
    assert np.array_equal(one.weight, two.weight) and one.slope == two.slope


def test_nulls_empties_and_clashes(spark):
    docs = table(spark, FOLDER, "documents")
    model = train(docs, table(spark, FOLDER, "labels"))
    odd = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "x" * 100000, 0.5), (2, "x" * 100000, 0.5)],
                                "doc_id long, text string, score double")
    got = score(odd, model).collect()
    assert len(got) == 4 and got[0].score == got[1].score and got[2].score == got[3].score
    assert keep_good(odd, model).columns == odd.columns
    assert score(odd.where("false"), model).collect() == []
    assert odd.select(held_out()).collect()[1][0]


def test_without_labels(spark):
    docs = table(spark, FOLDER, "documents")
    labels = table(spark, FOLDER, "labels")
    assert {r.score for r in score(docs.limit(5), train(docs, labels.where("false"))).collect()} == {0.5}
    only = train(docs, labels.where("quality = 1"))
    assert all(r.predicted == 1 for r in score(docs.limit(5), only).collect())
    assert fit([], np.zeros(0)).slope == 0.0
