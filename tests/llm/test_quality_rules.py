import random
import re

import numpy as np
import pytest

from lotwise.llm import quality_rules
from lotwise.llm.quality_rules import base_statistics, chi2_cdf, chi2_quantile, judge, robust_estimates
from lotwise.llm.tables import cut, table

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered))


def test_base_statistics_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c a b c", "a b c\n\na b c\n \n", "é# <x>\u00a0y|", "x " * 5000]
    texts += ["".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    texts += [r.text for r in table(spark, SMALL, "documents").select("text").collect()]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = {r.doc_id: tuple(r)[3:] for r in base_statistics(docs).collect()}
    for i, t in enumerate(texts):
        n_words, word_chars, n_symbols, n_dup, n_repeat = brute(t)
        assert got[i] == (n_words, word_chars, n_symbols, n_dup, n_repeat)


def test_chi_square():
    assert chi2_cdf(5.991464547, 2) == pytest.approx(0.95)
    assert chi2_quantile(0.95, 4) == pytest.approx(9.487729, abs=1e-5)
    assert chi2_cdf(12.591587, 6) == pytest.approx(0.95, abs=1e-6)


def test_estimates_ignore_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(5)
    covariance = np.array([[1, .5, 0, 0], [.5, 2, 0, .3], [0, 0, 1, 0], [0, .3, 0, 1.5]])
    clean = rng.multivariate_normal([3, -1, 0, 5], covariance, 4000)
    bad = rng.normal([30, 30, 30, 30], 1, (1000, 4))
    points = spark.createDataFrame([("g", x.tolist()) for x in np.vstack([clean, bad])],
                                   "group string, x array<double>")
    got = robust_estimates(cut(points, "points"), floors=(1e-3,) * 4).first()
    factor = np.zeros((4, 4))
    factor[np.tril_indices(4)] = got.factor
    assert np.allclose(got.mean, [3, -1, 0, 5], atol=0.15)
    assert np.allclose(factor @ factor.T, covariance, atol=0.3)


def test_verdicts_on_the_table(spark):
    docs = table(spark, SMALL, "documents")
    got = judge(docs).collect()
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    clean = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(junk) <= 0.2 * len(junk)
    assert all(not r.kept for r in got if r.base_failed)
    assert len(got) == docs.count()


def test_groups_nulls_and_repeats(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = lambda: " ".join(word() for _ in range(80))
    rows = [(i, clean(), lang, source) for i, (lang, source) in enumerate(
        [("en", "big")] * 60 + [(None, None)] * 60 + [("en", f"small{k}") for k in range(60)] + [("xx", "few")] * 3)]
    rows += [(500, " ".join(w + "***" for w in clean().split()), "en", "big"), (None, None, "en", "big"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = judge(docs).collect()
    assert len(got) == len(rows)
    verdict = {r.doc_id: r.kept for r in got}
    assert not verdict[500] and not verdict[None]
    assert all(v for k, v in verdict.items() if k not in (500, None))
    groups = {r.doc_id: r.group for r in got}
    assert groups[0] == '["en","big"]' and groups[60] == "[null,null]" and groups[120] == '["en"]'
    assert groups[180] is None
    assert judge(docs.where("false")).collect() == []


def test_plan_has_no_python(spark):
    plan = base_statistics(table(spark, SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality_rules.DIMENSIONS == len(quality_rules.FLOORS) == len(quality_rules.vector())


def test_copies_of_one_junk_text_in_a_third_of_a_group_go(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    clean = lambda: " ".join(word() for _ in range(rng.randint(60, 200)))
    texts = [clean() for _ in range(100)]
    junk = " ".join(word() + ("***" if k % 2 else "") for k in range(80))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts + [junk] * 50)]
    got = {r.doc_id: r.kept for r in judge(spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(100))
    assert not any(got[i] for i in range(100, 150))
