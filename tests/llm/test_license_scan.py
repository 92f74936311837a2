import random
import re

import pytest

from lotwise.llm import license_rules as R
from lotwise.llm.license_scan import PHRASES, Rules, license_scan, normalise, op12_license_scan, outermost
from lotwise.llm.tables import table

SMALL = "/root/testdata/sf0.001"
ROWS = R.parse(R.RULES)


@pytest.fixture(scope="module")
def rules():
    return Rules(ROWS)


def sample(tree, rng):
    """A random string that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "SUBPATTERN":
            out += sample(arg[-1], rng)
        elif op == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += "".join(sample(inner, rng) for _ in range(rng.randint(low, min(int(high), low + 3))))
        elif op == "IN":
            kind, value = rng.choice(arg)
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "RANGE":
                out += chr(rng.randint(*value))
            else:
                out += {"CATEGORY_DIGIT": "7", "CATEGORY_WORD": "w", "CATEGORY_NOT_SPACE": "q"}[str(value)]
        else:
            raise AssertionError(op)
    return out


def test_every_rule_matches_its_samples_and_they_hold_its_keyword():
    rng = random.Random(1)
    assert len(ROWS) > 200 and {r[1] for r in ROWS} == set(R.KINDS)
    for label, kind, keyword, pattern in ROWS:
        for _ in range(30):
            text = sample(re._parser.parse(pattern), rng)
            assert keyword in text, (label, pattern, text)
            assert re.search(f"(?<= )(?:{pattern})(?= )", f" {text} "), (label, text)
            assert normalise(text.encode()) == f" {text} ", (label, text)


def test_keywords_drop_no_match(rules):
    rng = random.Random(2)
    for _ in range(300):
        parts = [sample(re._parser.parse(rng.choice(ROWS)[3]), rng) for _ in range(rng.randint(1, 4))]
        norm = f" {' x '.join(parts)} "
        every = {n for n, (_, _, _, p) in enumerate(rules.rules) if p.search(norm)}
        assert every <= set(rules.candidates(norm))


def test_outermost_equals_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        rows = []
        for n in range(rng.randint(0, 30)):
            begin = rng.randint(0, 30)
            end = begin + rng.randint(1, 12)
            rows.append((rng.randint(0, 3), begin - end, begin, n, end))
        rows.sort()
        want = [m for i, m in enumerate(rows)
                if not any(o[2] <= m[2] and o[4] >= m[4] for o in rows[:i])]
        assert outermost(rows) == want


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
    ("Released under the MIT License.", ["mit"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0-or-later"]),
    ("SPDX-License-Identifier: MIT-0", ["mit-0"]),
    ("see https://creativecommons.org/licenses/by-sa/4.0/", ["cc-by-sa"]),
    ("Neither the name of X nor the names of its contributors may be used to endorse or promote products",
     ["bsd-3-clause"]),
    ("the MIT licensee and gplx 3", []), ("", []), ("Copyright (c) 2019 X. All rights reserved.", ["copyright"] * 2),
])
def test_resolved_labels(rules, text, labels):
    assert [d[0] for d in rules.scan(normalise(text.encode()))[1]] == labels


def brute(text):
    """n_words and phrase places from the definition, over code points."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(label, i) for phrase, label in PHRASES for k in [phrase.split()]
              for i in range(len(words) - len(k) + 1) if words[i:i + len(k)] == k]
    at = [i for _, i in places]
    return (len(words), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for x, _ in places})))


def check(rows, got):
    want = [(i, *brute(t)) for i, t in rows]
    key = lambda r: str(r[:6])
    got = sorted((tuple(r) for r in got), key=key)
    assert [r[:6] for r in got] == sorted(want, key=key)
    for r in got:
        base, labels = set(r[5].split(",")) - {""}, [x for x in r[6].split(",") if x]
        assert base <= set(labels) and labels == sorted(set(labels))
        assert 0 <= r[7] <= 1 and (r[7] > 0) == bool(labels)


def test_query_equals_brute_force_on_whole_texts(spark):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = op12_license_scan(spark, SMALL).collect()
    check(docs, got)
    # every license line of the texts is found
    lines = {"the MIT License": "mit", "CC BY-NC 4.0": "cc-by-nc", "Apache License, Version 2.0": "apache-2.0",
             "Public License, version 3": "gpl-3.0"}
    by_id = {r.doc_id: r.labels.split(",") for r in got}
    for line, label in lines.items():
        assert all(label in by_id[i] for i, t in docs if line in (t or ""))


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "CC-BY cc by\ncc_by éCC BY cc, by"), (None, None), (3, "ALL rights  reserved!" * 2),
            (4, "cc by " * 20000), (4, "cc by " * 20000), (5, "İ ALL rights reserved ſ K"), (6, "x" * 200000)]
    frame = spark.createDataFrame([(i, t, "e", 0) for i, t in rows], "doc_id long, text string, label string, id int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    check(rows, op12_license_scan(spark, str(tmp_path)).collect())
    assert license_scan(frame.where("false")).collect() == []
