import collections
import re

import pytest
from pyspark.sql import functions as F

from lotwise.llm import mixing
from lotwise.llm.mixing import curriculum, sizes, targets, training_rows, unit_schedule
from lotwise.llm.tables import cut


def rows():
    out = [(i, "w " * (i % 17 + 1), "b") for i in range(60)] + [(100 + i, "x y", "a") for i in range(10)]
    out += [(200 + i, "z " * 30, "c") for i in range(3)] + [(300, None, "a"), (301, "", None), (302, "q w e", None)]
    return out + [(5, "w " * 6, "b"), (None, "n n", "b"), (400, "", "d")]


def frame(spark, data):
    return spark.createDataFrame([(d, t, s, 1.0) for d, t, s in data],
                                 "doc_id long, text string, source string, position double")


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(data):
    per = collections.Counter()
    for _, text, source in data:
        per[source] += words(text)
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, total = {}, sum(per.values())
    while True:
        free = [s for s in names if s not in fixed]
        left, each = total - sum(fixed.values()), sum(weight[s] for s in free)
        now = {s: left * weight[s] / each for s in free}
        over = [s for s in free if now[s] > 3 * per[s]]
        if not over:
            return per, fixed | now
        fixed |= {s: 3.0 * per[s] for s in over}


def test_targets_match_repeated_sharing(spark):
    per, want = brute_targets(rows())
    got = {r.source: (r.source_size, r.target) for r in targets(sizes(frame(spark, rows()))).collect()}
    assert set(got) == set(want)
    for s in want:
        assert got[s] == (per[s], pytest.approx(want[s]))


def test_each_source_meets_its_target(spark):
    _, want = brute_targets(rows())
    sized = cut(sizes(frame(spark, rows())), "sizes")
    got = curriculum(sized).collect()
    assert len(got) == len(rows())
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == sum(p["words"] for p in r.passes)
        assert [p["position"] for p in r.passes] == sorted(p["position"] for p in r.passes)
    for s in want:
        assert abs(taken[s] - want[s]) <= 1
    again = curriculum(sized.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_positions_follow_the_schedule(spark):
    """Up to any time, each source has met the integral of its schedule."""
    data = [(i, "w " * 10, s) for i, s in enumerate("abc" * 400)]
    got = curriculum(cut(sizes(frame(spark, data)), "sizes")).collect()
    total = 12000
    for number, source in enumerate("abc"):
        (_, m0), (_, m1) = unit_schedule(mixing.SCHEDULES[number])
        own = [(p["position"], p["words"]) for r in got if r.source == source for p in r.passes]
        goal = next(r.target for r in got if r.source == source)
        for time in (0.1, 0.5, 0.9):
            met = sum(w for at, w in own if at < time * total)
            assert met == pytest.approx(goal * (m0 * time + (m1 - m0) * time * time / 2), abs=0.02 * goal)


def test_schedule_with_several_knots_inverts(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 1.0), (1.0, 1.0))
    unit = unit_schedule(knots)
    shares = [i / 50 for i in range(51)]
    found = spark.createDataFrame([(s,) for s in shares], "s double")
    for r in found.select("s", mixing.training_time(found.s, knots).alias("t")).collect():
        area = 0.0
        for (t0, m0), (t1, m1) in zip(unit, unit[1:]):
            end = min(max(r.t, t0), t1)
            at = m0 + (m1 - m0) * (end - t0) / (t1 - t0)
            area += (end - t0) * (m0 + at) / 2
        assert area == pytest.approx(r.s, abs=1e-9)


def test_training_rows_keep_columns_and_order(spark):
    docs = frame(spark, rows())
    got = training_rows(docs)
    assert got.columns == docs.columns
    found = collections.Counter(r.doc_id for r in got.collect())
    sized = curriculum(cut(sizes(docs), "sizes")).collect()
    want = collections.Counter()
    for r in sized:
        want[r.doc_id] += sum(p["words"] * 2 >= r.size for p in r.passes)
    assert found == +want


def test_training_rows_of_repeated_and_null_rows(spark):
    """Rows alike in id, source and size keep their own texts; rows alike in all columns keep their number."""
    data = [(1, "a b c d", "x"), (1, "e f g h", "x"), (1, "e f g h", "x"), (None, "i j k l", "x"),
            (None, None, "i j k l"), (2, "", "x"), (3, "m n o p", None), (3, "m n o p", None)]
    docs = (frame(spark, data).withColumn("row", F.lit("extra")).withColumn("position", F.lit(None).cast("long"))
            .withColumn("passes", F.array(F.lit(1))).withColumn("row_1", F.lit(5)))
    got = training_rows(docs)
    assert got.columns == docs.columns
    found = collections.Counter((r.doc_id, r.text, r.source, r["row"], r.position) for r in got.collect())
    sized = curriculum(cut(sizes(docs, carry=[F.col("text").alias("t")]), "sizes"), carry=["t"]).collect()
    want = collections.Counter()
    for r in sized:
        want[(r.doc_id, r.t, r.source, "extra", None)] += sum(p["words"] * 2 >= r.size for p in r.passes)
    assert sum(found.values()) == sum(want.values())
    assert {k[:3] for k in found} == {k[:3] for k in +want}
    assert [r.doc_id for r in training_rows(docs).collect()] == [r.doc_id for r in got.collect()]


def test_training_rows_move_texts_twice(spark):
    """One exchange by row hash under the join and one range exchange; the rest moves no text."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = training_rows(frame(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    exchanges = [line for line in plan.splitlines() if " Exchange " in line]
    ranges = [line for line in exchanges if "rangepartitioning" in line]
    by_row = [line for line in exchanges if "hashpartitioning(row_1" in line]
    assert len(ranges) == 1 and len(by_row) == 2


def test_no_python_and_empty(spark):
    sized = cut(sizes(frame(spark, rows())), "sizes")
    plan = curriculum(sized)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert curriculum(cut(sizes(frame(spark, [])), "sizes")).collect() == []
