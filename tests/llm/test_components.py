import random

import pytest

from lotwise.llm.components import components


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(5, 2), (2, 5), (5, 2)], [(i, i + 1) for i in range(40)], [(99 - i, 98 - i) for i in range(30)],
    [(0, i) for i in range(1, 200)], [(500, i) for i in range(1, 200)],
    [(random.Random(i).randrange(120), random.Random(-i - 1).randrange(120)) for i in range(80)]])
def test_matches_brute_force(spark, links):
    frame = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {x: r for x, r in brute([p for p in links if p[0] != p[1]]).items()}
    assert components(frame).count() == len(got)
