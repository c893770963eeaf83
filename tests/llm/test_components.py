"""Connected components against union-find."""

import random

from signet.llm.common import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    """No edges, self-edges, edges given twice, stars with the smallest and with the largest node as hub, random graphs."""
    draw = random.Random(5)
    cases = [[], [(3, 3)], [(1, 2), (2, 1), (1, 1)], [(9, i) for i in range(9)], [(0, i) for i in range(1, 9)], [(1, 3), (2, 3)]]
    cases.append([(draw.randrange(60), draw.randrange(60)) for _ in range(30)])
    for edges in cases:
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.root for r in got} == brute(edges)
