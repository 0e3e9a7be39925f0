import random

from sensorloom.llm.components import components


def test_equals_union_find(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)]  # a long chain
    edges += [(500, i) for i in range(501, 560)] + [(rng.randint(600, 700), rng.randint(600, 700)) for _ in range(60)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges] + [(3, 4), (4, 3), (800, 800)]
    root = {n: n for pair in edges for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: find(n) for a, b in edges if a != b for n in (a, b)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
