"""Connected components against union-find."""
import random

from renewcast.llm.graph import components


def brute(edges):
    parent = {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {(x, top(x)) for e in edges for x in e}


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(7, k) for k in range(1000, 1100)]
    loose = [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(40)]
    edges = chain + star + loose + chain[:3] + [(5, 5)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["id"], r["label"]) for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_components_of_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
