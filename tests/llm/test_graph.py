import random

from leafwork.llm.graph import components


def test_components_of_paths_stars_and_cliques(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(100)] + [(i, j) for i in range(2000, 2015) for j in range(i)
             if j >= 2000] + [(5000, 5000), (-3, -9), (None, 4)]
    rng.shuffle(links)
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    got = {r.node: r.root for r in components(spark.createDataFrame(links + links[:20], "a long, b long")).collect()}
    want = [set(range(201)), set(range(1000, 1101)), set(range(2000, 2015)), {-3, -9}]
    assert set(got) == set().union(*want)
    assert all(len({got[x] for x in group}) == 1 and got[next(iter(group))] in group for group in want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
