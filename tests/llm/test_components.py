"""Components of links: both ways give what union-find gives, and few links take few jobs and no rounds."""

import random

from sonoframe.llm import common


def expected(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def links_of(seed):
    r = random.Random(seed)
    chain = [(k + 1, k) for k in range(-3, 40)]
    star = [(1000, k) for k in range(1001, 1030)]
    return [*chain, *star, (7, 7), (-(1 << 63), (1 << 63) - 1), *((r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60))]


def test_both_ways_against_union_find(spark, monkeypatch):
    links = links_of(1)
    df = spark.createDataFrame(links, "a long, b long")
    for most in (common.NARROW_ROWS, 8):  # one task; rounds
        monkeypatch.setattr(common, "NARROW_ROWS", most)
        rows = common.components(df).collect()
        assert len(rows) == len({r.node for r in rows})
        assert {r.node: r.root for r in rows} == expected(links)


def test_few_links_take_few_jobs(spark):
    df = spark.createDataFrame(links_of(2), "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("few-links", "")
    try:
        common.components(df)
        jobs = len(context.statusTracker().getJobIdsForGroup("few-links"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs <= 4  # with rounds: about eight for each


def test_no_links(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
