"""Bands of groups that have few documents."""

import random

from sonoframe.llm import fertility


def test_thin_groups_are_judged_by_wider_ones(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdklmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    rows = [(k, " ".join(word() for _ in range(120)), f"l{k % 8}") for k in range(80)]
    rows += [(1000 + k, " ".join(word() + rng.choice(("%%%", "###", "$$$")) for _ in range(120)), f"l{k}") for k in range(3)]
    found = {r.doc_id: (r.base_failed, r.kept) for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(found[k][1] for k in range(80)) >= 77
    assert all(found[k] == (False, False) for k in (1000, 1001, 1002))
