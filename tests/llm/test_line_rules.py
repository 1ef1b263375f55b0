"""Rules of line dedup that follow a line's length."""

import random

from sonoframe.llm import lines
from tests.llm.test_groups import distance


def test_edits_follow_length_and_keys_meet():
    assert [lines.edits_of(n, None) for n in (16, 31, 32, 63, 64, 128, 256, 1024)] == [1, 1, 2, 2, 3, 4, 5, 7]
    assert all(lines.edits_of(n, None) == lines.edits_of(lines.range_of(n), None) for n in range(16, 5000))
    rng = random.Random(4)
    near = 0
    for _ in range(4000):
        n = rng.choice((rng.randint(16, 300), 32 << rng.randint(0, 3)))
        a = [rng.choice("abcd") for _ in range(n + rng.randint(-3, 3))]
        b = a[:]
        for _ in range(rng.randint(1, 6)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 1)
        a, b = "".join(a), "".join(b)
        limit = lines.edits_of(min(len(a), len(b)), None)
        if a != b and min(len(a), len(b)) >= 16 and lines.within(a, b, limit):
            near += 1
            (i1, p1), (i2, p2) = lines.keys_of(a, None), lines.keys_of(b, None)
            assert (i1 | p1) & i2 or (i2 | p2) & i1
    assert near > 1500


def test_default_links_lines_with_a_word_or_digits_changed(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    stock = [" ".join(word() for _ in range(14)) for _ in range(6)]
    docs = {}
    for k in range(40):
        own = [" ".join(word() for _ in range(14)) for _ in range(8)]
        x = list(stock[k % 6])
        for p in rng.sample(range(len(x)), 2 if k >= 6 else 0):
            x[p] = "z"
        docs[k] = "\n".join([*own, "".join(x)])
    got = {r.doc_id: r.text for r in lines.deduplicate(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    first = {k % 6: docs[k].split("\n")[-1] for k in reversed(range(6))}
    for k, text in docs.items():
        assert distance(docs[k].split("\n")[-1], first[k % 6]) <= 2
        assert got[k] == (text if k < 6 else text.rsplit("\n", 1)[0])
