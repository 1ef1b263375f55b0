"""Collocations against counts of all phrases, with windows, ranges, blobs and merges so small that all their seams are met."""

import re
from collections import Counter

import pytest

from sonoframe.llm import collocation
from tests.llm.conftest import LONG


def expected(rows, least, inside=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        own = counts.setdefault(lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        found = []
        for p, a in own.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and 100 * b >= inside * a and b >= least and p in (q[:2], q[1:]) for q, b in own.items()):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


TINY = {"window_bytes": 3000, "range_leaves": 200, "part_leaves": 7, "merge_leaves": 40, "sampled": 8}


@pytest.mark.parametrize("sizes", [{}, TINY])
def test_equals_counting_all_phrases(spark, documents, sizes):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").limit(60).collect()]
    found = collocation.mine(spark.createDataFrame(rows, "lang string, text string").repartition(3), 4, **sizes)
    assert sorted(map(tuple, found.collect())) == expected(rows, 4)


def leaves(part):
    trie = collocation.Trie([part], 1)
    found = trie.leaves()
    packed = collocation._unpack(collocation._pack(found[:3], found[3], trie.named))
    assert all((trie.named[x] == y).all() for x, y in zip(found[:3], packed))
    return Counter({tuple(map(int, x[:3])): int(x[3]) for x in zip(*packed)})


def test_windows_overlap_by_two_words():
    text = b"one two three four, five six\tseven  eight nine ten" * 20
    for size in (1, 5, 17, 100, 5000):
        parts = list(collocation.windows(text, size))
        assert b"".join(p[:n] for p, n in parts) == text
        assert sum((leaves(p) for p in parts), Counter()) == leaves((text, len(text)))


def test_equal_hashes_are_counted_again(spark, monkeypatch):
    seeds = []
    real = collocation._words

    def weak(seed, *sizes):
        seeds.append(seed)
        if seed > 11:
            return real(seed, *sizes)

        def kernel(batches):  # under the first seed two words of one language share a hash
            import pyarrow as pa

            for _ in batches:
                pass
            yield pa.RecordBatch.from_pylist([{"lang": "x", "word": w, "h1": 5, "n": 1} for w in "ab"], schema=collocation._WORDS)

        return kernel

    monkeypatch.setattr(collocation, "_words", weak)
    docs = spark.createDataFrame([("x", "a b a b a b")], "lang string, text string")
    assert [r.phrase for r in collocation.mine(docs, 2).orderBy("rank").collect()] == [r[2] for r in expected([("x", "a b a b a b")], 2)]
    assert seeds == [11, 12]


def test_large_products_are_exact(spark):
    a, left, right = 3_000_000_000_001, 3_000_000_000_007, 3_000_000_000_011
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(f"{collocation._score('a', 'l', 'r')} AS s").first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_edges(spark, edge, empty):
    rows = [(r.lang, r.text) for r in edge.collect()]
    assert sorted(map(tuple, collocation.mine(edge).collect())) == expected(rows, 10) and len(LONG) > 1_000_000
    assert collocation.mine(empty).count() == 0


def test_query_equals_its_sql(spark, duck, sf_dir):
    ours = sorted(map(tuple, collocation.op11_collocations(spark, sf_dir).collect()))
    assert ours == sorted(duck.sql("SELECT lang, rank, phrase, a, l, r, n, score FROM (" + collocation.ORACLE_SQL + ")").fetchall())
