"""Operators over the corpus: line dedup, near-duplicates, mixing, packing, toxicity, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sonoframe.llm import lines, mixing, neardup, packing, toxicity
from tests.llm.conftest import CLASHES

# --- lines -------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_and_keys():
    rng = random.Random(1)
    many = defaultdict(list)
    for _ in range(20_000):
        limit, a = rng.randint(0, 3), [rng.choice("abc") for _ in range(rng.randint(1, 14))]
        b = a[:]
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
        a, b = "".join(a), "".join(b)
        d = distance(a, b)
        assert lines.within(a, b, limit) == (d <= limit)
        many[limit].append((a, b, d <= limit))
        if 0 < d <= limit < min(len(a), len(b)):
            (i1, p1), (i2, p2) = lines.keys_of(a, limit), lines.keys_of(b, limit)
            assert (i1 | p1) & i2 or (i2 | p2) & i1
    for limit, found in many.items():
        both = [x for a, b, _ in found for x in (a, b)]
        assert lines.within_many(both, [(2 * k, 2 * k + 1) for k in range(len(found))], limit).tolist() == [near for _, _, near in found]


def expected_lines(docs, max_edits=None, least_chars=16, least_docs=3, long_words=20, copy=0.8):
    occurrences = defaultdict(list)
    for doc_id, text in docs.items():
        for k, line in enumerate(text.split("\n")):
            if line.split():
                occurrences[" ".join(line.split())].append((doc_id, k))
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    long = [x for x in occurrences if len(x) >= least_chars]
    for i, a in enumerate(long):
        for b in long[:i]:
            limit = lines.edits_of(min(len(a), len(b)), max_edits)
            if abs(len(a) - len(b)) <= limit and lines.within(a, b, limit):
                parent[find(a)] = find(b)
    words = lambda i: len(docs[i].split())
    first_of = {}
    for i in sorted(docs):
        first_of.setdefault(docs[i], i)
    shared = Counter()
    for x, o in occurrences.items():
        source = min(i for i, _ in o)
        for i in {i for i, _ in o} - {source}:
            shared[i, source] += max(0, len(x.split()) - 4)
    most = lambda i: max(1, words(i) - 4)
    copies = set() if copy is None else {i for (i, j), n in shared.items() if n >= copy * (most(i) + most(j) - n)} | {i for i in docs if docs[i].strip() and first_of[docs[i]] != i}
    classes = defaultdict(list)
    for x, o in occurrences.items():
        classes[find(x)] += [(i, k, len(x.split())) for i, k in o]
    again, elsewhere = defaultdict(set), defaultdict(set)
    for o in classes.values():
        ids = sorted({i for i, _, _ in o})
        for i in ids:
            ks = sorted(k for j, k, _ in o if j == i)
            again[i] |= set(ks[1:])
            if len(ids) >= (2 if max(n for j, _, n in o if j == i) >= long_words else least_docs) and i != ids[0]:
                elsewhere[i].add(ks[0])
    gone = {i: again[i] | (set() if i in copies else elsewhere[i]) for i in docs}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs.items()}


@pytest.mark.parametrize("max_edits", [1, 2])
def test_lines_against_brute_force(spark, max_edits):
    rng = random.Random(max_edits)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    stock = [" ".join(word() for _ in range(rng.randint(2, 9))) for _ in range(12)]

    def varied():
        x = list(rng.choice(stock))
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(x))
            x[p] = rng.choice(("", x[p] + "x", "y"))
        return "".join(x)

    docs = {k: "\n".join(varied() if rng.random() < 0.4 else " ".join(word() for _ in range(6)) if rng.random() < 0.9 else "" for _ in range(8)) for k in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.deduplicate(df, max_edits=max_edits).collect()}
    assert got == expected_lines(docs, max_edits)


def brute_components(found, max_edits):
    group = lines.Group(found, max_edits)
    for i in range(len(found)):
        for j in range(i):
            if abs(len(found[i]) - len(found[j])) <= group.edits:
                group.compare(i, j)
    return {frozenset(k for k in range(len(found)) if group.root(k) == r) for r in map(group.root, range(len(found)))}


def settled(found, max_edits):
    group = lines.Group(found, max_edits)
    group.settle(list(range(len(found))), found)
    return {frozenset(k for k in range(len(found)) if group.root(k) == r) for r in map(group.root, range(len(found)))}, len(group.failed)


def test_groups_that_share_a_segment_split_exactly():
    rng = random.Random(6)
    for trial in range(30):
        digits = rng.choice((4, 7, 10))
        tail = lambda: "".join(rng.choice("0123456789"[: rng.choice((2, 10))]) for _ in range(digits))
        kind = trial % 3
        found = list({("the same head of a template line " + tail() if kind == 0 else tail() + " then the middle " + tail() + " and the end of it" if kind == 1 else tail()) for _ in range(120)})
        for edits in (1, 3, None):
            assert settled(found, edits)[0] == brute_components(found, edits)


@pytest.mark.parametrize("head, letters, low, high, edits", [("the same head of a template line ", "abcdefghij", 4, 4, None), ("the same head of a template line, and it is made somewhat longer by all of these words ", "abcdefgh", 0, 8, None), ("h ", "0123456789", 8, 9, 3)])
def test_large_groups_of_short_rests_end_and_are_exact(spark, head, letters, low, high, edits):
    rng = random.Random(1)
    found = sorted({head + "".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(300)})
    rows = spark.createDataFrame([(7, k, line, None) for k, line in enumerate(found)], "g long, node long, content string, rest string").repartition(4)
    links = [(r.a, r.b) for r in lines._group_links(rows, edits, 100).collect()]
    assert all(lines.within(found[a], found[b], lines.edits_of(min(len(found[a]), len(found[b])), edits)) for a, b in links)
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    classes = {}
    for k in range(len(found)):
        classes.setdefault(root(k), set()).add(k)
    assert set(map(frozenset, classes.values())) == brute_components(found, edits)


def test_ten_thousand_lines_that_share_a_segment(spark):
    import time

    rng = random.Random(8)
    heads = "a template of thirty-two letters: "
    found = [f"{heads}{rng.randrange(10**12):012d}" for _ in range(10_000)]
    found += [x[:-1] + "x" for x in found[:20]]
    began = time.time()
    components, tried = settled(found, None)
    assert time.time() - began < 60 and tried < 40 * len(found)
    where = {k: c for c in components for k in c}
    assert all(10_000 + k in where[k] for k in range(20))
    small = found[:300] + found[10_000:]
    rows = spark.createDataFrame([(k, k, x, None) for k, x in enumerate(small)], "g long, node long, content string, rest string").withColumn("g", __import__("pyspark").sql.functions.lit(5))
    links = lines._group_links(rows, None, 50).collect()  # a large group: split by shuffles
    parent = list(range(len(small)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[root(r.a)] = root(r.b)
    assert {frozenset(k for k in range(len(small)) if root(k) == r) for r in map(root, range(len(small)))} == brute_components(small, None)


def test_lines_query_and_edges(spark, sf_dir, edge, empty, texts):
    want = {i: zlib.crc32(t.encode()) for i, t in expected_lines(texts, copy=None).items()}  # no near-duplicate detection follows the query
    assert {r.doc_id: r.kept_crc32 for r in lines.op4_segment_join(spark, sf_dir).collect()} == want
    rows = lines.deduplicate(edge).collect()
    assert len(rows) == 8 and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert [r.text for r in rows if r.doc_id == 1] == ["one two three four five six seven\n"] and [r.text for r in rows if r.doc_id == 2] == [None]
    assert lines.deduplicate(empty).count() == 0 and lines.deduplicate(edge).columns == edge.columns


# --- near-duplicates ------------------------------------------------------------------------------------------------------


def runs_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_against_all_pairs(documents, texts):
    found = {r.doc_id: r for r in neardup.mark(documents).collect()}
    sets = {i: runs_of(t) for i, t in texts.items()}
    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            j = len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
            if j >= 0.85 or texts[a] == texts[b]:
                assert found[a].class_id == found[b].class_id
            elif j < 0.3:
                assert found[a].class_id != found[b].class_id or found[a].class_size > 2
    assert all(r.kept == (r.doc_id == r.class_id) for r in found.values())
    assert sum(r.kept for r in found.values()) == len({r.class_id for r in found.values()})


def linked(rows, vectors, threshold=0.8):
    """Components of all pairs of rows whose weighted Jaccard similarity reaches the threshold; equal texts are one."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or neardup.weighted_jaccard(vectors[i], vectors[j]) >= threshold:
                parent[find(i)] = find(j)
                pairs.append((i, j))
    return pairs, [find(i) for i in range(len(rows))]


def test_recall_against_exact_weighted_jaccard(spark, documents):
    """Links of all pairs against the classes: recall of 0.9 or more is required, and no class joins what no chain of links joins."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rng = random.Random(3)
    for k in range(12):  # groups whose members lie about the threshold
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for m in range(12):
            x = base[:]
            for _ in range(rng.randint(0, 6)):
                x[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
            rows.append((10_000 + 100 * k + m, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    common = neardup.common_runs(df)
    import pyarrow as pa

    runs, counts, first = neardup._runs(pa.array([t for _, t in rows], pa.string()))
    weights = np.exp(neardup._log_weights(runs, counts, common).astype(float))
    vectors = [(runs[a:b], weights[a:b]) for a, b in zip(first[:-1], first[1:])]
    pairs, root = linked(rows, vectors)
    found = {r.doc_id: r.class_id for r in neardup.mark(df).collect()}
    of = [found[i] for i, _ in rows]
    assert sum(of[i] == of[j] for i, j in pairs) >= 0.98 * len(pairs) > 200
    inside = defaultdict(set)
    for c, r in zip(of, root):
        inside[c].add(r)
    assert all(len(v) == 1 for v in inside.values())


def test_ids_on_several_texts_keep_one_row(spark):
    words = [f"w{k}" for k in range(100)]
    t, u = " ".join(words), " ".join([*words, "x"])
    df = spark.createDataFrame([(1, t, "a"), (1, u, "b"), (2, u, "c"), (1, t, "d"), (None, "other words stand here alone", "e")], "doc_id long, text string, row string")
    assert [r.class_size for r in neardup.mark(df).where("class_id = 1").collect()] == [4] * 4
    assert len({r.text for r in neardup.mark(df).where("kept").join(df, "doc_id").where("doc_id = 1").select("text").collect()}) <= 2
    kept = neardup.deduplicate(df).collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} == {1, None}
    assert {r.row for r in kept} == {r.row for r in neardup.deduplicate(df.repartition(3)).collect()}


def test_samples_collide_as_often_as_weights_are_alike():
    rng = np.random.default_rng(2)
    runs = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    a, b = rng.uniform(0.5, 4, 300), rng.uniform(0.5, 4, 300)
    both = np.concatenate([runs, runs])
    s = neardup.samples(both, np.log(np.concatenate([a, b])).astype(np.float32), np.array([0, 300, 600]), 3000)
    assert (s[:, 0] == s[:, 1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.03)


def test_common_runs_are_exact(spark):
    rows = [(k, f"this line is common to all {'and even more so here' if k % 2 else ''} w{k} x{k} y{k} z{k} v{k}") for k in range(400)]
    names, idf = neardup.common_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(names) and idf.min() == pytest.approx(1.0) and idf.max() <= 2.0


def test_runs_of_few_documents_count_in_full(spark):
    """In a table of fifteen, a run of one document is common (one in twenty or more); weighed as if it were not, a pair over the threshold falls under it."""
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(13)]
    same = [f"s{i}" for i in range(104)]  # 100 shared runs
    rows += [(20, " ".join([*same, *(f"a{i}" for i in range(11))])), (21, " ".join([*same, *(f"b{i}" for i in range(10))]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names, idf = neardup.common_runs(df)
    assert len(names) == len(set().union(*(runs_of(t) for _, t in rows))) and idf.max() == pytest.approx(1 + np.log(15) / np.log(20))
    assert {r.class_id for r in neardup.mark(df).where("doc_id >= 20").collect()} == {20}


def test_pairs_under_a_template_are_linked(spark):
    """Texts that share a template alone fill the buckets of pairs that are linked beside it; no centre is near, and each pair is found all the same."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for t in range(3):
        base, own = [word() for _ in range(400)], [word() for _ in range(60)]
        rows += [(1000 * t + k, " ".join([*base, *(word() for _ in range(38 + k % 5))])) for k in range(100)]
        rows += [(1000 * t + k, " ".join([*base, *own, *(word() for _ in range(20))])) for k in (500, 501)]
    found = {r.doc_id: r.class_id for r in neardup.mark(spark.createDataFrame(rows, "doc_id long, text string"), bands=4, rows=1).collect()}
    assert all(found[k] == (k - 1 if k % 1000 == 501 else k) for k in found)


def test_a_prefix_is_shared_by_texts_over_the_threshold():
    rng = np.random.default_rng(5)
    rarity = rng.integers(0, 9, neardup.RARITY)
    met = 0
    for _ in range(300):
        pool = rng.integers(0, 2**63, 60).astype(np.uint64)
        texts = [np.sort(rng.choice(pool, rng.integers(45, 60), replace=False)) for _ in range(2)]
        weights = {int(r): w for r, w in zip(pool, rng.uniform(1, 2, 60))}
        x, y = sorted(((r, np.array([weights[int(v)] for v in r])) for r in texts), key=lambda v: v[1].sum())
        if neardup.weighted_jaccard(x, y) >= 0.8:
            (some, n, _), (more, _, _) = (neardup.prefixes(*v, rarity, 0.8) for v in (x, y))
            met += 1
            assert set(some[:n].tolist()) & set(more.tolist())
    assert met > 30


def graded(n, seed=13):
    """Copies of one text, from hardly changed to changed in every third run or so: half of them fall short of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(n):
        x = base[:]
        for _ in range(rng.randint(1, 10)):
            x[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(x)))
    return rows


def test_copies_about_the_threshold_are_told_apart_without_their_texts(spark, monkeypatch):
    """Most pairs that fall short are ruled out in the join: comparisons stay a few for each text (2,369 here; 4,147 before masks and what is left of a text were looked at), and classes are those of all pairs."""
    import pyarrow as pa

    rows = graded(400)
    compared = []
    own = neardup._compare
    monkeypatch.setattr(neardup, "_compare", lambda pairs, *more: compared.append(pairs.count()) or own(pairs, *more))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in neardup.mark(df).collect()}
    runs, counts, first = neardup._runs(pa.array([t for _, t in rows]))
    weights = np.exp(neardup._log_weights(runs, counts, neardup.common_runs(df)).astype(float))
    _, root = linked(rows, [(runs[a:b], weights[a:b]) for a, b in zip(first[:-1], first[1:])])
    missed = sum(len({found[k] for k in range(400) if root[k] == r}) - 1 for r in set(root))
    assert all(len({root[k] for k in range(400) if found[k] == c}) == 1 for c in set(found.values())) and missed <= 8
    assert 400 < sum(compared) < 7 * 400


def test_masks_rule_out_no_pair_over_the_threshold(spark):
    import pyarrow as pa

    rows = graded(60)
    runs, counts, first = neardup._runs(pa.array([t for _, t in rows]))
    none = np.empty(0, np.uint64), np.empty(0)
    weights = np.exp(neardup._log_weights(runs, counts, none).astype(float))
    bits, totals = neardup.masks(runs, first, none), [float(weights[a:b].sum()) for a, b in zip(first[:-1], first[1:])]
    vectors = [(runs[a:b], weights[a:b]) for a, b in zip(first[:-1], first[1:])]
    pairs = [(i, j) for i in range(60) for j in range(i)]
    names = ["total", "left", *(f"m{k}" for k in range(neardup.MASK_WORDS))]
    facts = [[totals[i], totals[i], *map(int, bits[i])] for i in range(60)]
    kinds = ", ".join(f"{z}{n} {'double' if n in ('total', 'left') else 'long'}" for z in ("", "z_") for n in names)
    table = spark.createDataFrame([(i, j, *facts[i], *facts[j]) for i, j in pairs], "i int, j int, " + kinds)
    left = {(r.i, r.j) for r in table.where(neardup.may_be_near(0.8)).select("i", "j").collect()}
    near = {(i, j) for i, j in pairs if neardup.weighted_jaccard(vectors[i], vectors[j]) >= 0.8}
    assert 20 < len(near) and near <= left and len(left) < len(pairs) / 2


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(300):  # each differs from the first in a few words, so two of them differ more
        x = base[:]
        for _ in range(0 if k == 150 else 3):
            x[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(x)))
    rows += [(1000 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for k in range(20)]
    found = {r.doc_id: r.class_id for r in neardup.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[k] for k in range(300)} == {0} and all(found[k] == k for k in found if k >= 1000)


def test_near_duplicate_edges(edge, empty):
    found = neardup.mark(edge).collect()
    by_id = {r.doc_id: r.class_id for r in found}
    assert len(found) == 8 and by_id[1] == by_id[7] == 1 and by_id[2] == by_id[3] == 2 and by_id[None] is None
    kept = neardup.deduplicate(edge).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "5", "6", "None"] and all(r[c] == f"own {c}" for r in kept for c in CLASHES)
    assert neardup.mark(empty).count() == 0 and neardup.deduplicate(empty).columns == edge.columns


# --- mixing ------------------------------------------------------------------------------------------------------------------


def test_mixing(spark):
    rows = [(k, "w " * (5 + k % 7), None if k % 10 == 9 else "big" if k % 10 < 7 else "small" if k % 10 < 8 else f"s{k % 20}") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.copies(df, block_docs=50, target_entropy=0.97).toPandas()
    per = found.assign(taken=found.tokens * found.copies).groupby("src").agg(tokens=("tokens", "sum"), taken=("taken", "sum"), weight=("weight", "first"), repeats=("repeats", "first"))
    assert per.weight.sum() == pytest.approx(1) and per.repeats.max() <= 4 + 1e-6
    budget = per.tokens.sum()
    assert (abs(per.taken - per.weight * budget) <= 12).all()
    entropy = -(per.weight * np.log(per.weight)).sum() / math.log(len(per))
    p = per.tokens / budget
    best = max(a for a in np.linspace(0, 1, 4001) if (lambda w: -(w * np.log(w)).sum() / math.log(len(w)) >= 0.97 and (w * budget / per.tokens).max() <= 4)(p**a / (p**a).sum()))
    w = p**best / (p**best).sum()
    assert np.allclose(per.weight, w, atol=1e-3) and entropy == pytest.approx(0.97, abs=1e-3)
    out = mixing.mix(df, block_docs=50).groupBy("doc_id").count().collect()
    want = {i: c for i, c in zip(found.id, found.copies) if c}
    assert {r.doc_id: r["count"] for r in out} == want


def test_repetition_limit_comes_first(spark):
    df = spark.createDataFrame([(k, "w " * 10, "big") for k in range(990)] + [(1000 + k, "w " * 10, "rare") for k in range(10)], "doc_id long, text string, source string")
    found = mixing.copies(df, target_entropy=1.0, max_repeats=3.0).toPandas().groupby("src").repeats.first()
    assert found["rare"] == pytest.approx(3.0, abs=1e-3)


def test_mixing_edges(edge, empty):
    rows = mixing.copies(edge).collect()
    assert len(rows) == 8 and all(r.copies >= 0 for r in rows)
    assert mixing.mix(edge).columns == edge.columns and mixing.mix(empty).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_are_the_tokenizers(tokenizer, texts):
    import public_tokenizers

    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    some = [*list(texts.values())[:60], "", " ", "a b  c's \x01 x", "I'M don't 123 ÀÉ é ́x", "Σ ΑΣ.  x\x1cy\x85z", "x" * 100 + " <|endoftext|> !!", "a\x01b c", "日本 ǅ ŉ", "hello <|endoftext|> world", "a<|endoftext|>b<|startoftext|> c", "<|ENDOFTEXT|> é<|endoftext|>", "<|endoftext|", "<|endoftext|><|endoftext|> \x01"]
    for text, got in zip(some, ids.of([t.encode() for t in some])):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    words = list({w for t in texts.values() for w in t.encode().split()})
    assert ids.engine is not None and ids.compute(words) == ids._by_library(words)


def check_packing(rows, ids_of, size=4096):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc_id, own in pieces.items():
        ids = np.array(ids_of(doc_id), "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    filled = []
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
        filled.append(at)
    return filled


def test_packing(spark, documents, texts, tokenizer):
    rows = packing.pack(documents.repartition(3), open_windows=8).collect()
    filled = check_packing(rows, lambda i: [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2])
    assert sum(filled) / (4096 * len(filled)) > 0.9


def test_packing_edges(spark, empty, tokenizer):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "word " * 10_000, "z"), (4, "a " * 600_000, "z")], "doc_id long, text string, window string")
    known = {1: [2], 2: [2], 3: [*tokenizer.encode("word " * 10_000, add_special_tokens=False).ids, 2], 4: [*tokenizer.encode("a", add_special_tokens=False).ids * 600_000, 2]}
    check_packing(packing.pack(df).collect(), known.__getitem__)
    assert packing.pack(empty).count() == 0


def test_windows_are_bounded_and_best_fit():
    w = packing.Windows(0, 10, 2)
    assert [w.place(n) for n in (6, 7, 3, 4, 5, 9)] == [(0, 0, None), (1, 0, None), (1, 7, None), (0, 6, None), (2, 0, None), (3, 0, None)]
    assert w.place(6) == (4, 0, 3)


# --- toxicity --------------------------------------------------------------------------------------------------------------------


def test_transducers_compose():
    t = toxicity.grammar()
    state, seen = 0, []
    for c in (toxicity.REPORT, toxicity.NEGATION, toxicity.OTHER, toxicity.INSULT, toxicity.TARGET, toxicity.OTHER, toxicity.THREAT):
        seen.append(t.output[state][c])
        state = t.next_state[state][c]
    assert seen[3] == (1, 0, 1, 1) and seen[6] == (2, 1, 0, 1)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.op7_pattern_grammar(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    assert len(rows) == 1000 and rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(rows.doc_id, rows.held_out))
    held = both[both.held_out]
    good, bad = held[held.toxic == 0].score.to_numpy(), held[held.toxic == 1].score.to_numpy()
    assert (bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2 > 0.85
    assert (good >= 0.5).mean() < 0.03


def brute_score(model, text):
    """The grammar read clause by clause, without transducers."""
    import itertools

    counts, clauses, words, total, heaviest = Counter(), 0, 0, 0.0, 0.0
    tokens = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]+", (text or "").lower())
    for ends, clause in itertools.groupby(tokens, key=lambda w: w[0] in ".!?;:\n"):
        if ends:
            continue
        clause, weight = list(clause), 0.0
        kinds = []
        for w in clause:
            stems = [model.patterns.get(w[:n] + "*", 0.0) for n in range(1, len(w) + 1)]
            heavy = max([model.patterns.get(w, 0.0), *stems])
            kind = "i" if heavy > 0 else "t" if w in toxicity.THREATS else "n" if w in toxicity.NEGATIONS else "r" if w in toxicity.REPORTS else "y" if w in toxicity.TARGETS else ""
            kinds.append((kind, heavy if kind == "i" else model.threats.get(w, 1.0) if kind == "t" else 0.0))
        for k, (kind, w) in enumerate(kinds):
            if kind in ("i", "t"):
                before = [x for x, _ in kinds[:k]]
                counts[kind == "t", "y" in before, "n" in before[max(0, k - 3) :], "r" in before] += 1
                weight += w
        words += len(clause)
        total, heaviest, clauses = total + weight, max(heaviest, weight), clauses + (weight > 0)
    x = np.zeros(19)
    for (threat, targeted, negated, reported), n in counts.items():
        x[8 * threat + 4 * targeted + 2 * negated + reported] = math.log1p(n)
    x[16:] = heaviest, math.log1p(total), clauses / math.log(words + 2)
    z = x @ model.weights[:-1] + model.weights[-1]
    return 1 / (1 + math.exp(-max(-30, min(30, z)))), bool(counts)


def toxic_corpus(spark, rows):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    docs = []
    for k in range(rows):
        toxic = k % 2
        plain = [" ".join(word() for _ in range(8)) + "." for _ in range(4)]
        insult = rng.choice(("zorgel", "zorgels", "quaxing"))
        if toxic:
            plain.insert(2, f"you {word()} {insult} {word()}.")
            plain.insert(1, "you they will kill.")
        elif k % 3 == 0:
            plain.insert(2, f"{word()} not {insult} {word()}.")
        elif k % 33 == 1:
            plain.insert(2, f"{word()} said {word()} {insult}.")
        docs.append((k, " ".join(plain), toxic))
    return spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame([(k, 0, t) for k, _, t in docs], "doc_id long, quality int, toxic int"), docs


def test_scores_against_brute_force_and_contexts_count(spark):
    docs, labels, rows = toxic_corpus(spark, 900)
    toxicity_ratio, toxicity.LEAST_RATIO = toxicity.LEAST_RATIO, 2.0  # the words stand in clean documents too
    try:
        model = toxicity.fit(docs, labels)
        bare = toxicity.fit(docs, labels, contexts=False)
    finally:
        toxicity.LEAST_RATIO = toxicity_ratio
    held = [(t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert model.threats["kill"] > 1 and any(p.startswith("zorg") for p in model.patterns)
    got = model.score([t for t, _ in held])
    for (t, _), p in zip(held, got):
        want, matched = brute_score(model, t)
        assert not matched or p == pytest.approx(want)
    loss = lambda p: -np.mean([math.log(max(1e-9, q if y else 1 - q)) for q, (_, y) in zip(p, held)])
    insults = [(t.replace("you they will kill. ", ""), y) for t, y in held if any(w in t for w in ("zorgel", "quaxing"))]
    held = insults
    with_, without = model.score([t for t, _ in insults]), bare.score([t for t, _ in insults])
    assert loss(with_) < loss(without)


def test_toxicity_edges(spark, edge, empty, documents):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edge, labels)
    assert model.weights is None and {r.score for r in toxicity.score(edge, model).collect()} == {0.0}
    assert toxicity.keep_clean(edge, model).count() == 8
    learned = toxicity.fit(documents, spark.createDataFrame([(k, 0, int(k % 9 == 0)) for k in range(200)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(edge, learned).count() == 8 and toxicity.keep_clean(edge, learned).columns == edge.columns
    assert toxicity.score(empty, learned).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, documents, texts, tokenizer):
    import corpus_pipeline

    docs, inputs = documents, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append({(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()})
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == documents.columns and dict(docs.dtypes) == dict(documents.dtypes)
            from sonoframe.llm.common import materialize

            docs = materialize(docs, "test-stage")
    assert inputs[1] <= inputs[0] and {i for i, _ in inputs[2]} == {i for i, _ in inputs[1]} and inputs[3] <= inputs[2] and inputs[4] <= inputs[3]
    final = dict(inputs[4])
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(final)


def test_run_feeds_each_stage_with_what_the_one_before_kept(spark, sf_dir, documents, monkeypatch):
    import corpus_pipeline

    half = lambda s, docs, d: docs.where("doc_id % 2 = 0")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", half), ("b", lambda s, docs, d: docs.where("doc_id % 3 = 0")), ("c", lambda s, docs, d: docs.select("doc_id"))])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in documents.collect() if r.doc_id % 6 == 0}
