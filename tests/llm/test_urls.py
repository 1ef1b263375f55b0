"""URL rules against a brute-force reading of every rule, by one array and by slices, with forced collisions."""

import random

import numpy as np
import pytest

from sonoframe.llm import urls


def place(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, rest[cut:].split("?")[0].split("#")[0]


def expected(url, rules):
    host, path = place(url)
    fits = []
    for rule, verdict in rules:
        if rule and rule.find("/") > 0:
            own, start = rule.split("/", 1)
            if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
                fits.append((len(rule.encode()), len(own.encode()), rule, verdict == "block"))
    if not fits:
        return host, path, None, "allow"
    best = max(f[:3] for f in fits)
    return host, path, best[2], "block" if any(f[3] for f in fits if f[:3] == best) else "allow"


ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.Net/en/x", "http://example.net", "http://example.net/en", "http://example.net/EN/", "http://notexample.net.org/fr/", "http://a.b.example.com/de/?x=http://q",
       "http://net/", "http://.net/", "http://example.net:80/en/", "http://example.net/\nen/", "http://exämple.net/ü", "ftp://x.org?/fr/", "http://org/fr/#a", "x://y://example.net/en/", "http://" + "a." * 50_000 + "net/" + "x" * 100_000]


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_equals_every_rule_tried(spark, most_bytes):
    rng = random.Random(5)
    labels, parts = ["a", "b", "net", "org", "example", "ü"], ["", "en", "en/", "de/x", "ü/é"]
    rules = [*urls.RULES, (None, "block"), ("nothing", "block"), ("/x", "block"), ("a.net/", "allow"), ("a.net/", "block")]
    rules += [(".".join(rng.choices(labels, k=rng.randint(1, 3))) + "/" + rng.choice(parts), rng.choice(["block", "allow"])) for _ in range(60)]
    made = ["http://" + ".".join(rng.choices(labels, k=rng.randint(1, 4))) + rng.choice(["", "/"]) + rng.choice(parts) + rng.choice(["", "?q", "#f"]) for _ in range(400)]
    rows = [(k, u, "own") for k, u in enumerate([*ODD, *made, *made[:3]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    found = urls.judge(pages, spark.createDataFrame(rules, "rule string, verdict string"), most_bytes, slice_bytes=300).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == expected(rows[r.page_id][1], rules), rows[r.page_id][1]


def test_collisions_decide_nothing():
    weak = lambda keys: np.array([len(k) % 2 for k in keys], np.uint64)
    rules = [(f"host{k}.net/".encode(), k % 3 == 0) for k in range(50)]
    array = urls.DigestArray(urls.DigestArray.build(rules, weak), weak)
    wanted = [r for r, _ in rules] + [b"host50.net/", b"other", b""]
    at = array.find(wanted)
    assert [array.rules[int(k)].as_py() for k in at[:50]] == wanted[:50] and list(at[50:]) == [-1, -1, -1]
    assert [array.block[int(k)].as_py() for k in at[:50]] == [b for _, b in rules]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([], "rule string, verdict string")
    for most_bytes in (1 << 20, -1):
        assert [tuple(r) for r in urls.judge(pages, rules, most_bytes).collect()] == [(1, "a.net", "/", None, "allow")]
        assert urls.judge(pages.where("false"), rules, most_bytes).count() == 0


def test_query_equals_its_sql(spark, duck, sf_dir):
    ours = sorted(map(tuple, urls.op13_digest_array(spark, sf_dir).collect()))
    assert ours == sorted(duck.sql(urls.ORACLE_SQL).fetchall())
