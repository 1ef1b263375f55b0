"""Operators that judge each text by itself: fertility, fingerprints, token counts, sharding."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from sonoframe.llm import fertility, fingerprint, sharding, viterbi
from tests.llm.conftest import LONG


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_fertility_counts(documents, texts):
    rows = fertility.judge(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_fertility_edges(edge, empty):
    rows = fertility.judge(edge).collect()
    assert len(rows) == 8 and sum(r.n_words for r in rows if r.doc_id == 6) == len(LONG.split())
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, None))
    assert fertility.judge(empty).count() == 0
    assert fertility.script("Привет, мир".encode()) == "cyrillic" and fertility.script(b"123") == "other"


def test_fertility_rejects_what_its_language_is_not(spark):
    import random

    rng = random.Random(3)
    vowels, consonants = "aeiou", "bdklmnrst"
    word = lambda: "".join(rng.choice(consonants) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    rows = [(k, " ".join(word() for _ in range(120)), "xx") for k in range(200)]
    rows += [(1000 + k, " ".join(word() + rng.choice(("%%%", "###", "$$$")) for _ in range(120)), "xx") for k in range(5)]
    rows += [(2000 + k, " ".join("".join(chr(rng.randint(0x2800, 0x28FF)) for _ in range(4)) for _ in range(120)), "xx") for k in range(5)]
    found = {r.doc_id: r.kept for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(found[k] for k in range(200)) >= 195
    assert not any(v for k, v in found.items() if k >= 1000)


def test_fingerprints(documents, texts):
    rows = {r.doc_id: r for r in fingerprint.fingerprints(documents).collect()}
    ids = sorted(texts)
    for doc_id, after in zip(ids, ids[1:] + ids[:1]):
        t, following, r = texts[doc_id], texts[after], rows[doc_id]
        edited = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.fingerprint(t) and r.edited_fingerprint == fingerprint.fingerprint(edited)
        assert r.near_edited == fingerprint.likeness(r.fingerprint, r.edited_fingerprint) and r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(following))
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.9 * len(rows)
    assert len({r.fingerprint for r in rows.values()}) == len(set(texts.values()))


def test_fingerprint_tree():
    text = "First one here. Second one there.\nA new line.\n\nAnother section, with more words. And an end."
    assert "".join(leaf for s in fingerprint.tree(text) for p in s for leaf in p) == text and len(fingerprint.tree(text)) == 2
    a, b = fingerprint.fingerprint(text), fingerprint.fingerprint(text.replace("new", "old"))
    assert fingerprint.edits(a, b) == [(34, 46, 34, 46)] and 0.5 < fingerprint.likeness(a, b) < 1 and fingerprint.likeness(a, a) == 1
    assert fingerprint.likeness(fingerprint.fingerprint(""), fingerprint.fingerprint(None)) == 1 and fingerprint.likeness(fingerprint.fingerprint(""), a) == 0


def test_fingerprint_edges(edge, empty):
    rows = fingerprint.fingerprints(edge).collect()
    assert len(rows) == 8 and {r.n_chars for r in rows if r.doc_id in (2, 3)} == {0}
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(edge.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_counts_equal_the_unigram_tokenizer(texts):
    import public_tokenizers
    from tokenizers import Tokenizer, models

    vocab = viterbi.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    low = min(s for _, s in vocab)
    exact = Tokenizer(models.Unigram([("<unk>", low), *vocab, *[(f"<0x{b:02X}>", low) for b in range(256)]], unk_id=0, byte_fallback=True))
    count = viterbi.Counter(vocab)
    some = [*list(texts.values())[:80], "", "a", " ", "a  b\n\n c", "日本語 ëx", "emoji 😀😀 x", "x" * 300, "▁▁ a", "end\n", "\n"]
    for text, (n, _) in zip(some, count.of([t.encode() for t in some])):
        assert n == (len(exact.encode("▁" + text.replace(" ", "▁")).ids) if text else 0), text[:60]


def test_count_ties():
    # "ab" + "c" and "a" + "bc" score alike: the piece that begins first at the end, "bc", stands; so both have two pieces, "abcd" one.
    count = viterbi.Counter([("a", -1.0), ("b", -1.0), ("c", -1.0), ("d", -1.0), ("ab", -2.0), ("abcd", -4.0)])
    assert count.segment("ab") == (1, 0) and count.segment("abcd") == (1, 0) and count.segment("abc") == (2, 0) and count.segment("aéb") == (4, 2)
    assert count.segments([b"ab", b"abcd", b"abc", "aéb".encode()]) == [(1, 0), (1, 0), (2, 0), (4, 2)]


def test_count_edges(edge, empty):
    rows = viterbi.count_tokens(edge).collect()
    assert len(rows) == 8 and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert next(r.n_tokens for r in rows if r.doc_id == 6) > 300_000
    assert viterbi.count_tokens(empty).count() == 0


def test_sharding(duck, spark, sf_dir, documents, texts):
    rows = sharding.shard(documents, block_rows=10).collect()
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and any(r.grown_shard == 8 for r in rows)
    sql = duck.sql(sharding.ORACLE_SQL).fetchall()
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in rows} == set(sql)


def test_sharding_weights_and_edges(spark, edge, empty):
    df = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    rows = sharding.shard(df, (1.0, 3.0, 0.0), (1.0, 3.0, 0.0, 4.0)).collect()
    shares = Counter(r.shard for r in rows)
    assert shares[2] == 0 and shares[1] / 4000 == pytest.approx(0.75, abs=0.03)
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {3} and len(moved) / 4000 == pytest.approx(0.5, abs=0.03)
    found = sharding.shard(edge).collect()
    assert len(found) == 8 and {r.size for r in found if r.doc_id in (2, 3)} == {1}
    assert sharding.shard(empty).count() == 0
