"""Conversation repair against all edit sequences of short conversations, an automaton for longer ones, and SQL."""

import hashlib
import itertools
import random
import re
from collections import Counter

from sonoframe.llm import repair

ROLES = ["user", "assistant", "system", "tool", "", "umpire"]
TEXTS = ["Yes.", "No", "", " \n", "Why?", "End! \t"]


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_edits(rows):
    """(cost, audit, turns) of the cheapest of all edit sequences, tried one by one."""
    marks = faults(rows)
    choices = []
    for (_, role, text), mark in zip(rows, marks):
        extra = 3 if mark == "truncated" else 0
        own = [(4, "D", None)]
        if mark not in ("blank", "duplicate"):
            own += [(extra, "K", (role, text)), (3 + extra, "R", ("user", text)), (3 + extra, "R", ("assistant", text))]
        choices.append(own)
    added = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    fill = [[(3, "I", (r, "")) for r in x] for x in added]
    best = None
    for own in itertools.product(*choices):
        for gaps in itertools.product(fill, repeat=len(rows) + 1):
            steps = [s for k, gap in enumerate(gaps) for s in [*gap, *own[k : k + 1]]]
            turns = [s[2] for s in steps if s[2]]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                found = (sum(s[0] for s in steps), "".join(s[1] for s in steps), turns)
                best = min(best, found) if best else found
    return best


def by_automaton(rows):
    marks = faults(rows)
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    fill = lambda states: _least([*states, *((moves[q, x], c + 3, a + "I") for q, c, a in states for x in "ua" if (q, x) in moves)])
    states = fill(fill([(0, 0, "")]))
    for (_, role, _), mark in zip(rows, marks):
        after, extra = [], 3 if mark == "truncated" else 0
        for q, c, a in states:
            after.append((q, c + 4, a + "D"))
            if mark not in ("blank", "duplicate"):
                after += [(moves[q, role[:1]], c + extra, a + "K")] if (q, role[:1]) in moves else []
                after += [(moves[q, x], c + 3 + extra, a + "R") for x in "ua" if (q, x) in moves]
        states = fill(fill(_least(after)))
    return min((c, a) for q, c, a in states if q in (0, 3))


def _least(states):
    best = {}
    for q, c, a in states:
        best[q] = min(best.get(q, (c, a)), (c, a))
    return [(q, *v) for q, v in best.items()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def report(spark, table):
    return {r.conv_id: r for r in repair.repair_report(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).collect()}


def test_equals_trying_all_edits(spark):
    rng = random.Random(2)
    made = {k: [(t, rng.choice(ROLES), rng.choice(TEXTS)) for t in range(rng.randint(1, 3))] for k in range(60)}
    found = report(spark, [(k, *r) for k, rows in made.items() for r in rows])
    for k, rows in made.items():
        cost, audit, turns = all_edits(ordered(rows))
        body = "\n".join(f"{r}:{t}" for r, t in turns)
        assert (found[k].cost, found[k].audit, found[k].repaired_sha256) == (cost, audit, hashlib.sha256(body.encode()).hexdigest()), rows


def test_longer_ones_equal_an_automaton_and_settle_while_read(spark):
    rng = random.Random(4)
    made = {}
    for k in range(30):
        made[k] = [(rng.choice([None, *range(90)]), rng.choice(ROLES[: rng.randint(2, 6)]), rng.choice(TEXTS) + "." * (k % 2) * t + str(t) * (t % 3 == 0)) for t in range(rng.randint(5, 120))]
    found = report(spark, [(k, *r) for k, rows in made.items() for r in rows])
    for k, rows in made.items():
        rows = ordered(rows)
        r = found[k]
        assert (r.cost, r.audit) == by_automaton(rows)
        marks = Counter(faults(rows))
        assert (r.blank, r.duplicate, r.truncated) == (marks["blank"], marks["duplicate"], marks["truncated"])
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        turns = {t for t, _, _ in rows if t is not None}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
    one = repair.Repair()
    for t in range(5000):
        list(one.add(t, ("user", "assistant")[t % 2], f"{t}.", False))
    assert len(one.held) <= repair.SETTLE_TURNS and len(one.parser.waiting) == 1 and all(len(a) <= 4 * repair.SETTLE_TURNS for _, a in one.parser.items.values())


def test_turns_and_digest_agree(spark):
    rng = random.Random(6)
    table = [(k % 7, t, rng.choice(ROLES), rng.choice(TEXTS) + str(t)) for k in range(7) for t in range(20)]
    turns = {}
    for r in repair.repaired_turns(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).collect():
        turns.setdefault(r.conv_id, []).append(r)
    for k, r in report(spark, table).items():
        kept = sorted((x for x in turns[k] if x.edit != "D"), key=lambda x: x.place)
        assert [x.place for x in kept] == list(range(len(kept)))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in kept).encode()).hexdigest() == r.repaired_sha256
        assert Counter(x.edit for x in turns[k]) == Counter(r.audit)


EDGES = [(1, 0, None, None), (1, None, "user", "Hi."), (None, 0, "user", "Hi."), (None, None, None, "x"), (2, 5, "assistant", "y" * 3_000_000), (2, 5, "assistant", "y" * 3_000_000), (3, -4, "System", "ü."), (3, 9, "user", ""), (1, None, "user", "Hi.")]


def test_query_equals_its_sql(spark, sf_dir, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    schema = "conv_id long, turn long, role string, text string"
    plain = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    many = spark.createDataFrame([*EDGES, *[(100 + k, t, "user", None) for k in range(40) for t in range(k % 3)]], schema)
    for n, rows in enumerate([plain.unionByName(many), many.where("false")]):
        rows.withColumns({c: F.lit("own") for c in ("duplicate", "kind", "copy", "fault")}).write.parquet(str(tmp_path / f"{n}/conversations.parquet"))
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/{n}/conversations.parquet/*.parquet'")
        key = lambda r: str(r)
        ours = sorted(map(tuple, repair.op12_earley(spark, str(tmp_path / str(n))).collect()), key=key)
        assert ours == sorted(con.sql(repair.ORACLE_SQL).fetchall(), key=key)
        assert {r[0] for r in ours} == {r[0] for r in rows.select("conv_id").distinct().collect()}
