"""Conversation structure repair: the cheapest edits that make a conversation's roles a sentence of a weighted grammar.

An error-correcting Earley parser reads the role initials of a conversation's turns. Beside the grammar's own productions
there are weighted ones: a turn may be deleted, a turn may get another role, and a turn without text may be inserted. A chart
item is a rule, a place in it and where it began; it keeps its least (cost, audit), the audit being the edits so far. The
completed chart gives the repair.

The grammar is left-recursive and its optional head is a rule of its own, so every item begins at 0 and each chart set is of
fixed size: time grows with the number of turns. Chart sets without waiting items are dropped, and so are items that are
too dear to win. What all items of a set have
decided alike is given away while the conversation is still being read, with the turns it decides, so a conversation of any
length passes through a task by a window of turns; only its audit, a letter a turn, stays.

A conversation is sorted by Spark and read in one task, since its parse and the digest of its repaired text are sequential.
Which turns repeat an earlier one is found by a window in the same partition.

Defined cases: a null role or text counts as one space; turns without a number come first; turns of one number by role, then by
text; null conversation ids are one conversation; no rows of a conversation left: no edits and an empty text; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import slices, table

#: Productions of `(s?(ua)+)?` over role initials; small letters are terminals.
GRAMMAR = [("S", ""), ("S", "B"), ("B", "Hua"), ("B", "Bua"), ("H", ""), ("H", "s")]
#: Roles that a turn may be given or that may be inserted, by their terminal.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: From wherever the cheapest item stands, the edits that any other item goes on with cost at most two insertions and a deletion more.
SLACK = 2 * INSERT + DELETE
#: Adjacent initials that are in order.
LEGAL = {"su", "ua", "au"}
#: Turns between two looks at what all items have decided alike.
SETTLE_TURNS = 16
_BLANK = " \t\n\x0b\x0c\r"

Value = tuple[int, str]


class Parser:
    """Earley's algorithm with minimum (cost, audit) items. An edit is two characters: its initial, and the terminal that it gives."""

    def __init__(self, grammar: list[tuple[str, str]] = GRAMMAR, roles: dict[str, str] = ROLES, start: str = "S"):
        self.grammar, self.roles, self.start = grammar, roles, start
        self.at, self.waiting, self.items = 0, {}, {}
        self._close({(k, 0, 0): (0, "") for k, (left, _) in enumerate(grammar) if left == start})

    def _next(self, item: tuple[int, int, int]) -> str:
        return self.grammar[item[0]][1][item[1] : item[1] + 1]

    def _close(self, seeds: dict[tuple[int, int, int], Value]) -> None:
        """The chart set of the place `at`: predictions, insertions and completions until nothing gets better."""
        items: dict[tuple[int, int, int], Value] = {}
        here = self.waiting.setdefault(self.at, {})
        agenda = deque(seeds.items())
        while agenda:
            item, value = agenda.popleft()
            if item in items and items[item] <= value:
                continue
            items[item] = value
            rule, dot, origin = item
            left, right = self.grammar[rule]
            symbol = right[dot : dot + 1]
            if not symbol:  # complete
                for (r, d, o), (cost, audit) in self.waiting[origin].get(left, {}).items():
                    agenda.append(((r, d + 1, o), (cost + value[0], audit + value[1])))
            elif symbol.isupper():  # predict, and pass over what is already complete here
                here.setdefault(symbol, {})[item] = value
                for k, (name, body) in enumerate(self.grammar):
                    if name == symbol:
                        agenda.append(((k, 0, self.at), (0, "")))
                        if (done := items.get((k, len(body), self.at))) is not None:
                            agenda.append(((rule, dot + 1, origin), (value[0] + done[0], value[1] + done[1])))
            elif symbol in self.roles:
                agenda.append(((rule, dot + 1, origin), (value[0] + INSERT, value[1] + "I" + symbol)))
        if not here:
            del self.waiting[self.at]
        # what reads on: items before a terminal, and the whole; an item that is dearer than the slack can't win any more
        items = {item: v for item, v in items.items() if self._next(item).islower() or self._whole(item)}
        if all(origin == 0 for _, _, origin in items):
            least = min(cost for cost, _ in items.values())
            items = {item: v for item, v in items.items() if v[0] <= least + SLACK}
        self.items = items

    def _whole(self, item: tuple[int, int, int]) -> bool:
        return not self._next(item) and self.grammar[item[0]][0] == self.start and not item[2]

    def read(self, initial: str, deleted: bool, extra: int) -> None:
        """The next turn: kept, given another role, or deleted. extra: what it costs unless it is deleted."""
        seeds: dict[tuple[int, int, int], Value] = {}

        def offer(item: tuple[int, int, int], cost: int, audit: str) -> None:
            if item not in seeds or (cost, audit) < seeds[item]:
                seeds[item] = (cost, audit)

        for item, (cost, audit) in self.items.items():
            rule, dot, origin = item
            symbol = self._next(item)
            offer(item, cost + DELETE, audit + "D-")
            if symbol and not deleted:
                if symbol == initial:
                    offer((rule, dot + 1, origin), cost + extra, audit + "K" + symbol)
                if symbol in self.roles:
                    offer((rule, dot + 1, origin), cost + REROLE + extra, audit + "R" + symbol)
        self.at += 1
        self._close(seeds)

    def settle(self) -> str:
        """Takes away what the audits of all items begin with."""
        if any(origin for _, _, origin in self.items):
            return ""
        found = commonprefix([audit for _, audit in self.items.values()])
        found = found[: len(found) // 2 * 2]
        if found:
            self.items = {item: (cost, audit[len(found) :]) for item, (cost, audit) in self.items.items()}
        return found

    def end(self) -> Value:
        return min(v for item, v in self.items.items() if self._whole(item))


class Repair:
    """The repair of one conversation, turn by turn."""

    def __init__(self):
        self.parser, self.held, self.n, self.cost, self.audit = Parser(), deque(), 0, 0, []
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.turns, self.before, self.first, self.last = 0, 0, None, None, None

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> Iterator[tuple]:
        ink = text.rstrip(_BLANK)
        fault = "blank" if not ink else "duplicate" if duplicate else "truncated" if ink[-1] not in ".!?" else None
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.turns, self.last = self.turns + 1, turn
        self.held.append((turn, role, text, fault))
        self.parser.read(role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0)
        self.n += 1
        if self.n % SETTLE_TURNS == 0:
            yield from self._given(self.parser.settle())

    def _given(self, audit: str) -> Iterator[tuple]:
        """Edits (initial, role, text, turn, fault) in order; role and text are those after the edit."""
        for k in range(0, len(audit), 2):
            edit, symbol = audit[k], audit[k + 1]
            turn, role, text, fault = (None, None, "", None) if edit == "I" else self.held.popleft()
            self.audit.append(edit)
            yield edit, role if edit in "KD" else ROLES[symbol], text, turn, fault

    def end(self) -> Iterator[tuple]:
        self.cost, audit = self.parser.end()
        yield from self._given(audit)

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Conversations of a sorted partition; each is an iterator over its rows (turn, role, text, duplicate)."""
    rows = (r for part in slices(batches, "text") for r in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "duplicate"))))
    ahead = next(rows, None)

    def own(key) -> Iterator[tuple]:
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            row, ahead = ahead, next(rows, None)
            if row[2] is not None:  # else a mark that the conversation exists
                yield row[1:]

    while ahead is not None:
        yield ahead[0], own(ahead[0])


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string, turn long, fault string"


def _batches(rows: Iterator[tuple], schema: str, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    fields = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (x.split() for x in schema.split(", "))])
    held, filled = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(fields)], schema=fields)

    for row in rows:
        held.append(row)
        filled += size(row)
        if len(held) >= 1000 or filled > 4 << 20:
            yield out()
            held, filled = [], 0
    yield out()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv_id, turns in _read(batches):
            repair, digest, apart = Repair(), hashlib.sha256(), ""
            for edit, role, text, _, _ in _edits(repair, turns):
                if edit != "D":
                    digest.update(f"{apart}{role}:{text}".encode())
                    apart = "\n"
            yield conv_id, repair.gaps, *repair.faults.values(), repair.illegal, repair.cost, "".join(repair.audit), digest.hexdigest()

    yield from _batches(rows(), REPORT, lambda r: len(r[7]))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv_id, turns in _read(batches):
            repair, place = Repair(), 0
            for edit, role, text, turn, fault in _edits(repair, turns):
                yield conv_id, None if edit == "D" else place, edit, role, text, turn, fault
                place += edit != "D"

    yield from _batches(rows(), TURNS, lambda r: len(r[4]))


def _edits(repair: Repair, turns: Iterator[tuple]) -> Iterator[tuple]:
    for row in turns:
        yield from repair.add(*row)
    yield from repair.end()


def _sorted(turns: DataFrame) -> DataFrame:
    """Rows by conversation and turn; `duplicate` tells whether an earlier row has the role and text. A null role marks a conversation without rows."""
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("duplicate")]
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    dealt = turns.repartition("conv_id").withColumn("duplicate", F.row_number().over(same) > 1)
    return dealt.sortWithinPartitions("conv_id", *order)


def _plain(conversations: DataFrame) -> DataFrame:
    space = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """Turns after repair: (conv_id, place, edit, role, text, turn, fault). Deleted turns have no place; inserted ones no turn and an empty text."""
    return _sorted(_plain(conversations)).mapInArrow(_turns, TURNS)


def repair_report(turns: DataFrame) -> DataFrame:
    """A row a conversation: gaps, faults, illegal neighbours, cost, audit and the digest of its repaired text."""
    return _sorted(turns).mapInArrow(_report, REPORT)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32(`conv_id:turn`) % 20; a conversation whose rows are all dropped stays as a row with null role and text."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    plain = _plain(conversations).withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    gone = F.col("kind") == 0
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return plain.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), copies.alias("copy")).drop("copy")


def op12_earley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


#: DuckDB has no CRC-32: the table of the polynomial and one fold over the bytes stand in. States: 0 nothing, 1 head, 2 user, 3 assistant.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list((
    SELECT list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
  ) ORDER BY n) AS crc FROM range(256) AS r(n)
), c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS k,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS hx FROM conversations
), z AS (
  SELECT k, turn, role, text, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, [('0x' || substr(hx, (2 * i + 1)::BIGINT, 2))::BIGINT FOR i IN range(length(hx) // 2)]),
    lambda a, b: xor(t.crc[(xor(a, b) & 255) + 1], a >> 8))) % 20 AS kind FROM c, t
), d AS (
  SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM z WHERE kind <> 0
), r AS (
  SELECT k, turn, role, text, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), w AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS before,
    row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS seen, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink FROM r
), f AS (
  SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM w
), moves(state, symbol, becomes) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), filled(state, inserted, more, becomes) AS (
  VALUES (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3), (0, 'I', 3, 2), (1, 'I', 3, 2), (3, 'I', 3, 2), (2, 'I', 3, 3), (0, 'II', 6, 3), (1, 'II', 6, 3)
), paths AS (
  SELECT k, 0::BIGINT AS i, becomes AS state, struct_pack(cost := more, audit := inserted) AS best FROM (SELECT DISTINCT k FROM c), filled WHERE state = 0
  UNION ALL
  SELECT k, i, state, min(best) AS best FROM (
    SELECT p.k, f.i, filled.becomes AS state,
      struct_pack(cost := p.best.cost + e.cost + filled.more, audit := p.best.audit || e.edit || filled.inserted) AS best
    FROM paths AS p JOIN f ON f.k = p.k AND f.i = p.i + 1, LATERAL (
      SELECT 'D' AS edit, 4 AS cost, p.state AS to_state
      UNION ALL SELECT 'K', CASE WHEN f.fault IS NULL THEN 0 ELSE 3 END, m.becomes FROM moves AS m
        WHERE m.state = p.state AND m.symbol = f.initial AND coalesce(f.fault, '') NOT IN ('blank', 'duplicate')
      UNION ALL SELECT 'R', CASE WHEN f.fault IS NULL THEN 3 ELSE 6 END, m.becomes FROM moves AS m
        WHERE m.state = p.state AND m.symbol <> 's' AND coalesce(f.fault, '') NOT IN ('blank', 'duplicate')
    ) AS e JOIN filled ON filled.state = e.to_state
  ) GROUP BY k, i, state
), facts AS (
  SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY k
), ended AS (
  SELECT p.k, min(p.best) AS best FROM paths AS p LEFT JOIN facts USING (k) WHERE p.i = coalesce(n, 0) AND p.state IN (0, 3) GROUP BY p.k
), edits AS (
  SELECT k, unnest(range(1, length(best.audit) + 1)) AS j, best.audit AS audit FROM ended
), placed AS (
  SELECT k, j, audit[j] AS edit, j - length(replace(audit[1:j], 'I', '')) AS inserted, length(replace(audit[1:j], 'D', '')) AS place FROM edits
), joined AS (
  SELECT q.*, f.role, f.text, max((q.edit = 'K' AND q.place = 1 AND f.initial = 's')::INT) OVER (PARTITION BY q.k) AS head
  FROM placed AS q LEFT JOIN f ON f.k = q.k AND f.i = q.j - q.inserted AND q.edit <> 'I'
), texts AS (
  SELECT k, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS body
  FROM joined WHERE edit <> 'D' GROUP BY k
)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, ended.best.cost::BIGINT AS cost, ended.best.audit AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM c) AS ids JOIN ended USING (k) LEFT JOIN facts USING (k) LEFT JOIN texts USING (k)
"""
