"""URL filters: rules of a host and a path, looked up in a sorted array of 64-bit digests.

A rule `host/path` fits its host and all subdomains where the path of the url starts with the rule's; the longest rule that
fits wins (of equally long ones that with the longer host). A url is judged by probes, one for each suffix of its host at a dot
that is as long as a host of the rules, and each length that a path has in rules of such a host: the probe's xxhash (64 bits) is searched in the sorted digests by
vectorised binary search, and what stands at all equal digests is compared as a full string, so a collision decides nothing.

The array is an Arrow file in the shared folder: digests, full strings and verdicts as columns. Spark hands the file to each
executor, whose workers map it into memory and share its pages. That is done up to `MOST_BYTES`, measured before anything is
gathered; a larger list stays in slices by digest, and the different probes are dealt to the same slices and looked up there.

Defined cases: a null url, or one without `://`, has an empty host and path, and no rule fits it; a port or user name is part
of the host, so no rule fits it by its name alone; a null rule, or one without a host or `/`, is left out; of rules that stand in a list repeatedly, block wins;
no rules, or a url that none fits: allow; repeated rows are judged alike; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import materialize, shared_dir, table, utf8

#: Bytes of rules that are mapped whole by every executor, and of a slice beyond.
MOST_BYTES, SLICE_BYTES = 32 << 20, 16 << 20
#: The rules of the query (fixed values).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

_ENTRIES = pa.schema([("digest", pa.uint64()), ("rule", pa.binary()), ("block", pa.bool_())])
VERDICTS = "page_id long, host string, path string, rule string, verdict string"


def digests(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))


class DigestArray:
    """Sorted digests with the full strings and verdicts behind them."""

    def __init__(self, entries: pa.Table, digest: Callable[[list[bytes]], np.ndarray] = digests):
        self.digest = digest
        found, self.rules, self.block = (c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in (entries.column(n) for n in _ENTRIES.names))
        self.sorted = found.to_numpy()

    @staticmethod
    def build(rules: list[tuple[bytes, bool]], digest: Callable[[list[bytes]], np.ndarray] = digests) -> pa.Table:
        """The columns of the array, sorted by digest. Of equal rules block wins."""
        verdicts: dict[bytes, bool] = {}
        for rule, block in rules:
            verdicts[rule] = verdicts.get(rule, False) or block
        found = digest(list(verdicts))
        order = np.argsort(found, kind="stable")
        columns = [pa.array(found), pa.array(list(verdicts), pa.binary()), pa.array(list(verdicts.values()), pa.bool_())]
        return pa.table(columns, schema=_ENTRIES).take(pa.array(order))

    def find(self, probes: list[bytes]) -> np.ndarray:
        """For each probe the place of the rule that equals it, or -1."""
        out = np.full(len(probes), -1)
        if not len(self.sorted) or not probes:
            return out
        wanted = self.digest(probes)
        low = np.searchsorted(self.sorted, wanted)
        some = np.flatnonzero(self.sorted[np.minimum(low, len(self.sorted) - 1)] == wanted)
        for k in some.tolist():  # a handful: what has a digest of the array
            at = int(low[k])
            while at < len(self.sorted) and self.sorted[at] == wanted[k]:
                if self.rules[at].as_py() == probes[k]:
                    out[k] = at
                    break
                at += 1
        return out


def mapped(name: str) -> DigestArray:
    """The array that Spark put beside this process, mapped into memory."""
    return DigestArray(pa.ipc.open_file(pa.memory_map(SparkFiles.get(name))).read_all())


def probes(host: bytes, path: bytes, shapes: dict[int, list[int]]) -> list[bytes]:
    """All strings that a rule for this url can be: longest first, of equally long ones the longer host first.

    shapes: for each length of a rule's host the lengths of the paths behind it, in bytes.
    """
    found, at, longest = [], len(host), max(shapes, default=0)
    while at >= 0 and len(host) - at <= longest:
        at = host.rfind(b".", 0, at)  # a suffix begins behind each dot, and at the host's begin
        n = len(host) - at - 1
        found += [(n + k, n, host[at + 1 :] + path[:k]) for k in shapes.get(n, ()) if k <= len(path)]
    return [p for _, _, p in sorted(found, key=lambda x: x[:2], reverse=True)]


def _best(open_array: Callable[[], DigestArray], shapes: dict[int, list[int]]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = open_array()
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                wanted, owner = [], []
                for k, (host, path) in enumerate(zip(utf8(part, "host"), utf8(part, "path"))):
                    own = probes(host, path, shapes)
                    wanted += own
                    owner += [k] * len(own)
                different = list(dict.fromkeys(wanted))
                place = dict(zip(different, array.find(different).tolist()))
                rule, verdict = [None] * part.num_rows, [None] * part.num_rows
                for k, probe in zip(owner, wanted):
                    if rule[k] is None and (at := place[probe]) >= 0:
                        rule[k], verdict[k] = probe.decode(), "block" if array.block[at].as_py() else "allow"
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*part.schema.names, "rule", "verdict"])

    return kernel


# --- lists that are too large for one array ----------------------------------------------------------------------


def _probe_rows(shapes: dict[int, list[int]]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = [(h, p, x) for h, p in zip(utf8(part, "host"), utf8(part, "path")) for x in probes(h, p, shapes)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.binary()) for i in range(3)], ["host", "path", "probe"])

    return kernel


def _look_up(key: tuple, rules: pa.Table, wanted: pa.Table) -> pa.Table:
    array = DigestArray(DigestArray.build(list(zip(rules.column("rule").to_pylist(), rules.column("block").to_pylist()))))
    at = array.find(wanted.column("probe").to_pylist())
    some = np.flatnonzero(at >= 0)
    return pa.table({"probe": wanted.column("probe").take(pa.array(some)), "verdict": pa.array(["block" if array.block[int(k)].as_py() else "allow" for k in at[some]], pa.string())})


def _judge_by_slices(places: DataFrame, rules: DataFrame, n_bytes: int, shapes: dict[int, list[int]], slice_bytes: int) -> DataFrame:
    """Rows (host, path, rule, verdict) of the different places that a rule fits: digests deal both sides to slices."""
    rows = materialize(places.mapInArrow(_probe_rows(shapes), "host binary, path binary, probe binary"), "probes")
    wanted = rows.select("probe").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("probe") + 16), F.lit(0))).first()[0]
    parts = F.lit(max(1, -(-max(size, n_bytes) // slice_bytes)))
    of = lambda c: F.pmod(F.xxhash64(c), parts).alias("slice")
    left, right = rules.select(F.col("rule").cast("binary").alias("rule"), "block").select(of("rule"), "rule", "block").groupBy("slice"), wanted.select(of("probe"), "probe").groupBy("slice")
    hits = left.cogroup(right).applyInArrow(_look_up, "probe binary, verdict string")
    rule = F.col("probe").cast("string")
    best = F.struct(F.octet_length("probe").alias("n"), F.octet_length(F.substring_index(rule, "/", 1)).alias("host"), rule.alias("rule"), "verdict")
    found = rows.join(hits, "probe").groupBy("host", "path").agg(F.max(best).alias("b"))
    return found.select(F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"), "b.rule", "b.verdict")


# --- the operator --------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands behind the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _ship(spark: SparkSession, rules: list[tuple[bytes, bool]]) -> str:
    """Writes the array to the shared folder and has Spark hand it to the executors, lost and new ones too."""
    name, out = f"rules-{uuid.uuid4().hex}.arrow", io.BytesIO()
    with pa.ipc.new_file(out, _ENTRIES) as writer:
        writer.write_table(DigestArray.build(rules))
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{shared_dir(spark)}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    stream, data = system.create(path), out.getbuffer()
    for a in range(0, len(data), 1 << 20):
        stream.write(bytearray(data[a : a + (1 << 20)]))
    stream.close()
    system.deleteOnExit(path)
    spark.sparkContext.addFile(path.toString())
    return name


def judge(pages: DataFrame, rules: DataFrame, most_bytes: int = MOST_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for pages (page_id, url) under rules (rule, verdict: block or allow)."""
    spark = pages.sparkSession
    rules = rules.where("instr(rule, '/') > 1").select("rule", (F.col("verdict") == "block").alias("block")).groupBy("rule").agg(F.max("block").alias("block"))
    host_bytes = F.octet_length(F.substring_index("rule", "/", 1)).alias("host")
    shapes: dict[int, list[int]] = {}
    for r in rules.select(host_bytes, (F.octet_length("rule") - host_bytes).alias("path")).distinct().collect():  # lengths alone
        shapes.setdefault(r.host, []).append(r.path)
    n_bytes = rules.agg(F.coalesce(F.sum(F.octet_length("rule") + 16), F.lit(0))).first()[0]
    placed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if n_bytes <= most_bytes:
        name = _ship(spark, [(r.rule.encode(), r.block) for r in rules.toLocalIterator()])
        judged = placed.mapInArrow(_best(lambda: mapped(name), shapes), VERDICTS)
    else:
        found = _judge_by_slices(placed.select("host", "path").distinct(), rules, n_bytes, shapes, slice_bytes)
        judged = placed.join(found, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op13_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), h AS (
  SELECT row_number() OVER () AS k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM q
), rules(rule, domain, start, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), best AS (
  SELECT h.k, max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) AS b
  FROM h JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start) GROUP BY h.k
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM h LEFT JOIN best USING (k)
"""
