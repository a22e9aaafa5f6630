"""URL filters as a sort-merge range join.

A url's host is reversed into a canonical key (www.example.com -> com.example.www.), so a rule's host, with all its
subdomains, is the interval of the keys that begin with its own. Urls and rules are cut into the same ranges of the
keys, a rule into every range that its interval meets. Each range is sorted and swept once, with a stack of the rules
whose intervals are open; the paths of the open rules are the inner prefixes, tried longest first.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import map_batches, record

RULES = "host string, path string, verdict string"
#: Ranges for each shuffle partition, and sampled urls for each range.
RANGES, SAMPLES = 4, 25
#: Characters of a key at which two ranges can part.
SPLIT_CHARS = 256
#: Characters that end a host, and a path.
_PARTS = r"(?s)^([^/?#]*)([^?#]*)"


def lower(col: Column) -> Column:
    """A-Z lower-cased."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(df: DataFrame, url_col: str = "url") -> DataFrame:
    """df with host (A-Z lower-cased) and path; a null url or one without :// has both empty."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)"))
    return df.withColumns({"host": F.coalesce(lower(F.regexp_extract(rest, _PARTS, 1)), F.lit("")), "path": F.coalesce(F.regexp_extract(rest, _PARTS, 2), F.lit(""))})


def host_key(host: Column) -> Column:
    """The labels from the last on, each with a dot behind it: a subdomain's key begins with its parent's."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULES)


class OpenRules:
    """The rules of one host, by path."""

    def __init__(self, key: str):
        self.key = key
        self.by_path: dict[str, tuple[str, str]] = {}
        self.sizes: list[int] = []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.by_path and len(path) not in self.sizes:
            self.sizes = sorted([*self.sizes, len(path)], reverse=True)
        have = self.by_path.get(path)
        if have is None or verdict < have[1]:  # equal rules: allow before block
            self.by_path[path] = (rule, verdict)

    def longest(self, path: str) -> tuple[str, str] | None:
        for n in self.sizes:
            if n <= len(path) and (found := self.by_path.get(path[:n])):
                return found
        return None


def _sweep(default: str):
    """Over rows sorted by (range, key, rules first): every url with the longest rule that is open and fits its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[OpenRules] = []
        now = None
        for batch in batches:
            at, names, verdicts = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("part", "key", "host", "path", "verdict"))
            for k, (part, key, host, path, verdict) in enumerate(zip(*columns, strict=True)):
                if part != now:
                    now, stack = part, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if verdict is not None:
                    if not stack or stack[-1].key != key:
                        stack.append(OpenRules(key))
                    stack[-1].add(path, host + path, verdict)
                    continue
                best = None
                for rules in reversed(stack):  # the longest host first, which wins among rules equally long
                    found = rules.longest(path)
                    if found and (best is None or len(found[0]) > len(best[0])):
                        best = found
                at.append(k)
                names.append(best and best[0])
                verdicts.append(best[1] if best else default)
            own = batch.take(pa.array(at, pa.int64()))
            yield record(id=own.column("id"), host=own.column("host"), path=own.column("path"), rule=pa.array(names, pa.string()), verdict=pa.array(verdicts, pa.string()))

    return run


def splits(points: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Where the ranges part: at most ranges - 1 (key, salt) of a sample of about SAMPLES for each range."""
    rows = points.count()
    some = points.sample(min(1.0, ranges * SAMPLES / rows), seed=1) if rows > ranges * SAMPLES else points
    got = sorted((r.key, r.salt) for r in some.select(F.substring("key", 1, SPLIT_CHARS).alias("key"), "salt").limit(4 * ranges * SAMPLES).collect())
    return sorted({got[len(got) * k // ranges] for k in range(1, ranges)}) if got else []


def apply_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every page: the longest rule that fits, else null and `default`.

    A rule (host, path, verdict) fits its host and its subdomains where the url's path begins with the rule's; of
    rules equally long the one on the longer host wins, then allow. Repeated pages are judged alike, null ids stay,
    an empty table gives no rows. Rules with a null host are ignored, null paths are empty, a null verdict is block.
    Urls of one host, or one url of many pages, are dealt over several ranges; only rows equal in id and url stay
    together. Long urls take their whole host and path along, nothing is cut.
    """
    spark = pages.sparkSession
    parsed = parse(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    points = parsed.select("id", "host", "path", host_key(F.col("host")).alias("key"), F.xxhash64("id", "url").alias("salt"))
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(splits(points, ranges))  # at most `ranges` short keys

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        for batch in batches:
            part = [bisect_right(edges, x) for x in zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist(), strict=True)]
            yield record(**{c: batch.column(c) for c in ("id", "host", "path", "key")}, part=pa.array(part, pa.int32()), verdict=pa.nulls(batch.num_rows, pa.string()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        for batch in batches:
            out = []
            for host, path, key, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "key", "verdict")), strict=True):
                last = bisect_left(edges, (key[:-1] + "/",))  # "/" follows ".": no key of the interval is beyond
                out += [(host, path, key, part, verdict) for part in range(bisect_left(edges, (key[:SPLIT_CHARS],)), last + 1)]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield record(**{c: pa.array(x, k) for c, x, k in zip(("host", "path", "key", "part", "verdict"), cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)})

    kind = points.schema["id"].dataType
    field = lambda n, t: T.StructField(n, t)
    row = T.StructType([field("id", kind), field("host", T.StringType()), field("path", T.StringType()), field("key", T.StringType()), field("part", T.IntegerType()), field("verdict", T.StringType())])
    kept = rules.where("host is not null").select(lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.coalesce("verdict", F.lit("block")).alias("verdict")).distinct()
    opened = map_batches(kept.withColumn("key", host_key(F.col("host"))), spread, "host string, path string, key string, part int, verdict string")
    both = map_batches(points, deal, row).unionByName(opened.withColumn("id", F.lit(None).cast(kind)))
    sorted_ = both.repartition("part").sortWithinPartitions("part", "key", F.col("verdict").asc_nulls_last())
    out = T.StructType([field("id", kind), field("host", T.StringType()), field("path", T.StringType()), field("rule", T.StringType()), field("verdict", T.StringType())])
    return map_batches(sorted_, _sweep(default), out).withColumnRenamed("id", id_col)
