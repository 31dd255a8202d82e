"""URL filters as a sort-merge range join.

A rule (host, path) fits its host and every subdomain of it, if the url's path starts with the
rule's path. Hosts become reversed-label keys in which each label ends with U+0000, so a rule's
subtree of hosts is one contiguous interval of keys and two intervals are either nested or apart.
Urls and rules are dealt to key ranges, sorted there, and one sweep per range keeps a stack of
the active rule hosts; every url then only looks at the paths of the hosts on the stack.

Ranges are cut at (key, hash of the id and url), so one host, or even one url, that holds a third of
all rows is spread over several ranges. A rule goes to each range that its interval meets: to one
range, or, if the interval holds cut points, to those ranges as well. Memory of a sweep: the stack,
that is the rules along one host's labels.

Defined results: null url, or one without ``://``: host and path empty, no rule, default verdict.
Of several fitting rules the longest (host and path together) wins, then the longer host, then
block. Repeated urls keep their rows. No rules: default verdict everywhere. No urls: no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_SCHEMA = "host string, path string, verdict string"
#: Urls per cut point that the sample holds; the sample is bounded by this times the ranges.
SAMPLED_PER_RANGE = 64
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or holds no ``://``."""
    found = _PARTS.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def host_key(host: str) -> str:
    """Reversed labels, each ended by U+0000; U+0000 and U+0001 inside labels are escaped."""
    labels = host.replace("\x01", "\x01\x02").replace("\x00", "\x01\x01").split(".")
    return "".join(f"{label}\x00" for label in reversed(labels))


class RuleStack:
    """Active rule hosts of a sweep over ascending keys."""

    def __init__(self) -> None:
        self.levels: list[tuple[str, str, dict[str, str]]] = []

    def close(self, key: str) -> None:
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, host, {}))
        paths = self.levels[-1][2]
        paths[path] = "block" if "block" in (verdict, paths.get(path)) else verdict

    def best(self, key: str, path: str) -> tuple[str, str] | None:
        """Rule string and verdict of the longest rule that fits."""
        self.close(key)
        found = None
        for _, host, paths in self.levels:
            if len(paths) <= len(path) + 1:
                fits = (p for p in paths if path.startswith(p))
            else:
                fits = (path[:n] for n in range(len(path) + 1) if path[:n] in paths)
            longest = max(fits, key=len, default=None)
            if longest is not None and (found is None or (len(host) + len(longest), len(host)) >= found[0]):
                found = (len(host) + len(longest), len(host)), host + longest, paths[longest]
        return found and found[1:]


def cut_points(urls: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Ascending (key, salt) values that cut the urls into ranges of like size, from a bounded sample."""
    count = urls.count()
    if ranges < 2 or count == 0:
        return []
    share = SAMPLED_PER_RANGE * ranges / count
    sample = sorted((host_key(split_url(r.url)[0]), r.salt) for r in urls.filter(F.pmod("salt", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("url", "salt").toLocalIterator())
    step = len(sample) / ranges
    return sorted({sample[int(i * step)] for i in range(1, ranges)}) if sample else []


def _deal_urls(cuts: Sequence[tuple[str, int]], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            keys = [host_key(h) for h, _ in parts]
            at = [bisect_right(cuts, c) for c in zip(keys, batch.column("salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array([1] * len(at), pa.int32()), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.nulls(len(at), pa.string()), batch.column("id").cast(id_type)],
                names=["range_id", "key", "kind", "host", "path", "verdict", "id"],
            )

    return run


def _deal_rules(cuts: Sequence[tuple[str, int]], id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True):
                host = host.translate(_LOWER)
                key = host_key(host)
                first, last = bisect_left(cuts, (key,)), bisect_left(cuts, (key[:-1] + "\x01",))  # keys under the host
                out += [(at, key, 0, host, path, verdict) for at in range(first, last + 1)]
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.nulls(len(out), id_type)], names=["range_id", "key", "kind", "host", "path", "verdict", "id"])

    return run


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, RuleStack()
        for batch in batches:
            ids, hosts, paths, rules, verdicts = [], [], [], [], []
            id_column = batch.column("id")
            for i, (range_id, key, kind, host, path, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range_id", "key", "kind", "host", "path", "verdict")), strict=True)):
                if range_id != at:
                    at, stack = range_id, RuleStack()
                if kind == 0:
                    stack.add(key, host, path, verdict)
                    continue
                found = stack.best(key, path)
                ids.append(i)
                hosts.append(host)
                paths.append(path)
                rules.append(found and found[0])
                verdicts.append(found[1] if found else default)
            yield pa.RecordBatch.from_arrays([id_column.take(pa.array(ids, pa.int64())), *(pa.array(c, pa.string()) for c in (hosts, paths, rules, verdicts))], names=["id", "host", "path", "rule", "verdict"])

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``; see the module's text.

    ``rules`` has (host, path, verdict); rules with a null part are left out. ``ranges``: number of
    key ranges, by default the session's shuffle partitions.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_field = pages.schema[id_col]
    id_type, id_ddl = to_arrow_type(id_field.dataType), id_field.dataType.simpleString()
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("salt", F.xxhash64("id", "url"))
    cuts = cut_points(urls, ranges)
    ddl = f"range_id int, key string, kind int, host string, path string, verdict string, id {id_ddl}"
    dealt = urls.mapInArrow(_deal_urls(cuts, id_type), ddl).unionByName(rules.select("host", "path", "verdict").dropna().mapInArrow(_deal_rules(cuts, id_type), ddl))
    ordered = dealt.repartitionById(len(cuts) + 1, F.col("range_id")).sortWithinPartitions("range_id", "key", "kind")
    swept = ordered.mapInArrow(_sweep(default), f"id {id_ddl}, host string, path string, rule string, verdict string")
    return swept.withColumnRenamed("id", id_col)


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_SCHEMA)
