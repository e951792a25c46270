"""URL filter: a broadcast trie over reversed host labels and path segments.

A rule is ``(action, host, path)``.  It fits a url whose host is the rule's or a
subdomain of it and whose path starts with the rule's path.  Of several fitting
rules the longest wins: first by host labels, then by path characters; of an
allow and a block entry with the same host and path, block wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and
fits no rule but one for the empty host.  Empty rule lists give the default
verdict to every row.  Repeated rows are kept.  Input columns are kept unless an
output column has the same name; the output column then replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower

#: Bytes of rules up to which the trie is broadcast; beyond, rules are joined.
BROADCAST_BYTES = 64 << 20

Rule = tuple[str, str, str]
_END, _PARTS = 0, 1  # non-string keys of a trie node


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("1"))  # null url or no '://' -> null
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    hp = F.regexp_extract(after, r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(hp, r"(?s)^[^/]*", 0)
    path = F.substring(hp, F.length(host) + 1, F.length(hp))
    return F.coalesce(F.when(rest.isNotNull(), ascii_lower(host)), F.lit("")), F.coalesce(F.when(rest.isNotNull(), path), F.lit(""))


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested dicts: host labels from the right, then path segments.

    ``node[_PARTS]`` holds the path trie of a host; in it ``node[_END]`` maps the
    characters left after the last whole segment to (action, rule string).
    """
    root: dict = {}
    for action, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(_PARTS, {})
        *whole, rest = path.split("/")
        for part in whole:
            node = node.setdefault(part, {})
        ends = node.setdefault(_END, {})
        if rest not in ends or action == "block":
            ends[rest] = (action, f"{host}{path}")
    return root


def _best_path(node: dict, path: str) -> tuple[str, str] | None:
    best, parts = None, path.split("/")
    for i, part in enumerate(parts):
        if ends := node.get(_END):
            # what is left of the path, of which a rule may take any prefix
            left = "/".join(parts[i:])
            for n in sorted({len(e) for e in ends}, reverse=True):
                if n <= len(left) and (hit := ends.get(left[:n])):
                    best = hit
                    break
        if i == len(parts) - 1 or (node := node.get(part)) is None:
            break
    return best


def match(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """(action, rule string) of the longest fitting rule."""
    best, node = None, root
    for label in reversed(host.split(".")):
        if (node := node.get(label)) is None:
            break
        if _PARTS in node and (hit := _best_path(node[_PARTS], path)):
            best = hit  # a deeper host always beats a shallower one
    return best


def filter_urls(df: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add host, path, rule and verdict to every row.

    ``rules`` is a list, or a DataFrame (action, host, path), in which a null host or
    path is empty and rows without an action are no rules.  The size of a
    DataFrame is measured first: up to ``broadcast_bytes`` it becomes a broadcast
    trie, beyond that it is joined by its keys.
    """
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    if isinstance(rules, DataFrame):
        rules = rules.select("action", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).filter("action IS NOT NULL")
        n = rules.agg(F.sum(F.length("host") + F.length("path") + 200)).first()[0] or 0
        if n > broadcast_bytes:
            return _joined(df, rules, default)
        rules = [tuple(r) for r in rules.select("action", "host", "path").collect()]
    elif sum(len(h) + len(p) + 200 for _, h, p in rules) > broadcast_bytes:
        return _joined(df, df.sparkSession.createDataFrame(list(rules), "action string, host string, path string"), default)
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))
    schema = T.StructType([*df.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [match(trie.value, h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            names = pa.array([g and g[1] for g in got], pa.string())
            says = pa.array([g[0] if g else default for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, names, says], names=[*b.schema.names, "rule", "verdict"])

    return df.mapInArrow(judge, schema)


def _joined(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a join: each url gives a row per (host suffix, whole-segment path prefix)."""
    rule = rules.select(
        F.col("host").alias("__h"), F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("__p"), F.regexp_extract("path", r"(?s)[^/]*$", 0).alias("__rest"), "action", F.concat("host", "path").alias("rule")
    ).groupBy("__h", "__p", "__rest").agg(F.max("action").alias("__act"), F.first("rule").alias("rule"))  # 'block' > 'allow'
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split("path", "/")
    paths = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    keys = df.select("host", "path").distinct().select("host", "path", F.explode(hosts).alias("__h"), paths.alias("__ps")).select("host", "path", "__h", F.explode("__ps").alias("__p"))
    fits = keys.join(rule, ["__h", "__p"]).filter(F.col("path").startswith(F.concat("__p", "__rest")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "__act"), F.struct(F.length("__h"), F.length("rule"))).alias("__r"))
    out = df.join(best, ["host", "path"], "left")
    return out.select(*df.columns, F.col("__r.rule").alias("rule"), F.coalesce("__r.__act", F.lit(default)).alias("verdict"))
