"""Each operator applied, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, jaccard_join, license_scan, line_dedup, media, mixing, packing, toxicity, url_filter, warc
from .common import scratch, small_batches, stored

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    manifest = warc.write_archives(warc.mark_revisits(pages), scratch(spark, "warc"))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = media.text_payload(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.length("payload").cast("long").alias("n_bytes"), "payload")
    return media.summaries(stored(media.with_tensors(media.media_column(docs, "payload")), "media"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    slim = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), mixing.document_hash(F.col("doc_id")).alias("__h"))
    mixed = mixing.place(slim, mixing.WEIGHTS, mixing.SCHEDULES, mixing.MAX_REPEATS)
    return mixing.ordered(mixed).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_license": op2_license,
    "op3_fingerprint": op3_fingerprint,
    "op4_line_dedup": op4_line_dedup,
    "op5_jaccard": op5_jaccard,
    "op6_warc": op6_warc,
    "op7_media": op7_media,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
}

_PARTS = """
SELECT page_id,
       CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE translate(regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
       CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^/?#]*([^?#]*)', 1) END AS path
FROM pages
"""

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _license_sql() -> str:
    """Brute force: every block of every text against every template."""
    sets = [license_scan._template_words(t) for _, t in license_scan.TEMPLATES]
    longest = max(len(license_scan.re.findall(license_scan.WORD, t)) for _, t in license_scan.TEMPLATES)
    text = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda words: f"[{', '.join(map(text, words))}]::VARCHAR[]"
    values = ", ".join(f"({text(label)}, {listed(s)}, {listed([w for w in s if w in license_scan.TELLING])}, {listed(license_scan.AGAINST.get(label, ()))}, {license_scan.math.ceil(license_scan.THRESHOLD * len(s) - 1e-9)})" for (label, _), s in zip(license_scan.TEMPLATES, sets, strict=True))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, {text(label)} AS label FROM d, unnest(range(1, len(w) + 1)) AS r(i) WHERE w[i:i + {len(p.split()) - 1}] = [{', '.join(map(text, p.split()))}]" for p, label in license_scan.PHRASES.items()
    )
    return f"""
WITH d AS (SELECT doc_id, text, {_WORDS.format("text")} AS w FROM documents),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, list_sort(list_distinct(list(label))) AS l FROM ({phrases}) GROUP BY doc_id),
blocks AS (SELECT doc_id, w[s:s + {2 * longest - 1}] AS b FROM d, unnest(range(1, greatest(1, len(w) - {longest}) + 1, {longest})) AS r(s) WHERE len(w) > 0),
templates(label, words, telling, against, need) AS (VALUES {values}),
hits AS (SELECT doc_id, label, len(list_intersect(words, b)) / len(words) AS c FROM blocks, templates WHERE len(list_intersect(words, b)) >= need AND len(list_intersect(telling, b)) = len(telling) AND NOT list_has_any(against, b)),
found AS (SELECT doc_id, list(DISTINCT label) AS l, max(c) AS c FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.a::BIGINT AS first_word, base.z::BIGINT AS last_word,
       array_to_string(coalesce(base.l, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(found.l, [])))), ',') AS labels,
       greatest(coalesce(found.c, 0.0), CASE WHEN base.n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS l FROM d), unnest(l) AS u(sh)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""


_MIXING = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, 1 + k % 3 AS weight, 3 * source_size AS cap FROM s),
-- share what is left by weight; sources that reach their cap leave the sharing, until none is above
share(round, k, target, done) AS (
  SELECT 0, k, NULL::DOUBLE, false FROM w
  UNION ALL
  SELECT round + 1, k, CASE WHEN done THEN target WHEN lvl * weight >= cap THEN cap ELSE lvl * weight END, done OR lvl * weight >= cap
  FROM (SELECT share.*, weight, cap, (sum(source_size) OVER () - coalesce(sum(CASE WHEN done THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT done THEN weight END) OVER () AS lvl
        FROM share JOIN w USING (k)) WHERE round < 30),
goal AS (SELECT k, max(target) FILTER (WHERE round = 30) AS target FROM share GROUP BY k),
line AS (SELECT d.*, w.source_size, w.k, goal.target, floor(goal.target + 0.5)::BIGINT AS words,
                sum(size) OVER (PARTITION BY w.k ORDER BY h, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS pos
         FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN goal ON goal.k = w.k),
t AS (SELECT *, greatest(0, least(size, words - pos)) AS t0, greatest(0, least(size, words - pos - source_size)) AS t1, greatest(0, least(size, words - pos - 2 * source_size)) AS t2,
             CASE WHEN pos < words AND size > 0 THEN pos / target END AS u FROM line)
SELECT doc_id, size, source_size, target, (t0 + t1 + t2)::BIGINT AS taken,
       round(CASE k % 3 WHEN 0 THEN u WHEN 1 THEN -0.5 + sqrt(0.25 + 2 * u) ELSE 1.5 - sqrt(2.25 - 2 * u) END, 6) AS position
FROM t"""

ORACLE: dict[str, str] = {
    "op1_url_filter": f"""
WITH p AS ({_PARTS}), j AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op2_license": _license_sql(),
    "op5_jaccard": _JACCARD,
    "op9_mixing": _MIXING,
}
