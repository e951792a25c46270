"""Document fingerprints: a canonical exact digest.

Canonical form: NFKC, full Unicode case folding, NFKC again, white space runs as one
space and none at the ends.  The fingerprint is 128 bits of xxhash (two seeds) of it,
in hex.  Inside buckets of equal hashes canonical texts are compared byte by byte; if
texts that differ share a hash, the fingerprint gets their number in that bucket as a
suffix, so fingerprints are equal exactly if canonical texts are.

Only built-in functions are used: normalisation and folding are the ICU library's,
which Spark ships, called through the SQL function ``reflect``.

Defined cases: a null text is empty; equal texts have equal fingerprints; rows without
a doc_id come first in the order of documents; of rows with one doc_id the order is
that of their texts; one row alone is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes of bucket keys up to which they are broadcast to find the texts to compare.
BROADCAST_BYTES = 64 << 20
MAX_RANGES = 512
_WIDE = "".join(f"\\x{{{c:x}}}" for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_OTHER_SPACE = r"\t\n\x0B\f\r\x1c\x1d\x1e\x1f" + _WIDE


def _nfkc(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(plain), F.lit(True))
    # single plain spaces need no replacement, so only other runs are matched
    return F.trim(F.regexp_replace(_nfkc(folded), f"[ {_OTHER_SPACE}]{{2,}}|[{_OTHER_SPACE}]", " "))


def wide_hash(canon: Column, bits: int = 128) -> Column:
    """Hex of two xxhash64 values; fewer bits only to provoke collisions in tests."""
    if bits < 64:
        return F.lower(F.hex(F.pmod(F.xxhash64(canon), F.lit(1 << bits))))
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), canon)), 16, "0")))


def collisions(texts: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """(hash, canon, number) of different texts with one hash, from (hash, canon) rows; None if there are none.

    Buckets are found by counts of hashes alone.  Only texts of buckets with several
    rows are compared, as minimum and maximum with partial aggregation, so a bucket
    with a third of all rows sends a row for each task.
    """
    shared = texts.groupBy("hash").count().filter("count > 1").select("hash")
    shared = cut(shared)
    small = shared.count() * 48 <= broadcast_bytes
    rows = texts.join(F.broadcast(shared) if small else shared, "hash", "left_semi")
    odd = rows.groupBy("hash").agg(F.min("canon").alias("__a"), F.max("canon").alias("__z")).filter("__a != __z").select("hash")
    odd = cut(odd)
    if odd.isEmpty():
        return None
    different = texts.join(odd, "hash", "left_semi").distinct()
    return cut(different.withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("canon")) - 1))


def with_numbers(df: DataFrame, hash_col: str, canon_col: str, clashes: DataFrame | None) -> DataFrame:
    """``hash_col`` made unique for each canonical text."""
    if clashes is None:
        return df
    c = clashes.select(F.col("hash").alias("__hash"), F.col("canon").alias("__text"), "number")
    df = df.join(c, (F.col(hash_col) == F.col("__hash")) & (F.col(canon_col) == F.col("__text")), "left")
    return df.withColumn(hash_col, F.when(F.col("number") > 0, F.concat(hash_col, F.lit("-"), "number")).otherwise(F.col(hash_col))).drop("__hash", "__text", "number")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", bits: int = 128) -> DataFrame:
    """Add the fingerprint of a text column."""
    docs = docs.withColumn("__canon", canonical(F.col(text))).withColumn(out, wide_hash(F.col("__canon"), bits))
    clashes = collisions(docs.select(F.col(out).alias("hash"), F.col("__canon").alias("canon")))
    return with_numbers(docs, out, "__canon", clashes).drop("__canon")


def duplicate_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, first_id, copies): one row a document, first_id the smallest of its group."""
    rows = fingerprints(docs.select("doc_id", text), text).select("doc_id", "fingerprint")
    groups = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return rows.join(groups, "fingerprint").select("doc_id", "fingerprint", "first_id", "copies")


def _tree(col: Column, bounds: list[int], lo: int = 0) -> Column:
    """Number of bounds <= col, as nested comparisons of logarithmic depth."""
    if not bounds:
        return F.lit(lo)
    m = len(bounds) // 2
    return F.when(col < bounds[m], _tree(col, bounds[:m], lo)).otherwise(_tree(col, bounds[m + 1 :], lo + m + 1))


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Add next_<c> of the following document (by doc_id, then text; after the last: the first).

    Documents are dealt by ranges of doc_id, whose bounds are quantiles over all ids; a
    wide range is cut again evenly.  Each range also gets the first document
    of the range after it, so texts are shuffled once and nothing is joined.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(MAX_RANGES, parts)
    bounds = sorted({int(b) for b in docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(n + 1)], 0.2 / n)})
    inner = bounds[1:-1]
    cuts = -(-parts // n)
    rng = _tree(F.col("doc_id"), inner)
    if cuts > 1:
        edge = F.lit([*bounds[:1], *inner, *bounds[-1:]]) if bounds else F.lit([0, 0])
        low, high = F.element_at(edge, rng + 1), F.element_at(edge, rng + 2)
        within = F.least(F.lit(cuts - 1), F.floor((F.col("doc_id") - low) * cuts / F.greatest(F.lit(1), high - low)))
        rng = rng * cuts + within
    docs = docs.withColumn("__range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(rng).cast("long"))
    firsts = docs.groupBy("__range").agg(F.min("doc_id").alias("__first")).orderBy("__range").collect()  # one row a range
    before = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}
    real = docs.withColumn("__extra", F.lit(0))
    known = [i for i in before if i is not None]
    if known:
        pairs = [F.lit(x) for i in known for x in (i, before[i])]
        extra = docs.filter(F.col("doc_id").isin(known)).withColumn("__range", F.element_at(F.create_map(*pairs), F.col("doc_id")).cast("long")).withColumn("__extra", F.lit(1))
        real = real.unionByName(extra)
    if None in before:
        one = docs.filter(F.col("doc_id").isNull()).orderBy("text").limit(1)
        real = real.unionByName(one.withColumn("__range", F.lit(before[None]).cast("long")).withColumn("__extra", F.lit(1)))
    w = Window.partitionBy("__range").orderBy("__extra", "doc_id", "text")
    return real.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry}).filter("__extra = 0").drop("__extra", "__range")


def compare_with_edits(docs: DataFrame, bits: int = 128) -> DataFrame:
    """The fingerprints of (doc_id, text) rows, of their edited texts, and their likeness.

    An edited text has its last quarter replaced by the start of the next document.
    The digest is exact, so likeness is 1 for equal canonical texts and else 0.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = docs.withColumn("__canon", canonical(F.col("text"))).withColumn("fingerprint", wide_hash(F.col("__canon"), bits))
    clashes = collisions(hashed.select(F.col("fingerprint").alias("hash"), F.col("__canon").alias("canon")))
    rows = with_next(with_numbers(hashed, "fingerprint", "__canon", clashes).drop("__canon"), ["text", "fingerprint"])
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.withColumns({"n_chars": n.cast("long"), "__edited": edited}).withColumn("__canon", canonical(F.col("__edited")))
    rows = with_numbers(rows.withColumn("edited_fingerprint", wide_hash(F.col("__canon"), bits)), "edited_fingerprint", "__canon", clashes)
    same_edited = F.when(F.col("fingerprint") == F.col("edited_fingerprint"), (canonical(F.col("text")) == F.col("__canon")).cast("double")).otherwise(0.0)
    same_next = F.when(F.col("fingerprint") == F.col("next_fingerprint"), (canonical(F.col("text")) == canonical(F.col("next_text"))).cast("double")).otherwise(0.0)
    return rows.select("doc_id", "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", same_edited.alias("near_edited"), same_next.alias("near_next"))
