"""Line dedup: near-equal lines found by MinHash, one line kept of each component.

Lines (trimmed and lower-cased for comparison) are sets of five-character shingles.
A one-permutation MinHash whose empty bins copy full ones drawn at random signs each different line; bands of the signature
give candidate pairs, exact Jaccard similarity verifies them, and distributed
union-find joins them to components.  Of all lines of a component, in all
documents, the first by (doc_id, line number) stays.

Each line of a bucket of equal bands is first paired with the bucket's first.  Of all other pairs of a bucket of at
most ``SMALL`` lines those are tested whose lines are then in different components.  In a larger one the lines outside
the largest component are compared with all others of the bucket, in blocks of sketches.  A block with no more agreeing
pairs than lines in them adds the pairs to those to be tested; else these lines are tested against each other, in blocks that
hold them once.  So no pair that shares a band is left out, but pairs whose sketches agree in too few bins and pairs of one
component are not verified.

Defined cases: blank lines are no candidates and stay; a line shorter than a shingle
is one shingle; null text stays null and has no lines; a document may be left with
an empty text, and is never dropped; rows repeated whole count as one document;
extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, dealt, gathered, mix64, part_count, restricted

SHINGLE = 5
SIMILARITY = 0.8
BINS, ROWS = 64, 4  # 16 bands of 4: a pair at 0.8 is missed about twice in 10,000
#: Bins of 63 with both bits equal from which a candidate pair is verified; at 0.8 about 54 are expected,
#: and 41 are 4.5 deviations less.  Short lines fill few bins, so their sketches vary more.
SKETCH_BINS, SHORT_BINS, SHORT = 41, 36, 150
CHARS = 1 << 20  # characters signed at once
PAIR_CHARS = 1 << 16  # characters of pairs that are verified at once
SMALL = 64  # lines of a bucket whose pairs are all candidates
BLOCK = 1024  # lines of a large bucket that are compared at once with as many others
BLOCK_CHARS = 1 << 19  # characters of a block from which it is cut further, unless it is one line
PAIRS_PER_PART = 64  # pairs of blocks in one part
CELLS = 1 << 22  # cells of a matrix of lines and shingles
PER_PART = 1 << 21  # band keys in one part
_EMPTY = np.uint32(0xFFFFFFFF)
#: The bins that an empty bin asks in turn, the same for all lines; the next full one after them.
_PROBES = (mix64(np.arange(1, 64 * BINS + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64).reshape(-1, BINS)


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, BINS) one-permutation MinHash values of 32 bits.

    An empty bin copies the first full one of its probes.  Bins drawn at random keep the values of a band
    independent; neighbours that all copy the next full bin would be one value, and short lines share it by chance.
    """
    lines = [s if len(s) >= SHINGLE else s.ljust(SHINGLE, "\0") for s in lines]
    n = np.array([len(s) for s in lines])
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = c[: len(c) - SHINGLE + 1] * np.uint32(0x9E3779B1)
    for k in range(1, SHINGLE):
        h += c[k : len(c) - SHINGLE + 1 + k]
        h *= np.uint32(0x85EBCA77 if k % 2 else 0x9E3779B1)
    # only shingles that end in their own line
    each = n - SHINGLE + 1
    line = np.repeat(np.arange(len(lines), dtype=np.int64), each)
    h = h[np.arange(len(line)) + line * (SHINGLE - 1)]
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    h ^= h >> np.uint32(16)
    line *= BINS
    line += (h >> np.uint32(16)) * np.uint32(BINS) >> np.uint32(16)
    sig = np.full(len(lines) * BINS, _EMPTY)
    np.minimum.at(sig, line, h)
    own, empty = sig.copy(), np.flatnonzero(sig == _EMPTY)
    for probe in _PROBES:
        place = empty % BINS
        sig[empty] = own[empty - place + probe[place]]
        empty = empty[sig[empty] == _EMPTY]
    sig = sig.reshape(-1, BINS)
    if len(empty):
        rows = np.unique(empty // BINS)
        twice = np.concatenate([sig[rows], sig[rows]], axis=1)
        at = np.minimum.accumulate(np.where(twice != _EMPTY, np.arange(2 * BINS), 4 * BINS)[:, ::-1], axis=1)[:, ::-1][:, :BINS]
        sig[rows] = np.take_along_axis(sig[rows], at % BINS, axis=1)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(lines, bands) keys of the signature's bands, two values mixed at a time."""
    wide = sig.astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BINS // ROWS + 1, dtype=np.uint64), (len(sig), BINS // ROWS))
    for r in range(0, ROWS, 2):
        out = mix64(out ^ (wide[:, r::ROWS] << np.uint64(32) | wide[:, r + 1 :: ROWS]))
    return out


def sketches(sig: np.ndarray, short: np.ndarray) -> np.ndarray:
    """(lines, 2) words of 64 bits: two bits of each of the first 63 bins' values, and whether the line is short."""
    words = []
    for shift, last in ((3, short), (7, 0)):
        bits = (sig[:, :64] >> np.uint32(shift) & np.uint32(1)).astype(np.uint8)
        bits[:, 63] = last
        words.append(np.packbits(bits, axis=1).view(np.uint64).ravel())
    return np.stack(words, axis=1)


def sketches_agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    flag = np.array([0] * 63 + [1], np.uint8)
    mask = np.packbits(flag).view(np.uint64)[0]
    x, more_x, y, more_y = x[..., 0], x[..., 1], y[..., 0], y[..., 1]
    least = np.where((x | y) & mask != 0, SHORT_BINS, SKETCH_BINS)
    return 63 - np.bitwise_count((x ^ y | more_x ^ more_y) & ~mask) >= least


def _line_ids(docs: DataFrame) -> DataFrame:
    """Add __lines (trimmed, lower-cased) and __ids (0 for blank lines)."""
    docs = docs.withColumn("__lines", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.lower(F.trim(s))))
    return docs.withColumn("__ids", F.transform("__lines", lambda s: F.when(s == "", F.lit(0)).otherwise(F.xxhash64(s))))


def _bands(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = {0}
        lines: list[str] = []
        ids: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sig, n = signatures(lines), BINS // ROWS
            keys = band_keys(sig).ravel()
            # within a part, 32 bits of a key are enough: a chance match is only a candidate more
            part, low = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            return dealt(part.astype(np.int64), [low, np.repeat(np.array(ids, np.int64), n), np.repeat(sketches(sig, np.array([len(s) < SHORT for s in lines])), n, axis=0)])

        for b in batches:
            for text, row in zip(b.column(0), b.column(1), strict=True):
                new = row.as_py()
                own = text.as_py()
                for s, i in zip(own, new, strict=True):
                    if i not in seen:
                        seen.add(i)
                        lines.append(s)
                        ids.append(i)
                        size += len(s)
                        if size >= CHARS:
                            yield flush()
                            lines, ids, size = [], [], 0
        if lines:
            yield flush()

    return docs.select("__lines", "__ids").mapInArrow(run, "part int, a0 binary, a1 binary, a2 binary")


def _pairs_of_part(key: tuple, table: pa.Table) -> pa.Table:
    """Candidate pairs in a part: each line with the first of its bucket, then the others of small buckets.

    The lines of large buckets follow, with their sketches, for ``_open_pairs``.
    """
    keys, ids, bits = gathered(table.column("a0"), "<u4"), gathered(table.column("a1"), "<i8"), gathered(table.column("a2"), "<u8").reshape(-1, 2)
    # one order in all buckets, so those of similar lines have the same first
    order = np.argsort(keys.astype(np.uint64) << np.uint64(32) | mix64(ids.view(np.uint64)) >> np.uint64(32))
    order = order[np.concatenate([[True], (keys[order[1:]] != keys[order[:-1]]) | (ids[order[1:]] != ids[order[:-1]])])[: len(order)]]  # lines that several tasks saw
    keys, ids, bits = keys[order], ids[order], bits[order]
    begin = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(begin)
    length = np.repeat(np.diff(np.concatenate([first, [len(keys)]])), np.diff(np.concatenate([first, [len(keys)]])))
    inner = np.flatnonzero(~begin)
    head = np.maximum.accumulate(np.where(begin, np.arange(len(ids)), 0))[inner]
    # places of ids in their order, so that a pair is one number, which sorts fast
    values, place = np.unique(ids, return_inverse=True)
    place = place.astype(np.uint64)

    def alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        same = sketches_agree(bits[p], bits[q])
        x, y = place[p[same]], place[q[same]]
        return _different((np.minimum(x, y) << np.uint64(32) | np.maximum(x, y))[x != y])

    heads = _different(alike(head, inner))
    i, codes = inner - 1, [heads[:0]]
    for k in range(1, SMALL):
        i = i[(length[i] <= SMALL) & (i + k < len(keys))]
        i = i[keys[i + k] == keys[i]]
        codes.append(alike(i, i + k))
    others = _different(np.concatenate(codes))
    others = others[~np.isin(others, heads)]
    code = np.concatenate([heads, others])
    pair = np.stack([values[code >> np.uint64(32)], values[code & np.uint64(0xFFFFFFFF)]], axis=1)
    large = np.flatnonzero(length > SMALL)
    bucket = (np.int64(key[0].as_py()) << np.int64(32)) | keys[large].astype(np.int64)
    none, zeros = pa.nulls(len(large), pa.int64()), pa.nulls(len(pair), pa.int64())
    columns = {"a": (pair[:, 0], none), "b": (pair[:, 1], none), "bucket": (zeros, bucket), "id": (zeros, ids[large]), "bits": (zeros, bits[large, 0].view(np.int64)), "more": (zeros, bits[large, 1].view(np.int64))}
    out = {c: pa.concat_arrays([pa.array(x, pa.int64()) for x in both]) for c, both in columns.items()}
    return pa.table(out | {"first": pa.array(np.arange(len(pair) + len(large)) < len(heads))})


def _different(a: np.ndarray) -> np.ndarray:
    """The different values in order; sorting alone is faster than ``np.unique`` with its places."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]]


def _shingle_codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(line, code) of each line's shingles and the bits of a code, without hashing: equal codes are equal shingles."""
    n = np.array([max(len(t), SHINGLE) for t in lines])
    text = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(n)
    begin = ends - n
    c = np.zeros(ends[-1], np.uint64)  # 0 fills lines shorter than a shingle
    used = np.zeros(int(text.max(initial=0)) + 1, bool)
    used[text] = True
    rank = np.cumsum(used).astype(np.uint64)  # from 1
    own = np.array([len(t) for t in lines])
    c[np.arange(len(text)) + np.repeat(begin - np.cumsum(own) + own, own)] = rank[text]
    each = n - SHINGLE + 1
    line = np.repeat(np.arange(len(lines)), each)
    at = np.arange(len(line)) + line * (SHINGLE - 1)
    width = int(rank[-1]).bit_length()
    code = c[at]
    if SHINGLE * width <= 64:
        for k in range(1, SHINGLE):
            code = code << np.uint64(width) | c[at + k]
        return line, code, SHINGLE * width
    # too many different letters for one number: pairs of letters are numbered first
    for k in range(1, SHINGLE):
        code = np.searchsorted(_different(code), code).astype(np.uint64) << np.uint64(32) | c[at + k]
    return line, code, 64


def _shingle_ids(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(line, shingle) numbers of each line's different shingles."""
    line, code, _ = _shingle_codes(lines)
    values = _different(code)
    both = _different(line * np.int64(len(values)) + np.searchsorted(values, code))
    return both // len(values), both % len(values)


def alike_pairs(x: list[str], y: list[str], similarity: float = SIMILARITY) -> np.ndarray:
    """Exact test of each line of x with the one of y at its place, as ``jaccard_at_least``."""
    if not x:
        return np.zeros(0, bool)
    line, code, bits = _shingle_codes(x + y)
    if bits + len(x).bit_length() > 64:
        values = _different(code)
        code, bits = np.searchsorted(values, code).astype(np.uint64), len(values).bit_length()
    bits = np.uint64(bits)
    of_y = np.searchsorted(line, len(x))
    key = (line % len(x)).astype(np.uint64) << bits | code
    p, q = _different(key[:of_y]), _different(key[of_y:])
    count = lambda keys: np.bincount((keys >> bits).astype(np.int64), minlength=len(x))
    key = np.sort(np.concatenate([p, q]))
    both = count(key[1:][key[1:] == key[:-1]])
    return both >= similarity * (count(p) + count(q) - both) - 1e-12


def alike_in_block(x: list[str], y: list[str], similarity: float = SIMILARITY) -> np.ndarray:
    """(len(x), len(y)) exact test of every line of x with every one of y, as ``jaccard_at_least``."""
    line, code = _shingle_ids(x + y)
    n = np.bincount(line, minlength=len(x) + len(y))
    cut_at = np.searchsorted(line, len(x))
    left, right = (np.bincount(c, minlength=code.max() + 1) for c in (code[:cut_at], code[cut_at:]))
    everywhere = left + right == len(x) + len(y)
    shared = np.flatnonzero((left > 0) & (right > 0) & ~everywhere)
    place = np.zeros(len(left), np.int64)
    place[shared] = np.arange(1, len(shared) + 1)
    column = place[code] - 1
    line, column = line[column >= 0], column[column >= 0]
    by_column = np.argsort(column, kind="stable")
    line, column = line[by_column], column[by_column]
    both = np.full((len(x), len(y)), everywhere.sum(), np.float32)
    width = max(1, CELLS // (len(x) + len(y)))
    for first in range(0, len(shared), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        m = np.zeros((len(x) + len(y), min(width, len(shared) - first)), np.float32)
        m[line[lo:hi], column[lo:hi] - first] = 1
        both += m[: len(x)] @ m[len(x) :].T
    union = n[: len(x), None] + n[None, len(x) :] - both.astype(np.float64)
    return both >= similarity * union - 1e-12


def _block_pairs(e: DataFrame, size: Column, fields: list[str]) -> DataFrame:
    """(bucket, e_, e): blocks of a bucket's lines outside its largest component, each with all its blocks.

    Buckets are cut into blocks by hash, so that a hot one is compared by many tasks.
    """
    sizes = cut(e.groupBy("bucket").agg(F.ceil(size).alias("blocks")))
    e = e.join(sizes, "bucket").withColumns({"in_main": F.col("root") == F.col("main"), "block": F.pmod(F.xxhash64("id"), "blocks")})
    blocks = cut(e.groupBy("bucket", "in_main", "block").agg(F.collect_list(F.struct(*fields)).alias("e")))
    outside = blocks.filter("NOT in_main").select("bucket", F.col("block").alias("block_"), F.col("e").alias("e_"))
    # the pairs of blocks are dealt anew, as one bucket may have many
    both = outside.join(blocks, "bucket").filter("in_main OR block_ <= block")
    parts = part_count(sizes.agg(F.coalesce(F.sum(F.col("blocks") * F.col("blocks")), F.lit(0))).first()[0], PAIRS_PER_PART, e)
    return both.repartition(parts, F.xxhash64("bucket", "in_main", "block", "block_")).select("bucket", "e_", "e")


def _open_blocks(left: pa.ListScalar, right: pa.ListScalar) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first place left, first place right, matrix): pairs of two components whose sketches agree, ``BLOCK`` lines at a time."""
    (r, v), (q, w) = (
        (f("root").to_numpy(), np.stack([f("bits").to_numpy(), f("more").to_numpy()], axis=1).view(np.uint64)) for f in (left.values.field, right.values.field)
    )
    for k in range(0, len(r), BLOCK):
        for j in range(0, len(q), BLOCK):
            yield k, j, sketches_agree(v[k : k + BLOCK, None], w[None, j : j + BLOCK]) & (r[k : k + BLOCK, None] != q[None, j : j + BLOCK])


def _open_lines(large: DataFrame, roots: DataFrame) -> DataFrame:
    """The lines (bucket, id, bits, more) of large buckets of several components, with root and the bucket's largest component, main."""
    e = cut(large.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    kinds = e.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("kinds"), F.max_by("root", F.struct("n", "root")).alias("main"))
    return cut(e.join(cut(kinds.filter("kinds > 1").drop("kinds")), "bucket"))


def _open_pairs(e: DataFrame) -> DataFrame:
    """(a, b, bucket): pairs of the lines outside a bucket's largest component with all not of their own, if
    their sketches agree, with no bucket; for a block with more of them than lines in them, these lines (a) and the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, lines = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
            for bucket, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                x, y = (s.values.field("id").to_numpy() for s in (left, right))
                for k, j, open_ in _open_blocks(left, right):
                    p, o = open_.nonzero()
                    own = np.union1d(x[k + p], y[j + o])
                    if len(p) > len(own):
                        lines.update((i, bucket) for i in own.tolist())
                    else:
                        a.append(x[k + p])
                        b.append(y[j + o])
            a, b = np.concatenate(a), np.concatenate(b)
            line, bucket = zip(*lines, strict=True) if lines else ((), ())
            columns = [(np.minimum(a, b), line), (np.maximum(a, b), pa.nulls(len(line), pa.int64())), (pa.nulls(len(a), pa.int64()), bucket)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()) for x in both]) for both in columns], names=["a", "b", "bucket"])

    return _block_pairs(e, F.count("*") / BLOCK, ["id", "root", "bits", "more"]).mapInArrow(run, "a long, b long, bucket long")


def _dense_links(e: DataFrame) -> DataFrame:
    """(a, b) components joined by similar ones of the given lines of buckets, those outside the largest one tested against all not of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: set[tuple[int, int]] = set()
            for left, right in zip(batch.column(1), batch.column(2), strict=True):
                (r, x), (q, y) = ((s.values.field("root").to_numpy(), s.values.field("line")) for s in (left, right))
                for k, j, open_ in _open_blocks(left, right):
                    p, o = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                    if len(p):
                        same = alike_in_block(x.take(pa.array(p + k)).to_pylist(), y.take(pa.array(o + j)).to_pylist()) & open_[np.ix_(p, o)]
                        p, o = r[k + p[same.nonzero()[0]]], q[j + o[same.nonzero()[1]]]
                        links.update(zip(np.minimum(p, o).tolist(), np.maximum(p, o).tolist(), strict=True))
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    size = F.greatest(F.count("*") / BLOCK, F.sum(F.length("line")) / BLOCK_CHARS)
    return _block_pairs(e, size, ["root", "bits", "more", "line"]).mapInArrow(run, "a long, b long").distinct()


def _cross_links(pairs: DataFrame, large: DataFrame, roots: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b) components joined by similar lines of the untested pairs and of large buckets, given the (node, root) found so far.

    Texts are read for the lines to be tested alone; most lines of large buckets agree with none of another component.
    """

    def with_roots(pairs: DataFrame) -> DataFrame:
        for c in ("a", "b"):
            pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
        return pairs

    dense = None
    if not large.isEmpty():
        e = _open_lines(large, roots)
        found = cut(_open_pairs(e))
        pairs = pairs.unionByName(found.filter("b IS NOT NULL").select("a", "b"))
        dense = cut(e.join(found.filter("b IS NULL").select("bucket", F.col("a").alias("id")).distinct(), ["bucket", "id"], "left_semi"))
    pairs = cut(with_roots(pairs.distinct()).filter("root_a != root_b"))
    ids = [pairs.select(F.col("a").alias("id")), pairs.select(F.col("b").alias("id"))] + ([] if dense is None else [dense.select("id")])
    lines = _lines_of(docs, cut(reduce(DataFrame.unionByName, ids).distinct()))
    links = _verified(pairs, lines).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    if dense is not None and not dense.isEmpty():
        links = links.unionByName(_dense_links(cut(dense.join(lines, "id"))))
    return links


def shingles(s: str) -> set[str]:
    return {s[i : i + SHINGLE] for i in range(max(1, len(s) - SHINGLE + 1))}


def jaccard_at_least(x: str, y: str, similarity: float = SIMILARITY, of_y: set[str] | None = None) -> bool:
    """Exact test on the sets of shingles; ``of_y`` may be the set of y."""
    q = shingles(y) if of_y is None else of_y
    if max(1, len(x) - SHINGLE + 1) < similarity * len(q):
        return False
    p = shingles(x)
    if min(len(p), len(q)) < similarity * max(len(p), len(q)):
        return False
    both = len(p & q)
    return both >= similarity * (len(p) + len(q) - both) - 1e-12


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
        # few characters at once, as sorting is fastest in the cache, or one pair
        ends = np.cumsum([len(s) + len(t) for s, t in zip(x, y, strict=True)])
        at, ok = 0, [np.zeros(0, bool)]
        while at < len(x):
            end = max(at + 1, int(np.searchsorted(ends, PAIR_CHARS + (ends[at - 1] if at else 0), "right")))
            ok.append(alike_pairs(x[at:end], y[at:end]))
            at = end
        yield b.select([c for c in b.schema.names if c not in ("x", "y")]).filter(pa.array(np.concatenate(ok)))


def line_components(docs: DataFrame) -> DataFrame:
    """(node, root) of the ids of similar lines, root the smallest id of its component, from rows with __lines and __ids."""
    parts = part_count(docs.count() * 10 * BINS // ROWS, PER_PART, docs)
    found = cut(_bands(docs, parts).groupBy("part").applyInArrow(_pairs_of_part, "a long, b long, bucket long, id long, bits long, more long, first boolean"))
    pairs = found.filter("a IS NOT NULL").select("a", "b", "first")
    heads = cut(pairs.filter("first").select("a", "b").distinct())
    large = found.filter("a IS NULL").select("bucket", "id", "bits", "more")
    ids = heads.select(F.col("a").alias("id")).unionByName(heads.select(F.col("b").alias("id")))
    roots = cut(components(cut(_verified(heads, _lines_of(docs, cut(ids.distinct()))))))
    more = cut(_cross_links(pairs.filter("NOT first").select("a", "b"), large, roots, docs))
    if more.isEmpty():
        return roots
    # links between components, by their smallest ids
    joined = cut(components(more).select(F.col("node").alias("root"), F.col("root").alias("least")))
    whole = roots.join(joined, "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    single = joined.join(roots.select("root").distinct(), "root", "left_anti")
    return whole.unionByName(single.select(F.col("root").alias("node"), F.col("least").alias("root")))


def _lines_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) of the checkpointed ids."""
    lines = docs.select(F.explode(F.arrays_zip("__ids", "__lines")).alias("z")).select(F.col("z.__ids").alias("id"), F.col("z.__lines").alias("line"))
    return cut(restricted(lines, "id", ids).groupBy("id").agg(F.min("line").alias("line")))


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The (a, b, ...) pairs whose (id, line) are similar."""
    both = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return both.select(*pairs.columns, "x", "y").mapInArrow(_verify, pairs.schema)


def line_decisions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with __row, __lines, __ids; (__row, __drop array<int>) of documents that lose lines)."""
    rows = _line_ids(docs.withColumn("__row", F.xxhash64("doc_id", "text")))
    roots = line_components(rows).select(F.col("node").alias("id"), "root")
    # twice read: the ids are few bytes, making them is a pass over all texts
    spots = cut(rows.select("doc_id", "__row", "__ids")).select("doc_id", "__row", F.posexplode("__ids").alias("pos", "id")).filter("id != 0")
    # each different line: how often and where first; then each component
    lines = spots.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "__row", "pos")).alias("first"))
    lines = cut(lines.join(roots, "id", "left").filter("n > 1 OR root IS NOT NULL").select("id", F.coalesce("root", "id").alias("root"), "first"))
    kept = cut(lines.groupBy("root").agg(F.min("first").alias("kept")))
    known = cut(lines.join(kept, "root").select("id", F.col("kept.__row").alias("__keep_row"), F.col("kept.pos").alias("__keep_pos")))
    gone = spots.join(known, "id").filter((F.col("__row") != F.col("__keep_row")) | (F.col("pos") != F.col("__keep_pos")))
    return rows, gone.groupBy("__row").agg(F.collect_set("pos").alias("__drop"))


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """Rows of (doc_id, text, ...) with the repeated lines taken out of text.

    An n_chars column is set to the new length.  With ``counts``, n_lines and n_removed are added.
    """
    rows, drops = line_decisions(docs)
    out = docs.withColumn("__row", F.xxhash64("doc_id", "text")).join(drops, "__row", "left")
    left = F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains("__drop", i))
    text = F.when(F.col("__drop").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    if counts:
        out = out.withColumns({"n_lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"), "n_removed": F.coalesce(F.size("__drop"), F.lit(0)).cast("long")})
    out = out.withColumn("text", text).drop("__row", "__drop")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"]))
    return out
