"""N-gram Jaccard join: an exact set-similarity self-join with set-relation skipping.

A document's set is that of its distinct five-word shingles, as 64-bit hashes.  Two sets
link if 100 * |intersection| >= 80 * |union|.

* Equal sets are one: tasks drop the repeats they see, and a set's number stands for
  all its copies.
* Global order: rare shingles first.  All shingles of all sets are counted; the most
  frequent (at most ``HEAVY_TERMS``) are broadcast with the logarithm of their count,
  the others are ordered by hash.  Any such order gives the same result; this one
  keeps common passages out of the prefixes.
* Index: lists of the prefix shingles' entries (set, size, position).  Lists are sorted
  by size and position; offsets into a list whose sizes or positions cannot reach the
  overlap are skipped as blocks.
* Answers by set relations: a long list gives only the pairs of each entry with the
  list's heads and with its neighbours.  A set that is found similar to another
  takes over its component, so pairs inside a component are never made.  For lists
  whose entries are still in several components, the entries outside the list's
  largest component are compared with a few members of it, and what is then still
  outside with all others of the list, so no link between components is lost.
* Bitmaps of 512 bits bound the overlap of a pair from above; pairs that pass are verified on
  the whole texts' sets.

Defined cases: null text, or text without words, has an empty set and links to
nothing; with fewer than five words the whole sequence is one shingle; rows repeated
whole, or with one doc_id, are rows of their own with that id; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, dealt, gathered, mix64, part_count, restricted

SHINGLE = 5
PERCENT = 80
HEAVY_COUNT = 8  # sets with a shingle from which it may count as frequent
HEAVY_TERMS = 1 << 20
LONG_LIST = 12
BITMAP = 8  # longs of a set's bitmap
HEADS = 6  # of a long list, with which its entries are paired
PROBES = 4  # members of a list's largest component that others are paired with before all are
BYTES = 1 << 20  # of text hashed at once
FLUSH = 1 << 22  # numbers a task holds before it sends them
PART_ENTRIES = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = mix64(np.arange(1, 257, dtype=np.uint64))
_BITS = [f"b{k}" for k in range(8)]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2**64; kept for the usual size."""
    size = max(n + 1, BYTES + (BYTES >> 1))
    if base not in _powers or len(_powers[base]) <= n:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        if size > 2 * BYTES:
            return p
        _powers[base] = p
    return _powers[base]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    size = 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        chunk.append(data)
        size += len(data) + 1
        if size >= BYTES:
            out += _sets_of(chunk)
            chunk, size = [], 0
    return out + (_sets_of(chunk) if chunk else [])


def _sets_of(docs: list[bytes]) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join([*docs, b""]), np.uint8)
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    # a word's hash: the difference of prefix sums, shifted to the word's start
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_RANDOM[raw] * _power(_BASE, len(raw))[: len(raw)], dtype=np.uint64)])
    word = mix64((total[end] - total[start]) * _power(_INVERSE, len(raw))[start] + (end - start).astype(np.uint64))
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])]))
    n = len(word) - SHINGLE + 1
    run = np.zeros(max(n, 0), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        run = run * np.uint64(_BASE) + word[k : n + k]
    run = mix64(run)
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= SHINGLE:
            s = np.sort(run[a : z - SHINGLE + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif z > a:
            h = np.array([z - a], np.uint64)
            for k in range(a, z):
                h = mix64(h * np.uint64(_BASE) + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_number(s: np.ndarray) -> int:
    """A 64-bit number that stands for a set (0 for the empty one)."""
    if not len(s):
        return 0
    total = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(mix64(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) or 1


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of the set's hashes in 64 * BITMAP classes: each shingle that two sets do not share flips one bit."""
    odd = np.bincount((s & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _needed(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Least overlap with which sets of n and m shingles link."""
    return -(-(percent * (n + m)) // (100 + percent))


def _set_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, n, set, b0 ..) of (doc_id, row, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, number, bits = [], [], np.zeros((b.num_rows, BITMAP), np.int64)
            for i in range(0, b.num_rows, 256):
                for k, s in enumerate(shingle_sets(b.column(2)[i : i + 256].to_pylist()), i):
                    n.append(len(s))
                    number.append(set_number(s))
                    bits[k] = bitmap(s)
            cols = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(number, pa.int64()), *(pa.array(bits[:, k]) for k in range(BITMAP))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n", "set", *_BITS])

    return docs.select("doc_id", "row", "text").mapInArrow(run, f"doc_id {kind}, row long, n long, set long, " + ", ".join(f"{c} long" for c in _BITS))


def _new_sets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, set) of the sets that a task has not seen before; empty ones are left out."""
    seen = {0}
    for b in batches:
        for i in range(0, b.num_rows, 256):
            for s in shingle_sets(b.column(column)[i : i + 256].to_pylist()):
                number = set_number(s)
                if number not in seen:
                    seen.add(number)
                    yield number, s


def frequent(docs: DataFrame, parts_log2: int, heavy_count: int = HEAVY_COUNT, heavy_terms: int = HEAVY_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted leading bits, class) of the most frequent shingles: class is log2 of the number of sets.

    Tasks send sorted differences of 32 bits for each part; counts are made by part.
    If more shingles are frequent than may be broadcast, the rarer classes are left
    to the order by hash.
    """
    shift = np.uint64(32 - parts_log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t, count = np.unique(np.concatenate(held) >> shift, return_counts=True)
            part, low = (t >> np.uint64(32)).astype(np.int64), (t & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            first = np.concatenate([[True], part[1:] != part[:-1]])
            step = np.where(first, low, low - np.concatenate([low[:1], low[:-1]]))
            begin = np.flatnonzero(first)
            end = np.concatenate([begin[1:], [len(t)]])
            planes, again, more = [], [], []
            for i, j in zip(begin.tolist(), end.tolist(), strict=True):
                # byte planes: the high ones are mostly zero, which the shuffle's compression removes
                planes.append(step[i:j].view(np.uint8).reshape(-1, 4).T.tobytes())
                twice = count[i:j] > 1
                again.append(low[i:j][twice].tobytes())
                more.append((count[i:j][twice] - 1).astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), pa.array(planes), pa.array(again), pa.array(more)], names=["part", "a0", "a1", "a2"])

        for _, s in _new_sets(batches, 0):
            held.append(s)
            size += len(s)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def count(key: tuple, table: pa.Table) -> pa.Table:
        low, weight = [], []
        for planes in table.column("a0").to_pylist():
            step = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            low.append(np.cumsum(step, dtype=np.uint32))
            weight.append(np.ones(len(step), np.uint32))
        low.append(gathered(table.column("a1"), "<u4"))
        weight.append(gathered(table.column("a2"), "<u4"))
        low, weight = np.concatenate(low), np.concatenate(weight)
        order = np.argsort(low)
        low, weight = low[order], weight[order]
        begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.add.reduceat(weight.astype(np.int64), begin)
        many = n >= heavy_count
        bits = (np.uint64(key[0].as_py()) << np.uint64(32)) | low[begin][many].astype(np.uint64)
        return pa.table({"bits": pa.array(bits.astype(np.int64)), "class": pa.array(np.log2(n[many]).astype(np.int32), pa.int32())})

    found = docs.select("text").mapInArrow(run, "part int, a0 binary, a1 binary, a2 binary").groupBy("part").applyInArrow(count, "bits long, class int")
    found = cut(found)
    least, total = 64, 0
    for c, n in sorted(found.groupBy("class").count().collect(), reverse=True):  # at most 64 rows
        if total + n > heavy_terms:
            break
        least, total = c, total + n
    table = found.filter(F.col("class") >= least).toArrow().combine_chunks().sort_by("bits")  # at most heavy_terms rows
    return table.column("bits").to_numpy().astype(np.uint64), table.column("class").to_numpy().astype(np.int8)


def _entries(docs: DataFrame, order: tuple[np.ndarray, np.ndarray], order_log2: int, parts_log2: int, percent: int) -> DataFrame:
    """Blobs (part, tokens, sets, sizes, positions) of all sets' prefixes."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    shift, own_shift = np.uint64(32 - order_log2), np.uint64(32 - parts_log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, classes = shared.value
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, number, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            t = token >> own_shift
            return dealt((t >> np.uint64(32)).astype(np.int64), [(t & np.uint64(0xFFFFFFFF)).astype(np.uint32), number, n, pos])

        for number, s in _new_sets(batches, 0):
            n = len(s)
            keep = n - -(-percent * n // 100) + 1
            if len(bits):
                at = np.searchsorted(bits, s >> shift)
                at[at == len(bits)] = 0
                rank = np.where(bits[at] == s >> shift, classes[at], 0)
                if rank.any():
                    s = s[np.argsort(rank, kind="stable")]
            pos = np.minimum(np.arange(keep), 65535).astype(np.uint16)
            held.append([s[:keep], np.full(keep, number, np.int64), np.full(keep, n, np.uint32), pos])
            size += keep
            if size >= FLUSH // 4:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "part int, a0 binary, a1 binary, a2 binary, a3 binary")


def _may_link(n, p, m, q, percent: int) -> np.ndarray:
    """Size and position filters for entries (size, position) of one list."""
    reach = np.minimum(n - p, m - q) + np.minimum(p, q)
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (reach >= _needed(n, m, percent))


def _lists_of_part(percent: int, long_list: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        token, number = gathered(table.column("a0"), "<u4"), gathered(table.column("a1"), "<i8")
        n, pos = gathered(table.column("a2"), "<u4").astype(np.int64), gathered(table.column("a3"), "<u2").astype(np.int64)
        # only lists of several entries; sorted by size, then position
        shared = np.flatnonzero(np.isin(token, _repeated(token)))
        order = shared[np.lexsort((number[shared], pos[shared], n[shared], token[shared]))]
        token, number, n, pos = token[order], number[order], n[order], pos[order]
        same = np.concatenate([[False], (token[1:] == token[:-1]) & (number[1:] == number[:-1])]) if len(token) else np.zeros(0, bool)
        token, number, n, pos = token[~same], number[~same], n[~same], pos[~same]  # copies that different tasks saw
        if not len(token):
            return _list_table([], [], [], None)
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.concatenate([begin, [len(token)]]))
        within = np.repeat(length, length)
        left, right = [], []
        for k in range(1, long_list):
            i = np.flatnonzero(token[k:] == token[:-k])
            i = i[(within[i] <= long_list) | (k == 1)]
            i = i[100 * n[i] >= percent * n[i + k]]  # sizes only grow with k: what fails here is a skipped block
            if not len(i):
                break
            i = i[_may_link(n[i], pos[i], n[i + k], pos[i + k], percent)]
            left.append(number[i])
            right.append(number[i + k])
        long = within > long_list
        i = np.flatnonzero(long)
        if len(i):
            # heads: the entries with the least hashes, mostly the same for lists of the same sets
            for seed in range(HEADS):
                by = np.lexsort((mix64(number.view(np.uint64) + np.uint64(seed)), token))
                head = np.repeat(by[begin], length)[i]
                ok = (head != i) & _may_link(n[i], pos[i], n[head], pos[head], percent)
                left.append(number[i][ok])
                right.append(number[head][ok])
        whole = (np.int64(key[0].as_py()) << np.int64(32)) | token[i].astype(np.int64)
        return _list_table(left, right, i, (whole, number[i], n[i], pos[i]))

    return run


def _repeated(values: np.ndarray) -> np.ndarray:
    s = np.sort(values)
    return s[1:][s[1:] == s[:-1]]


def _list_table(left: list, right: list, i, long) -> pa.Table:
    a = np.concatenate(left) if left else np.zeros(0, np.int64)
    b = np.concatenate(right) if right else np.zeros(0, np.int64)
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    k, m = len(pair), len(i)
    none, zeros = pa.nulls(m, pa.int64()), pa.nulls(k, pa.int64())
    token, number, n, pos = long if long is not None else (np.zeros(0, np.int64),) * 4
    join = lambda x, y: pa.concat_arrays([x, y])
    return pa.table({
        "a": join(pa.array(pair[:, 0], pa.int64()), none), "b": join(pa.array(pair[:, 1], pa.int64()), none),
        "token": join(zeros, pa.array(token, pa.int64())), "set": join(zeros, pa.array(number, pa.int64())), "n": join(zeros, pa.array(n, pa.int64())), "pos": join(zeros, pa.array(pos, pa.int64())),
    })


def _by_set(sets: DataFrame) -> DataFrame:
    """(set, row, n, b0 ..): one row stands for the copies of a set."""
    return sets.groupBy("set").agg(F.min("row").alias("row"), F.min("n").alias("n"), *(F.min(c).alias(c) for c in _BITS))


def _bits_allow(percent: int, other: str = "_") -> Column:
    """The bitmap filter: differing bits bound the overlap from above, so no link is lost."""
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + other))) for c in _BITS[1:]), F.bit_count(F.col("b0").bitwiseXOR(F.col("b0" + other))))
    both = F.col("n") + F.col("n" + other)
    return (both - differ) * (100 + percent) >= 2 * both * percent


def _verified(pairs: DataFrame, docs: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs of set numbers whose sets link: first by bitmaps, then on whole texts."""
    left = kinds.select(F.col("set").alias("a"), "n", *_BITS)
    right = kinds.select(F.col("set").alias("b"), *(F.col(c).alias(c + "_") for c in ("n", *_BITS)))
    pairs = cut(pairs.join(left, "a").join(right, "b").filter(_bits_allow(percent)).select("a", "b"))
    wanted = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()
    rows = cut(kinds.select("set", "row").join(wanted, "set"))
    texts = restricted(docs.select("row", "text"), "row", rows.select("row")).dropDuplicates(["row"]).join(rows, "row").select("set", "text")
    both = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("set").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok: list[bool] = []
            for i in range(0, b.num_rows, 128):
                x, y = (shingle_sets(b.column(c)[i : i + 128].to_pylist()) for c in ("x", "y"))
                ok += [linked(p, q, percent) for p, q in zip(x, y, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _open_lists(long: DataFrame, links: DataFrame) -> DataFrame | None:
    """Entries (token, set, n, pos, root, main) of the long lists whose sets are in several components."""
    roots = components(links).select(F.col("node").alias("set"), "root")
    e = cut(long.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    kinds = e.groupBy("token", "root").count().groupBy("token").agg(F.count("*").alias("kinds"), F.max_by("root", F.struct("count", "root")).alias("main"))
    e = cut(e.join(cut(kinds.filter("kinds > 1").drop("kinds")), "token"))
    return None if e.isEmpty() else e


def _cross_pairs(outside: DataFrame, others: DataFrame, kinds: DataFrame, percent: int) -> DataFrame:
    """Pairs of the list entries outside the largest component with others of their list, by size, position and bitmap."""
    bits = kinds.select("set", *_BITS)
    names = ["set", "root", "n", "pos", *_BITS]
    o = outside.join(bits, "set").select("token", *(F.col(c).alias(f"{c}_") for c in names))
    reach = F.least(F.col("n") - F.col("pos"), F.col("n_") - F.col("pos_")) + F.least("pos", "pos_")
    fits = (F.col("root") != F.col("root_")) & (F.least("n", "n_") * 100 >= F.greatest("n", "n_") * percent) & (reach * (100 + percent) >= (F.col("n") + F.col("n_")) * percent)
    others = others.join(bits, "set").select(F.col("token").alias("t"), *names)
    pair = others.join(o, (F.col("t") == F.col("token")) & fits & _bits_allow(percent))
    return pair.select(F.least("set", "set_").alias("a"), F.greatest("set", "set_").alias("b")).distinct()


def join_sets(docs: DataFrame, percent: int = PERCENT, long_list: int = LONG_LIST) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, row, n, set, ..), verified links (a, b) between set numbers) of (doc_id, text) rows.

    The links connect every pair of linked sets, if not each directly.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    sets = cut(_set_rows(docs))
    total = sets.agg(F.sum("n")).first()[0] or 0
    log2 = lambda n: min(24, max(8, int(n - 1).bit_length()))
    order_log2, parts_log2 = log2(part_count(total, 2 * PART_ENTRIES, docs)), log2(part_count(total // 5, PART_ENTRIES, docs))
    order = frequent(docs, order_log2)
    lists = _entries(docs, order, order_log2, parts_log2, percent).groupBy("part").applyInArrow(_lists_of_part(percent, long_list), "a long, b long, token long, set long, n long, pos long")
    lists = cut(lists)
    pairs = cut(lists.filter("a IS NOT NULL").select("a", "b").distinct())
    kinds = cut(_by_set(sets))
    links = _verified(pairs, docs, kinds, percent)
    long = lists.filter("a IS NULL").select("token", "set", "n", "pos")
    for probe in (True, False):
        e = _open_lists(long, links)
        if e is None:
            break
        outside, others = e.filter("root != main"), e
        if probe:
            # first a few members of the largest component, by hash: near copies mostly join it through them
            picks = F.array(*(F.min_by(F.struct("set", "n", "pos"), F.xxhash64("set", F.lit(k))) for k in range(PROBES)))
            others = e.filter("root = main").groupBy("token", "main").agg(F.array_distinct(picks).alias("p")).select("token", F.col("main").alias("root"), F.explode("p").alias("p")).select("token", "root", "p.*")
        left = cut(_cross_pairs(outside, others, kinds, percent))
        tested = left.join(pairs, ["a", "b"], "left_anti")
        links = cut(links.unionByName(_verified(tested, docs, kinds, percent)))
        pairs = cut(pairs.unionByName(left).distinct())
    return sets, links


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n_shingles, root, component_id) of every row; component_id is the smallest doc_id that links reach."""
    sets, links = join_sets(docs, percent)
    roots = components(links).select(F.col("node").alias("set"), "root")
    # copies of a set meet by partial minima
    each = sets.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    each = cut(each.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    least = cut(each.groupBy("root").agg(F.min("least").alias("component_id")))
    known = cut(each.join(least, "root").select("set", "root", "component_id"))
    out = sets.join(known, "set", "left")  # an empty set is a class of its own
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of (doc_id, text, ...) of which one stays for each component: that with the smallest doc_id.

    Of rows repeated whole one stays; rows without words all stay.
    """
    found = cut(classes(docs, percent))
    first = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    stay = found.filter("n_shingles > 0").groupBy("root").agg(first.alias("__row")).select("__row", F.lit(True).alias("__once"))
    empty = found.filter("n_shingles = 0").select(F.col("row").alias("__row"), F.lit(False).alias("__once")).distinct()
    rows = docs.withColumn("__row", F.xxhash64("doc_id", "text")).join(cut(stay.unionByName(empty)), "__row")
    return rows.filter("__once").dropDuplicates(["__row"]).unionByName(rows.filter("NOT __once")).drop("__row", "__once")
