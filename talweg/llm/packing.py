"""Packing by cutting-stock column generation.

Documents are tokenized, cut into pieces of at most one sequence, and their lengths
counted in bins of ``QUANTUM`` tokens.  A linear program over patterns (which bins
fill a sequence) is solved by column generation: a revised simplex whose columns
are priced by a knapsack dynamic program.  The patterns' rounded counts are dealt to
the pieces by their rank within a bin, which is counted without a hot bin meeting in
one task.  Only the histogram (SEQUENCE / QUANTUM numbers) reaches the driver.

Defined cases: a null text is empty; an empty document is its end token; a document
longer than a sequence gives whole sequences and a rest; an empty table has no
pieces; equal rows are packed each for itself.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running_total

SEQUENCE = 4096
QUANTUM = 16
END_ID = 2
#: Strings in one generation of a worker's two caches.
CACHE_CHUNKS, CACHE_WORDS = 150_000, 200_000
MAX_PIVOTS = 4000

PIECES = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long"


class _Recent(dict):
    """The ids of strings seen lately: two generations of a bounded size each."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self._make, self._most, self._old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        got = self._old.get(key)
        if got is None:
            got = self._make(key)
        self[key] = got
        return got


# fixed values: the steps of the tokenizer file for which texts may be cut into chunks
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _steps(path: str) -> tuple:
    """The normalizers and pre-tokenizers of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return (found.get("normalizer") or {}).get("normalizers"), (found.get("pre_tokenizer") or {}).get("pretokenizers")


class ChunkTokenizer:
    """Ids of whole texts as little-endian uint32 bytes, by caches of chunks and of words.

    The tokenizer drops white space and never looks across it, so a text's ids are
    those of its white-space separated chunks in a row.  In texts of plain Latin letters
    and marks, chunks are cut into the tokenizer's own words, which recur more often;
    chunks of other texts go to the tokenizer whole.  A file whose steps before the model
    are not these has its texts encoded whole by the library.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._known = _steps(path) == (_NORMALIZERS, _PRE_TOKENIZERS)
        self._split = regex.compile(_SPLIT).findall
        self._bpe = self._tok.model.tokenize
        self._word = _Recent(self._of_word, CACHE_WORDS)
        self._chunk = _Recent(self._of_plain_chunk, CACHE_CHUNKS)
        self._other = _Recent(self._ids, CACHE_CHUNKS // 25)

    def _ids(self, text: str) -> bytes:
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_word(self, word: str) -> bytes:
        """The model's ids of a word that is already composed, lower-cased and split off."""
        ids = [t.id for t in self._bpe("".join(map(_BYTE_CHARS.__getitem__, word.encode())))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _of_plain_chunk(self, chunk: str) -> bytes:
        """Of a lower-cased chunk of the plain range, which needs no composing."""
        if chunk.isalpha():
            return self._word[chunk]
        if "<|" in chunk:  # may be a special token
            return self._ids(chunk)
        return b"".join(map(self._word.__getitem__, self._split(chunk)))

    def encode(self, text: str) -> bytes:
        if not self._known:
            return self._ids(text)
        if _PLAIN(text):
            return b"".join(map(self._chunk.__getitem__, text.lower().split()))
        if _ODD_SPACE(text):  # white space to str.split, not to the tokenizer
            return self._ids(text)
        return b"".join(map(self._other.__getitem__, text.split()))


def _byte_chars() -> list[str]:
    """Byte-level BPE's character of each byte: printable ones stand for themselves, the rest follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


_BYTE_CHARS = _byte_chars()
# letters here are composed already and lower-cased one by one
_PLAIN = re.compile("[\\t-\\r -~\\xa1-\\xac\\xae-\\u012f\\u0131-\\u017f]*").fullmatch
_ODD_SPACE = re.compile("[\x1c-\x1f]").search


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process and file, kept from task to task."""
    return ChunkTokenizer(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of (doc_id, text) rows.

    ``path`` is the tokenizer file as the executors see it; by default each finds its own.
    """
    kind = dict(docs.dtypes)["doc_id"]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path or tokenizer_path())
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at, start, length, crc, total = [], [], [], [], []
            for k, text in enumerate(texts):
                data = tok.encode(text.as_py() or "") + end
                for s in range(0, len(data), 4 * sequence):
                    piece = data[s : s + 4 * sequence]
                    at.append(k)
                    start.append(s // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(data) // 4)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int32())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(kind))


def _price(value: np.ndarray) -> tuple[float, np.ndarray]:
    """The most valuable multiset of bins 1..n that fits n: (value, counts)."""
    n = len(value)
    best, pick = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for w in range(1, n + 1):
        options = best[w - 1 :: -1][:w] + value[:w]  # bin b = 1..w leaves w - b
        k = int(np.argmax(options))
        if options[k] > best[w - 1]:
            best[w], pick[w] = options[k], k + 1
        else:
            best[w], pick[w] = best[w - 1], 0
    counts, w = np.zeros(n, np.int64), n
    while w > 0:
        if pick[w]:
            counts[pick[w] - 1] += 1
            w -= pick[w]
        else:
            w -= 1
    return float(best[n]), counts


def solve_patterns(demand: np.ndarray, max_pivots: int = MAX_PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts): integer patterns over bins 1..n that cut the demand exactly.

    The program: least number of sequences so that each bin is cut as often as it is
    asked for.  Its simplex starts from one-bin patterns.  Counts are rounded down,
    and what is left is packed first-fit by decreasing size.
    """
    n = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return np.zeros((0, n), np.int64), np.zeros(0, np.int64)
    m = len(used)
    columns = np.zeros((m, m))  # columns[:, j]: basic pattern j over the used bins
    columns[np.arange(m), np.arange(m)] = n // (used + 1)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand[used].astype(float)
    for k in range(max_pivots):
        dual = inverse.sum(axis=0)
        value = np.zeros(n)
        value[used] = np.maximum(dual, 0)
        gain, counts = _price(value)
        if gain <= 1 + 1e-9:
            break
        new = counts[used].astype(float)
        step = inverse @ new
        up = step > 1e-9
        ratio = np.where(up, x / np.where(up, step, 1), np.inf)
        j = int(np.argmin(ratio))
        theta = ratio[j]
        x = x - theta * step
        x[j] = theta
        columns[:, j] = new
        row = inverse[j] / step[j]
        inverse -= np.outer(step, row)
        inverse[j] = row
        if k % 200 == 199:  # against rounding drift
            inverse = np.linalg.inv(columns)
            x = inverse @ demand[used].astype(float)
    patterns = np.zeros((m, n), np.int64)
    patterns[:, used] = np.rint(columns.T).astype(np.int64)
    whole = np.floor(np.maximum(x, 0) + 1e-7).astype(np.int64)
    while (over := (patterns * whole[:, None]).sum(axis=0) - demand).max() > 0:  # a rounding error only
        j = int(np.flatnonzero((whole > 0) & (patterns[:, int(np.argmax(over))] > 0))[0])
        whole[j] -= 1
    left = demand - (patterns * whole[:, None]).sum(axis=0)
    extra = _first_fit(left)
    keep = whole > 0
    return np.concatenate([patterns[keep], extra]), np.concatenate([whole[keep], np.ones(len(extra), np.int64)])


def _first_fit(left: np.ndarray) -> np.ndarray:
    """Patterns for the bins left over, largest first; a few for each basic pattern at most."""
    n, room, made = len(left), [], []
    for size in range(n, 0, -1):
        for _ in range(int(left[size - 1])):
            for i, r in enumerate(room):
                if r >= size:
                    break
            else:
                i = len(room)
                room.append(n)
                made.append(np.zeros(n, np.int64))
            room[i] -= size
            made[i][size - 1] += 1
    return np.array(made, np.int64).reshape(len(made), n)


def pack(parts: DataFrame, sequence: int = SEQUENCE, quantum: int = QUANTUM) -> DataFrame:
    """Add sequence_id and offset to pieces; their number and order do not matter."""
    bins = -(-sequence // quantum)
    parts = parts.withColumn("__bin", F.ceil(F.col("length") / quantum).cast("int"))
    demand = np.zeros(bins, np.int64)
    for b, c in parts.groupBy("__bin").count().collect():  # at most ``bins`` rows
        demand[b - 1] = c
    patterns, counts = solve_patterns(demand)
    # of each bin: the ranks dealt to each pattern that holds it
    first_id = np.concatenate([[0], np.cumsum(counts)])
    where, first, base, each = [], [], [], []
    for b in range(bins):
        holders = np.flatnonzero(patterns[:, b]) if len(patterns) else []
        at = 0
        for p in holders:
            where.append(b + 1)
            first.append(at)
            base.append(int(first_id[p]))
            each.append(int(patterns[p, b]))
            at += int(patterns[p, b] * counts[p])
    deal = parts.sparkSession.sparkContext.broadcast(tuple(np.array(v, np.int64) for v in (where, first, base, each)))
    order = F.xxhash64("doc_id", "start", "ids_crc32")
    ranked = running_total(parts.withColumns({"__h": order, "__one": F.lit(1).cast("long")}), "__bin", "__h", "__one", "__rank", ["doc_id", "start", "length", "ids_crc32"]).drop("__h", "__one")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, first, base, each = deal.value
        for b in batches:
            bin_ = b.column(b.schema.get_field_index("__bin")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(b.schema.get_field_index("__rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            lo, hi = np.searchsorted(where, bin_, "left"), np.searchsorted(where, bin_, "right")
            while (hi - lo > 1).any():  # halve each row's range until first[lo] <= rank < first[hi]
                mid = (lo + hi) // 2
                right = (first[np.minimum(mid, len(first) - 1)] <= rank) & (hi - lo > 1)
                lo, hi = np.where(right, mid, lo), np.where(right | (hi - lo <= 1), hi, mid)
            seq = base[lo] + (rank - first[lo]) // each[lo] if len(rank) else rank
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq)], names=[*b.schema.names, "sequence_id"])

    fields = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes)
    dealt = ranked.mapInArrow(assign, f"{fields}, sequence_id long")
    w = Window.partitionBy("sequence_id").orderBy(F.col("__bin").desc(), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long")).drop("__bin", "__rank")


def pack_documents(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, quantum: int = QUANTUM) -> DataFrame:
    """Pieces of (doc_id, text) rows with their sequence and offset."""
    return pack(cut(pieces(docs, path, sequence)), sequence, quantum)
