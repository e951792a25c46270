"""Toxicity: a learned lexicon matched with spelling errors, weighed by context.

The lexicon (words and word beginnings) is learned from labelled rows.  Words are
matched by a Levenshtein automaton intersected with the lexicon's trie: a lazily
determinized automaton over sets of (trie node, errors).  Each hit's window of
words tells quotation (quote marks around it, or words of reporting) from abuse.  A
regularised logistic regression weighs the hits' sums into a score.

The fit uses at most ``FIT_ROWS`` labelled rows, in the order of a hash, with texts of
at most ``FIT_BYTES`` bytes; its lexicon has at most ``MAX_TERMS`` entries, so the
model that is broadcast is of bounded size.  Every text is scored whole.

Defined cases: null and empty texts have no hits and get the score of such texts;
equal texts have equal scores; without rows of both labels the lexicon is empty
and every score is ``PRIOR``; a doc_id labelled twice counts as toxic if any label is.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 8000
FIT_BYTES = 1 << 16
MAX_TERMS = 400
MIN_DOCS = 3  # labelled texts that must speak for an entry
MAX_SHARE = 0.05  # of an entry's texts that may be labelled 0
PREFIXES = range(3, 9)
WINDOW = 8  # words on either side of a hit
THRESHOLD = 0.7
PRIOR = 0.01
CACHE_WORDS = 200_000

#: Marks that open and close a quotation, and words of reporting.
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says quoted quote called wrote calling word term dit mot sagte wort zitat dijo palabra".split())

_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased words as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The nearest lexicon entry of a word, with spelling errors in whole words only."""

    DEAD = 0

    def __init__(self, words: list[str], beginnings: list[str]) -> None:
        self._child: list[dict[str, int]] = [{}]
        self._word: list[int] = [-1]
        self._begin: list[int] = [-1]
        self._most: list[int] = [0]  # errors that some word below a node allows
        self.terms = [*words, *beginnings]
        for k, t in enumerate(self.terms):
            node, allow = 0, errors_allowed(t) if k < len(words) else 0
            self._most[0] = max(self._most[0], allow)
            for c in t:
                nxt = self._child[node].get(c)
                if nxt is None:
                    nxt = self._child[node][c] = len(self._child)
                    self._child.append({})
                    self._word.append(-1)
                    self._begin.append(-1)
                    self._most.append(0)
                node = nxt
                self._most[node] = max(self._most[node], allow)
            (self._word if k < len(words) else self._begin)[node] = k
        self._ids: dict[frozenset, int] = {frozenset(): 0}
        self._sets: list[frozenset] = [frozenset()]
        self._next: list[dict[str, int]] = [{}]
        self._start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        # a lexicon letter left out in the word: move down at the cost of one error
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            for child in self._child[node].values():
                if e + 1 <= self._most[child] and (child, e + 1) not in pairs:
                    pairs.add((child, e + 1))
                    todo.append((child, e + 1))
        key = frozenset(pairs)
        if key not in self._ids:
            self._ids[key] = len(self._sets)
            self._sets.append(key)
            self._next.append({})
        return self._ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self._sets[state]:
            for d, child in self._child[node].items():
                if d == c:
                    out.add((child, e))
                elif e + 1 <= self._most[child]:
                    out.add((child, e + 1))  # another letter
            if e + 1 <= self._most[node]:
                out.add((node, e + 1))  # a letter too many
        to = self._next[state][c] = self._state(out)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry number, errors), fewest errors first; a word's beginning counts without errors."""
        state, begun = self._start, None
        for c in word:
            to = self._next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.DEAD:
                break
            if begun is None:
                begun = next((self._begin[n] for n, e in self._sets[state] if e == 0 and self._begin[n] >= 0), None)
        best = min(((e, self._word[n]) for n, e in self._sets[state] if self._word[n] >= 0 and e <= errors_allowed(self.terms[self._word[n]])), default=None)
        if best and best[0] == 0 or begun is None:
            return best and (best[1], best[0])
        return begun, 0


def _quoted(text: str, spans: list[tuple[int, int]], i: int) -> bool:
    """Whether word i stands in quote marks or is reported, judged by its window."""
    lo, hi = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
    a, z = spans[i]
    left, right = text[lo:a], text[z:hi]
    if any(q in left for q in QUOTES) and any(q in right for q in QUOTES):
        if sum(left.count(q) for q in QUOTES) % 2 == 1:
            return True
    return any(text[b:e].lower() in REPORTING for b, e in spans[max(0, i - WINDOW) : i])


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    beginnings: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    wrong: list[float] = field(default_factory=list)  # weights of misspelled entries
    coefficients: tuple[float, ...] = (math.log(PRIOR / (1 - PRIOR)), 0, 0, 0, 0)


class Scorer:
    """Features and scores of texts by a model; keeps the words it has seen."""

    def __init__(self, model: Model) -> None:
        self.model, self.matcher = model, Matcher(model.words, model.beginnings)
        self._seen: dict[bytes, tuple[int, int] | None] = {}

    def hits(self, text: str) -> list[tuple[int, int, bool]]:
        """(entry, errors, quoted) of each hit of the whole text."""
        seen, words = self._seen, words_of(text)
        new = set(words).difference(seen)
        if new:
            if len(seen) > CACHE_WORDS:
                seen.clear()
                new = set(words)
            for w in new:
                seen[w] = self.matcher.match(w.decode("utf-8", "surrogatepass"))
        found = [(i, m) for i, m in enumerate(map(seen.__getitem__, words)) if m is not None]
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
        return [(m[0], m[1], _quoted(text, spans, i)) for i, m in found]

    def sums(self, hits: list[tuple[int, int, bool]]) -> list[float]:
        """Capped sums of weights: exact abuse, exact quoted, misspelled abuse, misspelled quoted."""
        sums, times = [0.0] * 4, Counter()
        for term, errors, quoted in hits:
            times[term, errors > 0, quoted] += 1
        for (term, wrong, quoted), n in times.items():
            sums[2 * wrong + quoted] += (self.model.wrong if wrong else self.model.weights)[term] * (1 + math.log(n) / 4)
        return [min(s, 20.0) for s in sums]

    def features(self, text: str) -> list[float]:
        return self.sums(self.hits(text))

    def score(self, text: str) -> float:
        z = self.model.coefficients[0] + sum(c * x for c, x in zip(self.model.coefficients[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _entries(text: str) -> dict[str, set[tuple[bytes, bytes]]]:
    """Lexicon candidates of a text (words, and beginnings with a star) with the neighbours they stand between."""
    words = words_of(text)
    between = list(zip([b"", *words[:-1]], words, [*words[1:], b""], strict=True))
    out: dict[str, set[tuple[bytes, bytes]]] = defaultdict(set)
    for before, w, after in between:
        word = w.decode("utf-8", "replace")
        out[word].add((before, after))
        for n in PREFIXES:
            if len(word) > n:
                out[word[:n] + "*"].add((before, after))
    return out


def _chance(k: int, n: int, base: float) -> float:
    """Log of an upper bound on the chance of k or more toxic among n texts (Chernoff)."""
    q = k / n
    if q <= base:
        return 0.0
    rest = (1 - q) * math.log((1 - q) / (1 - base)) if q < 1 else 0.0
    return -n * (q * math.log(q / base) + rest)


def learn_lexicon(toxic: list[str], clean: list[str]) -> tuple[list[str], list[str], list[float]]:
    """Entries that stand in toxic texts too often for chance and hardly in clean ones.

    An entry's count is that of the different neighbours it stands between, so near
    copies of one text do not speak for its words several times.
    """
    holds: dict[str, set[int]] = defaultdict(set)
    spots: dict[str, set] = defaultdict(set)
    for i, t in enumerate(toxic):
        for e, around in _entries(t).items():
            holds[e].add(i)
            spots[e] |= around
    count = {e: min(len(d), len(spots[e])) for e, d in holds.items()}
    count = {e: k for e, k in count.items() if k >= MIN_DOCS}
    del spots
    against: Counter = Counter()
    for t in clean:
        against.update(e for e in _entries(t) if e in count)
    base = len(toxic) / (len(toxic) + len(clean))
    limit = math.log(0.05 / max(1, len(count)))
    good = {e: k for e, k in count.items() if against[e] <= MAX_SHARE * (k + against[e]) and _chance(k, k + against[e], base) <= limit}
    picked: list[str] = []
    # most texts first; of equals a whole word, then the longest beginning
    for e in sorted(good, key=lambda e: (-len(holds[e]), e.endswith("*"), -len(e), e)):
        stem = e.rstrip("*")
        inside = any(p.endswith("*") and stem.startswith(p[:-1]) for p in picked)  # an entry covers it
        adds = e.endswith("*") and any(stem.startswith(p) or (p.endswith("*") and p.startswith(stem)) for p in picked)
        alike = e.endswith("*") and any(not p.endswith("*") and p.startswith(stem) and len(holds[e]) <= 1.1 * len(holds[p]) for p in picked)
        if not (inside or adds or alike):
            picked.append(e)
        if len(picked) == MAX_TERMS:
            break
    words, stems = sorted(p for p in picked if not p.endswith("*")), sorted(p[:-1] for p in picked if p.endswith("*"))
    weigh = lambda e: math.log((count[e] + 0.5) / (len(toxic) + 1)) - math.log((against[e] + 0.5) / (len(clean) + 1))
    return words, stems, [max(0.1, weigh(e)) for e in (*words, *(s + "*" for s in stems))]


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model of (text, toxic) rows; the lexicon and the regression are fitted on the same rows.

    A text that is labelled both ways counts once, as toxic.
    """
    labelled: dict[str, int] = {}
    for t, y in rows:
        labelled[t] = max(y, labelled.get(t, 0))
    rows = sorted(labelled.items())
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    if len(toxic) < MIN_DOCS or not clean:
        return Model()
    words, stems, weights = learn_lexicon(toxic, clean)
    model = Model(words, stems, weights, [0.0] * len(weights))
    scorer = Scorer(model)
    found = [scorer.hits(t) for t, _ in rows]
    y = np.array([float(v) for _, v in rows])
    model.wrong = _misspelling_weights(found, y, len(weights))
    x = np.array([[1.0, *scorer.sums(h)] for h in found])
    model.coefficients = _logistic(x, y)
    return model


def _misspelling_weights(found: list[list[tuple[int, int, bool]]], y: np.ndarray, n: int) -> list[float]:
    """Evidence of each entry's misspellings; unseen ones get a moderate weight."""
    counts = np.zeros((2, n))
    for hits, label in zip(found, y, strict=True):
        for term in {t for t, errors, _ in hits if errors}:
            counts[int(label), term] += 1
    p, q = y.sum(), len(y) - y.sum()
    return np.maximum(0, np.log((counts[1] + 1) / (p + 2)) - np.log((counts[0] + 0.05) / (q + 1))).tolist()


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights by Newton steps with halving, drawn towards ``prior``; only the intercept may be negative."""
    prior, strength = np.array([-4.0, 1.0, 0.2, 0.9, 0.1]), np.array([0.01, 1.0, 1.0, 1.0, 1.0])
    beta, free = prior.copy(), np.ones(5, bool)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(strength * (b - prior) ** 2))

    for _ in range(100):
        z = np.clip(x @ beta, -500, 500)
        p = 1 / (1 + np.exp(-z))
        g = (x.T @ (p - y) + strength * (beta - prior))[free]
        h = ((x.T * (p * (1 - p))) @ x + np.diag(strength))[np.ix_(free, free)]
        step = np.zeros(5)
        step[free] = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta) - 1e-4 * size * float(g @ step[free]):
            size /= 2
        beta = beta - size * step
        if (bad := (beta < 0) & (np.arange(5) > 0)).any():
            beta[bad], free = 0.0, free & ~bad
        elif np.abs(size * step).max() < 1e-7:
            break
    return tuple(float(b) for b in beta)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[tuple[str, int]]:
    """(text, toxic) of at most ``fit_rows`` labelled rows that are not held out."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    # at most fit_rows ids, so they may be broadcast
    chosen = usable.withColumn("__k", F.xxhash64("doc_id")).orderBy("__k", "doc_id").limit(fit_rows).drop("__k")
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(chosen), "doc_id").select("text", F.col("__toxic").cast("int"))
    return [(t, y) for t, y in rows.toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    return fit(training_rows(docs, labels, fit_rows))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add the score of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            values = [scorer.score(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.float64())], names=[*b.schema.names, out])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, {out} double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    scored = score(docs, train(docs, labels)).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
