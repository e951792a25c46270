import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import odd
from talweg.llm import common, fingerprint, jaccard_join, license_scan, line_dedup, mixing, packing, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- license scan


def brute_labels(text):
    words, labels, best = WORD.findall(low(text)), set(), 0.0
    base = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    longest = max(len(WORD.findall(t)) for _, t in license_scan.TEMPLATES)
    for s in range(0, max(1, len(words) - longest), longest):
        block = set(words[s : s + 2 * longest])
        for label, t in license_scan.TEMPLATES:
            want = set(WORD.findall(low(t)))
            tells = want & license_scan.TELLING <= block and not block & set(license_scan.AGAINST.get(label, ()))
            if block and tells and len(block & want) >= math.ceil(0.8 * len(want) - 1e-9):
                labels.add(label)
                best = max(best, len(block & want) / len(want))
    at = [i for i, _ in base]
    names = {x for _, x in base}
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(names | labels)), max(best, 1.0 if base else 0.0)


LICENSES = [
    (1, "Licensed under the Apache License, Version 2.0."), (2, "MIT license mit LICENSE, Mit\tLicense\nmit-license"), (3, "released under this MIT"), (4, "cc by; CC-BY-NC 4.0. Licensed under"),
    (5, "word " * 70 + "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the conditions are met"), (6, "gnu general public\nlicense"), (7, None), (8, ""), (8, ""),
    (9, "the software of this license is free to use in any version"), (10, "Licensed under the GNU Affero General Public License" + " pad" * 200), (11, "émit license mité license ｍit license"), (None, "apache license"),
]


def test_license_scan(spark):
    rows = [*LICENSES, (20, odd.LONG)]
    got = license_scan.scan(odd.documents(spark, rows)).collect()
    want = Counter((i, *brute_labels(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got) == want
    assert license_scan.scan(odd.empty(spark)).count() == 0


NOTICES = {
    "This work is licensed under the GNU General Public License v3.": "gpl",
    "This work is licensed under the GNU Lesser General Public License v3.": "lgpl",
    "Licensed under the GNU Affero General Public License": "agpl",
    "Licensed under CC BY 4.0.": "cc-by",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa",
    "Released under the BSD License.": "bsd",
    "Released under the MIT License.": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files": "mit",
    "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met": "bsd",
    "You can read this under the tree in the park with a general book.": "",
}


def test_license_labels_of_plain_notices(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert got == dict(enumerate(NOTICES.values()))


# --- fingerprints


def canonical(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return re.sub(r"[\s\x1c-\x1f]+", " ", t).strip(" ")


def test_canonical(spark):
    texts = ["Ａ ﬁ\u00a0\u2003x\r\n", "STRASSE straße", "e\u0301 é", " \t", "", "İ", "日本\u3000語"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprint.canonical(F.col("t"))).collect()]
    assert got == [canonical(t) for t in texts]


def brute_prints(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(nxt))))
    return Counter(out)


@pytest.mark.parametrize("rows", [odd.TEXTS, [(5, "only one row of text")], [(i, f"text {i // 3} of many") for i in range(300)]])
def test_fingerprints(spark, rows):
    got = fingerprint.compare_with_edits(odd.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == brute_prints(rows)


def test_fingerprint_groups_and_collisions(spark):
    rows = [(1, "Ab  c"), (2, "ab C"), (3, "abc"), (4, None), (5, " "), (6, "ab c")]
    got = {r.doc_id: (r.first_id, r.copies) for r in fingerprint.duplicate_groups(odd.documents(spark, rows)).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 6: (1, 3), 3: (3, 1), 4: (4, 2), 5: (4, 2)}
    many = [(i, f"text {i}") for i in range(60)] + [(100 + i, f"TEXT {i}") for i in range(60)]
    weak = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(odd.documents(spark, many), bits=3).collect()}
    assert len(set(weak.values())) == 60 and all(weak[i] == weak[100 + i] for i in range(60))
    assert fingerprint.compare_with_edits(odd.empty(spark)).count() == 0


# --- line dedup


def brute_lines(rows):
    """Text by (doc_id, text) after keeping the first line of each component of near-equal lines."""
    docs = sorted({(i, t or "") for i, t in rows if i is not None})
    spots = [(i, k, s.strip(" ").lower()) for i, t in docs for k, s in enumerate(t.split("\n")) if s.strip(" ")]
    grams = {s: line_dedup.shingles(s) for _, _, s in spots}
    names = list(grams)
    root = {s: s for s in names}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for k, a in enumerate(names):
        for b in names[:k]:
            both = len(grams[a] & grams[b])
            if both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
                root[find(a)] = find(b)
    seen, keep = set(), set()
    for i, k, s in spots:
        if find(s) not in seen:
            seen.add(find(s))
            keep.add((i, k))
    return {(i, t): "\n".join(s for k, s in enumerate(t.split("\n")) if not s.strip(" ") or (i, k) in keep) for i, t in docs}


def near_lines():
    rng = np.random.default_rng(4)
    base = [" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(int(rng.integers(3, 40)))) for _ in range(30)]
    rows = []
    for d in range(60):
        lines = []
        for k in rng.integers(0, 30, 5):
            s = list(base[k])
            if rng.random() < 0.5:
                s[int(rng.integers(0, len(s)))] = "Z"
            lines.append("".join(s))
        rows.append((d, "\n".join(lines)))
    return [*rows, (60, None), (61, ""), (62, "\n \n"), (63, "ab"), (64, "AB "), (64, "AB "), (65, odd.LONG)]


def test_line_dedup(spark):
    rows = near_lines()
    got = line_dedup.dedup_lines(odd.documents(spark, rows), counts=True).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    assert all(r.text == want[i, t] if t is not None else r.text is None for r in got for i, t in [next(x for x in rows if x[0] == r.doc_id)])
    assert {r.score for r in got} == {"kept"}
    assert line_dedup.dedup_lines(odd.empty(spark)).count() == 0


def test_line_dedup_odd_rows(spark):
    assert line_dedup.dedup_lines(odd.documents(spark)).count() == len(odd.TEXTS)


def family(n, n_copies, seed=7):
    """Lines of one template that are alike below 0.8, so they fill the same buckets, and copies above 0.8 of some."""
    rng = np.random.default_rng(seed)
    word = lambda n, letters="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(list(letters), n))
    head, tail = word(100), word(110)
    lines = [head + word(30) + tail for _ in range(n)]
    return lines, [s[:170] + word(20, "0123456789") + s[190:] for s in lines[:n_copies]]


@pytest.mark.parametrize("n", [1000, 3000])
def test_line_dedup_template_family(spark, n):
    """The pairs above 0.8 in a family of lines below 0.8 are found; 16 bands of four miss two in 10,000 of them."""
    lines, copies = family(n, n // 5)
    rows = [*enumerate(lines), *enumerate(copies, n)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == t for i, t in enumerate(lines))
    assert sum(got[n + i] == "" for i in range(len(copies))) >= 0.99 * len(copies)


@given(st.lists(st.text(alphabet="abcé\0", max_size=12), min_size=1, max_size=6), st.lists(st.text(alphabet="abcé\0", max_size=12), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_alike_in_block(x, y):
    got = line_dedup.alike_in_block(x, y)
    assert got.tolist() == [[line_dedup.jaccard_at_least(a, b) for b in y] for a in x]


def test_alike_in_block_of_many_letters():
    rng = np.random.default_rng(1)
    x = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 300))) for _ in range(60)]
    y = [s[:150] + "x" + s[150:] for s in x[:30]] + ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 40))) for _ in range(5)]
    assert line_dedup.alike_in_block(x, y).tolist() == [[line_dedup.jaccard_at_least(a, b) for b in y] for a in x]


def test_line_dedup_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SMALL", 2)
    rows = near_lines()
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(odd.documents(spark, rows)).collect())
    want = brute_lines(rows)
    assert got == Counter((i, want[i, t] if t is not None else None) for i, t in rows)


def test_line_dedup_large_bucket_makes_no_row_a_pair(spark):
    """Sixty lines of a template, all with agreeing sketches, are given as lines, not as 1770 pairs; 59 alone is in the main component."""
    lines, _ = family(60, 0)
    bits = line_dedup.sketches(line_dedup.signatures(lines), np.zeros(60)).view(np.int64).tolist()
    assert line_dedup.sketches_agree(*np.array(bits, np.int64).view(np.uint64)[[[0], [1]]]).all()
    e = spark.createDataFrame([(7, i, b, m, i, 59) for i, (b, m) in enumerate(bits)], "bucket long, id long, bits long, more long, root long, main long")
    got = line_dedup._open_pairs(e).collect()
    assert len(got) <= 120 and {r.a for r in got if r.b is None and r.bucket == 7} == set(range(59))
    assert {(r.a, r.b) for r in got if r.b is not None} == {(i, 59) for i in range(59)}


def test_line_dedup_reads_no_far_lines_of_large_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("abcdefghij"), 300))) for i in range(70)]
    none = pa.nulls(70, pa.int64())

    def part(key, table):
        """All lines in one bucket, given once."""
        ids = common.gathered(table.column("a1"), "<i8")
        ids, at = np.unique(ids, return_index=True)
        bits = common.gathered(table.column("a2"), "<u8").reshape(-1, 2)[at].view(np.int64)
        empty = none.slice(0, len(ids))
        return pa.table({"a": empty, "b": empty, "bucket": np.full(len(ids), 7), "id": ids, "bits": bits[:, 0], "more": bits[:, 1], "first": np.zeros(len(ids), bool)})

    read, real = [], line_dedup._lines_of
    monkeypatch.setattr(line_dedup, "_pairs_of_part", part)
    monkeypatch.setattr(line_dedup, "_lines_of", lambda docs, ids: (read.append(ids.count()), real(docs, ids))[1])
    docs = line_dedup._line_ids(spark.createDataFrame(rows, "doc_id long, text string"))
    assert line_dedup.line_components(docs).count() == 0
    assert sum(read) == 0


def test_line_dedup_clashing_columns(spark):
    rows = odd.documents(spark).withColumns({c: F.lit("kept") for c in ("drop", "root", "id", "line")})
    got = line_dedup.dedup_lines(rows).collect()
    assert len(got) == len(odd.TEXTS) and {r["drop"] for r in got} == {"kept"}


def test_line_dedup_recall_at_threshold():
    """Of pairs just above 0.8, at most 1 in 1000 shares no band or is dropped by its sketches."""
    rng = np.random.default_rng(3)
    word = lambda n, letters="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(list(letters), n))
    x = [word(400) for _ in range(3000)]
    y = [s[:200] + word(39, "0123456789") + s[239:] for s in x]
    assert all(0.8 <= (lambda p, q: len(p & q) / len(p | q))(line_dedup.shingles(a), line_dedup.shingles(b)) < 0.81 for a, b in zip(x, y, strict=True))
    p, q = line_dedup.signatures(x), line_dedup.signatures(y)
    found = (line_dedup.band_keys(p) == line_dedup.band_keys(q)).any(axis=1)
    found &= line_dedup.sketches_agree(*(line_dedup.sketches(s, np.zeros(len(s))) for s in (p, q)))
    assert (~found).sum() <= 3


def test_line_dedup_far_lines_are_no_candidates():
    """Of lines that share a phrase only (Jaccard about 0.15), at most 1 of 10,000 pairs is verified."""
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    lines = [word(16) + " in the end " + word(16) for _ in range(600)]
    sig = line_dedup.signatures(lines)
    keys, bits = line_dedup.band_keys(sig), line_dedup.sketches(sig, np.ones(len(lines)))
    p, q = np.triu_indices(len(lines), 1)
    found = (keys[p] == keys[q]).any(axis=1) & line_dedup.sketches_agree(bits[p], bits[q])
    assert found.sum() <= len(p) // 10_000


def test_line_dedup_recall_of_short_lines():
    """Lines of 12 characters and the same with one more (7 or 8 of 9 shingles shared) are candidates."""
    rng = np.random.default_rng(5)
    x = ["".join(rng.choice(list("abcdefghijklmnop "), 12)) for _ in range(3000)]
    y = [s + "z" for s in x]
    p, q = line_dedup.signatures(x), line_dedup.signatures(y)
    found = (line_dedup.band_keys(p) == line_dedup.band_keys(q)).any(axis=1)
    found &= line_dedup.sketches_agree(*(line_dedup.sketches(s, np.ones(len(s))) for s in (p, q)))
    assert (~found).sum() <= 3


@given(st.lists(st.tuples(st.text(max_size=12), st.text(alphabet="abcé\0", max_size=12)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_alike_pairs(pairs):
    pairs += [(s, s + "a") for s, _ in pairs] + [(t + "x", t) for _, t in pairs]
    x, y = [s for s, _ in pairs], [t for _, t in pairs]
    assert line_dedup.alike_pairs(x, y).tolist() == [line_dedup.jaccard_at_least(a, b) for a, b in pairs]


# --- n-gram Jaccard join


def brute_sets(rows):
    out = []
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def brute_components(rows):
    sets = brute_sets(rows)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((i, len(s), (least.get(find(k)) if s else i)) for k, (i, s) in enumerate(sets))


def near_texts(n=160):
    """Groups of near copies whose likeness straddles the bound, and unlike texts that share a passage."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklm"), 4)) for _ in range(3000)]
    passage = list(rng.choice(words, 30))
    rows = []
    for k in range(n):
        if k % 2:
            base = np.random.default_rng(k % 8).choice(words, 120).tolist()
            for j in rng.integers(0, 120, int(rng.integers(0, 6))):
                base[j] = str(rng.choice(words))
        else:
            base = [*passage, *rng.choice(words, 60)]
        rows.append((k, " ".join(base)))
    return [*rows, *((1000 + i if i is not None else None, t) for i, t in odd.TEXTS)]


@pytest.mark.parametrize("long_list", [2, 12])
def test_jaccard_components(spark, monkeypatch, long_list):
    rows = near_texts()
    monkeypatch.setattr(jaccard_join.join_sets, "__defaults__", (jaccard_join.PERCENT, long_list))
    got = jaccard_join.classes(odd.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_jaccard_keeps_one(spark):
    rows = near_texts(60)
    kept = jaccard_join.keep_one(odd.documents(spark, rows)).collect()
    whole = brute_components(rows)
    firsts = {c for i, n, c in whole if n and c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None and (r.text or "").strip()) == sorted(firsts)
    assert sum(not (r.text or "").strip() for r in kept) == 3
    assert jaccard_join.keep_one(odd.empty(spark)).count() == 0


@given(st.lists(st.text(alphabet="aB \n\t\x0bé\u00a0", max_size=60), max_size=6))
@settings(max_examples=100, deadline=None)
def test_shingle_counts(texts):
    assert [len(s) for s in jaccard_join.shingle_sets(texts)] == [len(s) for _, s in brute_sets(list(enumerate(texts)))]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- toxicity


def toxic_rows(n=500):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9)))) for _ in range(800)]
    rows = []
    for k in range(n):
        t, y = rng.choice(words, 60).tolist(), int(k % 6 == 0)
        for _ in range(2 if y else 0):
            t[int(rng.integers(0, 60))] = str(rng.choice(["grobble", "snarkwit", "dunderpate", "zzq" + "".join(rng.choice(list("abcdef"), 4))]))
        rows.append((k, " ".join(t), y))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    truth = {i: y for i, _, y in rows}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    test = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in test]) > 0.97
    assert got[9001].score == got[9002].score < 0.5
    assert got[9001].predicted == 0


def test_toxicity_without_labels(spark):
    docs = odd.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, none).collect()
    assert len(got) == len(odd.TEXTS) and all(abs(r.score - toxicity.PRIOR) < 1e-9 for r in got)
    assert toxicity.judge(odd.empty(spark), none).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i] + [0] * len(b) if (old := row) else row
        for j, d in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (c != d))
    return row[-1]


@given(st.text(alphabet="abcdeé", max_size=12))
@settings(max_examples=300, deadline=None)
def test_automaton(word):
    terms = ["abcde", "abced", "bad", "deadbeaded", "éabcd"]
    got = MATCHER.match(word)
    near = [(distance(word, t), t) for t in terms if distance(word, t) <= toxicity.errors_allowed(t)]
    if word.startswith("cab") and (0, word) not in near:
        assert got == (5, 0)
    elif near:
        assert got is not None and (got[1], MATCHER.terms[got[0]]) in near and got[1] == min(near)[0]
    else:
        assert got is None


MATCHER = toxicity.Matcher(["abcde", "abced", "bad", "deadbeaded", "éabcd"], ["cab"])


def test_quotation():
    model = toxicity.Model(["grobble"], [], [5.0], [5.0], (-4.0, 1.0, 0.2, 0.9, 0.1))
    s = toxicity.Scorer(model)
    assert s.score("you grobble") > 0.7 > s.score('he was called "a grobble" yesterday') and s.score("you Grobbl grobblee") > 0.7


# --- mixing


def test_targets(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 500), (None, 0), ("d", 40)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True))
    caps = {s: 3 * n for s, n in sizes}
    want, open_ = {}, set(caps)
    while open_:
        level = (sum(n for _, n in sizes) - sum(want.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] >= caps[s]}
        if not over:
            want |= {s: level * weights[s] for s in open_}
            break
        want |= {s: float(caps[s]) for s in over}
        open_ -= over
    assert got == pytest.approx(want)


def test_mixing(spark):
    rows = [*odd.TEXTS, *((2000 + k, "w " * (k % 37)) for k in range(300))]
    got = mixing.mix(odd.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == math.floor(own[0].target + 0.5)
        assert all(0 <= r.taken <= 3 * r.size and sum(p.words for p in r.positions) == r.taken for r in own)
    again = mixing.mix(odd.documents(spark, rows).repartition(7)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix(odd.empty(spark)).count() == 0


def test_schedules(spark):
    u = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    for knots in mixing.SCHEDULES:
        for r in u.select("u", mixing.invert_schedule(F.col("u"), knots).alias("t")).collect():
            t = np.linspace(0, r.t, 2001)
            assert abs(np.trapezoid(np.interp(t, *zip(*knots, strict=True)), t) - r.u) < 1e-6


def test_training_order(spark):
    docs = odd.documents(spark, [(k, f"a{k} b c d e") for k in range(50)])
    mixed = mixing.mix(docs)
    rows = mixing.training_order(mixed, ["doc_id", "text", "source"]).collect()
    words = Counter()
    for r in rows:
        words[r.source] += len(r.text.split())
    assert words == {r.source: math.floor(r.target + 0.5) for r in mixed.collect()}


# --- packing


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    own, lib = packing.ChunkTokenizer(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    texts = [t or "" for _, t in odd.TEXTS] + ["It's DON'T we'll", "İstanbul Σας ǅ ŉ", "<|endoftext|> a<|endoftext|>b", "a\x1cb\x85c\u2028d", "e\u0301 ﬁ ½² 12345", "!!!###a$$$b", "\u0345 x"]
    for t in texts:
        assert own.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_tokens_of_another_file():
    """A tokenizer with other steps before its model is used as it is."""
    from tokenizers import Tokenizer

    path = str(Path(packing.tokenizer_path()).with_name("byte_bpe_50k.json"))
    own, lib = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    for t in ("It's  DON'T\n we'll", "Plain Words", "naïve 日本語"):
        assert own.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_tokens_of_any_text(text):
    tok = packing._tokenizer(packing.tokenizer_path())
    assert tok.encode(text) == tok._ids(text)


@given(st.lists(st.integers(0, 30), min_size=16, max_size=16))
@settings(max_examples=60, deadline=None)
def test_patterns_cut_the_demand(demand):
    demand = np.array(demand)
    patterns, counts = packing.solve_patterns(demand)
    assert ((patterns * counts[:, None]).sum(axis=0) == demand).all()
    assert (patterns @ np.arange(1, 17) <= 16).all() and (counts > 0).all()
    least = math.ceil((demand * np.arange(1, 17)).sum() / 16)
    assert counts.sum() <= least + max(3, 0.35 * least) or demand[8:].sum() >= counts.sum() - 17


def test_packing(spark):
    rows = [*odd.TEXTS, *((2000 + k, "tok " * (k * 7 % 900)) for k in range(200))]
    docs = odd.documents(spark, rows)
    got = packing.pack_documents(docs).collect()
    lib = packing._tokenizer(packing.tokenizer_path())
    want = Counter()
    for i, t in rows:
        data = lib._ids(t or "") + (2).to_bytes(4, "little")
        for s in range(0, len(data), 4 * 4096):
            want[i, s // 4, len(data[s : s + 4 * 4096]) // 4, zlib.crc32(data[s : s + 4 * 4096]), len(data) // 4] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(seqs) <= 1.1 * sum(r.length for r in got) / 4096 + 2
    assert packing.pack_documents(odd.empty(spark)).count() == 0


def test_packing_makes_a_frequent_chunk_once():
    """140,000 different chunks in turn are made once each, not again in the second round."""
    tok, made = packing.ChunkTokenizer(packing.tokenizer_path()), []
    tok._chunk._make = lambda c: made.append(c) or b""
    for _ in range(2):
        tok.encode(" ".join(f"a{i}" for i in range(140_000)))
    assert len(made) == 140_000
