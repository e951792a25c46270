"""The pipeline against brute force, stage by stage, each on what the stage before kept."""

import math
import zlib
from collections import Counter

import pytest
from test_texts import brute_components, brute_lines, near_lines, near_texts, toxic_rows

import corpus_pipeline
from talweg.llm import packing, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents and labels: toxic and clean texts, near copies, repeated lines, and odd rows."""
    d = tmp_path_factory.mktemp("tables")
    toxic = toxic_rows(300)
    rows = [(i, t) for i, t, _ in toxic] + [(10_000 + i, t) for i, t in near_lines()] + [(20_000 + i, t) for i, t in near_texts(40) if i is not None]
    docs = [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, tables).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, out)
        before = out
    assert all(kept[n][1].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])

    old, new = kept["toxicity"]
    scorer = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet")))
    assert Counter((r.doc_id, r.text) for r in new.collect()) == Counter((r.doc_id, r.text) for r in old.collect() if scorer.score(r.text or "") < toxicity.THRESHOLD)
    truth = {i: y for i, _, y in toxic_rows(300)}
    stay = {r.doc_id for r in new.collect()}
    test = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((i in stay) == (truth[i] == 0) for i in test) >= 0.97 * len(test)

    old, new = kept["line_dedup"]
    rows = [(r.doc_id, r.text) for r in old.collect()]
    want = brute_lines(rows)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in new.collect()) == Counter((i, t if t is None else want[i, t], 0 if t is None else len(want[i, t])) for i, t in rows)

    old, new = kept["ngram_jaccard"]
    rows = [(r.doc_id, r.text) for r in old.collect()]
    found = brute_components(rows)
    firsts = {c for _, n, c in found if n}
    got = Counter((r.doc_id, r.text) for r in new.collect())
    assert {i for i, t in got if (t or "").split()} == firsts and all(got[x] == 1 for x in got if (x[1] or "").split())
    assert sum(n for (_, t), n in got.items() if not (t or "").split()) == sum(c for (_, n, _), c in found.items() if not n)

    old, new = kept["mixing"]
    sizes, taken, times = Counter(), Counter(), Counter()
    for r in old.collect():
        sizes[r.source] += len((r.text or "").split())
    for r in new.collect():
        taken[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [1, 2, 3] * len(sizes), strict=False))
    goal, left = {}, set(sizes)
    while left:
        level = (sum(sizes.values()) - sum(goal.values())) / sum(weights[s] for s in left)
        over = {s for s in left if level * weights[s] >= 3 * sizes[s]}
        goal |= {s: 3.0 * sizes[s] if over else level * weights[s] for s in over or left}
        left -= over or left
    assert {s: taken[s] for s in sizes} == {s: math.floor(goal[s] + 0.5) for s in sizes} and max(times.values()) <= 3

    old, new = kept["packing"]
    tok, pieces = packing._tokenizer(packing.tokenizer_path()), Counter()
    for r in old.collect():
        data = tok._ids(r.text or "") + (2).to_bytes(4, "little")
        pieces.update((r.doc_id, s // 4, zlib.crc32(data[s : s + 16384])) for s in range(0, len(data), 16384))
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in new.collect()) == pieces


def test_run(spark, tables):
    got = corpus_pipeline.run(spark, tables)
    assert got.count() > 100 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
