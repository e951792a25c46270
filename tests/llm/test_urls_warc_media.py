import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import odd
from talweg.llm import media, queries, url_filter, warc
from talweg.llm.common import scratch, stored

URLS = ["http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://www.example.net/en/", "http://example.com/de/7#f", "http://x.org/fr/1", "ftp://b.org", "no scheme", None, "", "http://net", "http://a.net", "http://user@c.net:80/en/", "x://y://z.net/"]


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
    fits = [(len(h.split(".")), len(p), a == "block", a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[4], best[3] if best else "allow"


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_urls(spark, most):
    """The broadcast trie and the join give what trying every rule gives."""
    rules = [*queries.URL_RULES, ("allow", "a.net", "/x"), ("block", "a.net", "/x"), ("allow", "net", "/en"), ("block", "y", ""), ("allow", "", "")]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules, broadcast_bytes=most).collect()}
    for i, u in enumerate(URLS):
        assert got[i] == brute(u, rules), u


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_urls_rules_with_nulls(spark, most):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame([("block", None, None), ("block", "net", None), (None, "a.net", "/")], "action string, host string, path string")
    r = url_filter.filter_urls(df, rules, broadcast_bytes=most).first()
    assert (r.rule, r.verdict) == ("net", "block")


def test_urls_rules_table_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "action string, host string, path string")
    assert url_filter.filter_urls(df, rules).first().verdict == "block"
    assert url_filter.filter_urls(df, []).first().rule is None
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


@given(st.binary(max_size=3000), st.integers(1, 700))
@settings(max_examples=60, deadline=None)
def test_chunks(data, size):
    assert warc.dechunk(warc.chunked(data, size)) == data
    assert warc.dechunk(warc.chunked(data, size)[:-3]) is None


@given(st.binary(max_size=2000), st.integers(1, 300))
@settings(max_examples=40, deadline=None)
def test_segments(payload, segment):
    found = list(warc.parse_records(io.BytesIO(b"".join(warc.page_records(5, "http://a/ b", payload, "response", None, "u", segment)))))
    block = b"".join(b for _, b in found)
    assert warc.dechunk(block.partition(b"\r\n\r\n")[2]) == payload
    if len(found) > 1:
        assert [int(h["warc-segment-number"]) for h, _ in found] == list(range(1, len(found) + 1))
        assert int(found[-1][0]["warc-segment-total-length"]) == len(block)
    assert found[0][0]["warc-target-uri"] == "http://a/%20b"


def test_archives_round_trip(spark):
    rows = [(1, "u", b"same"), (2, "u", b"same"), (2, "u", b"same"), (3, None, b""), (4, "u\r\nX: y", b""), (5, "u", bytes(range(256)) * 900), (None, "u", b"same"), (6, "u", None), (7, "u", b"alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    marked = warc.mark_revisits(df.fillna({}), min_bytes=0)
    got = warc.read_archives(spark, warc.write_archives(marked, scratch(spark, "t"), segment_bytes=1000, archive_bytes=2000)).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"ok"}
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, p in rows:
        r = by[i][0]
        assert r.payload_bytes == len(p or b"") and r.payload_digest == warc.base32_sha1(p or b"")
        if r.record_type == "response":
            assert bytes(r.payload) == (p or b"")
    assert by[1][0].record_type == "revisit" and by[1][0].refers_to == 2 and by[2][0].record_type == "response"
    assert by[3][0].refers_to == 4


def test_broken_segments(spark):
    df = spark.createDataFrame([(1, "u", b"x" * 5000)], "page_id long, url string, payload binary")
    manifest = warc.write_archives(warc.mark_revisits(df), scratch(spark, "t"), segment_bytes=1000)
    lost = warc.read_records(manifest).filter("segment IS NULL OR segment != 2")
    assert [r.status for r in warc.reassemble(lost).collect()] == ["incomplete"]


def test_uncompressed_archives_and_digests(spark, tmp_path):
    whole = b"".join(b"".join(warc.page_records(i, "u", bytes([65 + i]) * 3000, "response", None, "x", 1000)) for i in range(3))
    other = b"".join(warc.page_records(9, "u", b"text", "response", None, "x")).replace(b"sha1:", b"md5:")
    (tmp_path / "a.warc").write_bytes(whole.replace(b"B" * 500, b"B" * 499 + b"x", 1) + other)
    manifest = spark.createDataFrame([(str(tmp_path / "a.warc"),)], "path string")
    got = {r.page_id: r for r in warc.read_archives(spark, manifest).collect()}
    assert {i: r.status for i, r in got.items()} == {0: "ok", 1: "bad_digest", 2: "ok", 9: "ok"}
    assert got[1].declared_digest == warc.base32_sha1(b"B" * 3000) != got[1].payload_digest == warc.base32_sha1(bytes(got[1].payload))


def test_empty_archives(spark):
    df = spark.createDataFrame([], "page_id long, url string, payload binary")
    assert warc.read_archives(spark, warc.write_archives(warc.mark_revisits(df), scratch(spark, "t"))).count() == 0


@given(st.binary(max_size=5000))
@settings(max_examples=40, deadline=None)
def test_wav(data):
    assert media.unwav(media.wav(data)) == (media.RATE, data)


def test_resampling_keeps_low_tones():
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    got = media.resample(tone)
    want = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    assert len(got) == 8000 and np.abs(got[200:-200] - want[200:-200]).max() < 0.02
    high = media.resample(np.sin(2 * np.pi * 6000 * t).astype(np.float32))
    assert np.abs(high[200:-200]).max() < 0.05


def test_mel_and_segments():
    t = np.arange(16000) / 16000
    x = np.concatenate([np.zeros(16000), np.sin(2 * np.pi * 1000 * t), np.zeros(16000)])
    mel, spans, step = media.features((x * 100 + 128).astype(np.uint8).tobytes())
    centre = np.argmax(mel[len(mel) // 2])
    assert 8 <= centre <= 16 and len(spans) == 1
    assert abs(spans[0][0] * step - 1) < 0.1 and abs(spans[0][1] * step - 2) < 0.1


def test_media_rows(spark):
    docs = media.text_payload(odd.documents(spark))
    got = media.summaries(media.media_column(docs.select("doc_id", "text", "payload"), "payload")).collect()
    assert len(got) == len(odd.TEXTS)
    for r in got:
        data = (r.text or "").encode()
        pad = data + bytes(-len(data) % 64 if data else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(pad)).hexdigest() and r.media_bytes == len(media.wav(pad))
    same = [r.feature for r in got if r.doc_id in (1, 9)]
    assert same[0] == same[1]
    assert media.summaries(media.media_column(docs.limit(0).select("doc_id", "payload"), "payload")).count() == 0


def test_media_clashing_columns(spark):
    """Columns named as an output are replaced, others are kept."""
    docs = odd.documents(spark).withColumns({c: F.lit("old") for c in ("media", "tensors", "payload", "feature", "spans", "other")})
    got = media.summaries(media.with_tensors(media.media_column(media.text_payload(docs), "payload"))).collect()
    assert len(got) == len(odd.TEXTS) and {r.other for r in got} == {"old"} and "old" not in {r.feature for r in got}


def slow_segments(db, high, low):
    spans, begin = [], None
    for i, v in enumerate(db):
        if begin is None and v >= high:
            begin = i
        elif begin is not None and v < low:
            spans.append((begin, i))
            begin = None
    return spans + ([(begin, len(db))] if begin is not None else [])


@given(st.lists(st.floats(-30, 30, width=32), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_hysteresis(values):
    mel = np.array(values, np.float32)[:, None] * np.log(10) / 10
    db = 10 / np.log(10) * mel.max(axis=1)
    assert media.segments(mel) == slow_segments((db - db.mean()).tolist(), media.HIGH_DB, media.LOW_DB)


def test_tensors(spark):
    docs = media.text_payload(odd.documents(spark).filter("doc_id IN (1, 5)")).select("doc_id", "payload")
    table = media.tensor_rows(media.media_column(docs, "payload"), "doc_id").toArrow()
    tensors = media.as_tensors(table.column("tensor"))
    assert tensors.type.shape == [media.FRAMES, media.MELS] and len(tensors) == table.num_rows > 2
    assert all(b > a for a, b in zip(table.column("from_s").to_pylist(), table.column("to_s").to_pylist(), strict=True))


def test_summaries_from_stored_tensors(spark, monkeypatch):
    """op7 stores the tensors of every document, and what it returns is derived from them."""
    kept = []
    monkeypatch.setattr(queries, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    monkeypatch.setattr(queries, "_table", lambda *_: odd.documents(spark))
    got = sorted(map(str, queries.op7_media(spark, "").collect()))
    rows = kept[0].collect()
    assert len(rows) == len(odd.TEXTS)
    for r in rows:
        mel, _, step = media.features(*reversed(media.unwav(bytes(r.media))))
        assert {len(t.tensor) for t in r.tensors} == {4 * media.FRAMES * media.MELS} and r.tensors[-1].to_s == len(mel) * step
        assert np.allclose(media.frames_of([t.asDict() for t in r.tensors]), mel, atol=1e-3)
    assert got == sorted(map(str, media.summaries(kept[0].drop("tensors")).collect()))
