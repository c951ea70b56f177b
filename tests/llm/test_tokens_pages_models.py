"""Tokenizer round trips, archives, URL verdicts and the toxicity model."""

import base64
import gzip
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftloom.llm import byte_bpe, packing, reputation, toxicity, warc
from siftloom.llm.arrays import text_buffers
from siftloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    bpe = byte_bpe.codec(RANKS)
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    ids, first = bpe.encode(data, offsets)
    assert bpe.decode(ids).tobytes() == data.tobytes()
    return [ids[first[i]: first[i + 1]].tolist() for i in range(len(texts))]


PARTS = st.sampled_from(["'", "'s", "'ll", "'LL", "s", "re", " ", "  ", "\n", "\r\n", "\t", "a", "Zé", "1", "²", "½", "!", "\u00a0", "\u2003",
                         "日本", "😀", "e\u0301", "\x1c", "\x85", "\u200b", "don't", "_", "٣", "<|endoftext|>", "İ", "Σ", "ſ", "ß"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join) | st.text(max_size=20), min_size=1, max_size=20))
def test_ids_equal_the_libraries(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = _cached(ranks)
    assert encode(texts) == [own.encode_ordinary(t) for t in texts]
    word = packing.codec(public_tokenizers.path("word_bpe_49k.json"))
    ids, first = word.encode(pa.array(texts, pa.string()))
    library = _library()
    assert [ids[first[i]: first[i + 1]].tolist() for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


_CACHE = {}


def _cached(ranks):
    if "tik" not in _CACHE:
        _CACHE["tik"] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE["tik"]


def _library():
    from tokenizers import Tokenizer

    if "word" not in _CACHE:
        _CACHE["word"] = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return _CACHE["word"]


def test_every_assigned_character():
    points = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x32000, 3)]]
    texts = [f"a{c}1 {c}{c}" for c in points]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    assert encode(texts) == [_cached(ranks).encode_ordinary(t) for t in texts]


def test_byte_bpe_query(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op3_byte_bpe"](spark, SF).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_offsets_and_decoding(spark):
    texts = ["naïve café 😀😀 日本語", "", None, "plain text", "x" * 5000]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "k int, text string, ends string")
    rows = byte_bpe.decode(byte_bpe.encode(df, RANKS), RANKS).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = r.text or ""
        assert r.decoded_text == text and bytes(r.decoded) == text.encode()
        bpe = byte_bpe.codec(RANKS)
        for i, a, z in zip(r.ids, r.starts, r.ends, strict=True):
            piece = bpe.decode(np.array([i])).tobytes()
            assert piece in text[a:z].encode() and 0 <= a < z <= len(text)
    assert byte_bpe.encode(df.limit(0), RANKS).collect() == []


def captures(spark, rows, folder):
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return QUERIES["op2_warc_captures"](spark, folder).collect()


def test_warc_round_trip(spark, folder):
    same, accents = "x" * 200, "é\r\n\r\n" * 30
    rows = [(5, "http://a/b?c", same), (3, None, same), (7, "http://e/\r\nWARC/1.1", same), (8, "http://z", None), (10, "u://é", accents), (11, "u", accents),
            (9, "", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 100), (12, "u", "s"), (13, "u", "s"), (13, "u", "s"), (None, "n", same)]
    expected = []
    for key, _, html in rows:
        body = (html or "").encode()
        first = min(k for k, _, h in rows if h == html and k is not None) if len(body) >= 100 else key
        expected.append((key, len(body), hashlib.sha256(body).hexdigest(), "response" if first == key else "revisit", None if first == key else first))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in captures(spark, rows, folder)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_warc_payloads_and_empty_table(spark, folder):
    pages = spark.createDataFrame([(1, "http://a/b?c#d", "<p>" + "z" * 300), (2, "http://c", "")], "page_id long, url string, html string")
    warc.write(pages, f"{folder}/archive")
    rows = {r.metadata.fields["page-id"]: r for r in warc.assemble(warc.read(spark, f"{folder}/archive")).collect()}
    assert bytes(rows["1"].answer.payload).decode() == "<p>" + "z" * 300 and rows["1"].request.http["host"] == "a"
    assert bytes(rows["2"].answer.payload) == b"" and rows["2"].request.concurrent_to == rows["2"].capture_id
    assert captures(spark, [], f"{folder}/empty") == []
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.parse(b"something else"))


def test_warc_files_are_bounded_by_bytes(spark, folder, monkeypatch):
    """Small, middle and large payloads go to files of their own bounds and come back whole."""
    monkeypatch.setattr(warc, "CLASSES", (100, 5_000))
    monkeypatch.setattr(warc, "FILE_BYTES", 60_000)
    monkeypatch.setattr(warc, "PIECE_BYTES", 700)
    rows = [(i, f"http://h/{i}", chr(97 + i % 26) * (i * 37 % 90)) for i in range(60)] + [(100 + i, "http://m", f"{i}" * 900) for i in range(40)]
    rows += [(200 + i, "http://l", f"{i}" + "z" * 70_000) for i in range(3)]
    got = captures(spark, rows, folder)
    assert sorted((r.page_id, r.payload_bytes) for r in got) == sorted((k, len(h)) for k, _, h in rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages.coalesce(1), f"{folder}/archive")
    sizes = [sum(len(x["payload"] or b"") for x in warc.parse(r.content)) for r in spark.read.format("binaryFile").load(f"{folder}/archive/part-*").collect()]
    # no more payload in a file than the bound, but for the single captures above it
    assert len(sizes) >= 6 and sorted(sizes)[-4] <= 60_000 and sorted(sizes)[-3:] == [70_001] * 3


def test_warc_members_and_broken_files():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <x>\r\nContent-Length: 8\r\n\r\na: b\r\nc:\r\n\r\n"
    plain = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <y>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    for body in (record + plain, gzip.compress(record) + gzip.compress(plain), gzip.compress(record + plain)):
        first, second = warc.parse(body)
        assert first["fields"] == {"a": "b", "c": ""} and (second["payload"], second["http"]) == (b"", {})
    for broken in (record[:-9], gzip.compress(record)[:-20], b"WARC/1.1\r\nno end", b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError, match="no WARC|gzip"):
            list(warc.parse(broken))
    assert list(warc.parse(b"")) == []


def test_url_verdicts(spark):
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    got = QUERIES["op7_url_reputation"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(ORACLES["op7_url_reputation"]).fetchall(), key=str)


def test_reputation_and_edges(spark):
    pages = spark.createDataFrame(
        [(1, "http://Spam.Example.ORG/x", 0), (2, None, 0), (3, "no scheme", 0), (4, "https://a.example.net/en/1?q", 0), (5, "https://example.net", 0),
         (6, "https://x.net/", 0), (7, "https://notexample.com/de/", 0), (8, "https://m.example.com/de/2", 0), (9, "s://good.org/fr/é#x", 0)],
        "page_id long, url string, rule int")
    outcomes = spark.createDataFrame([("spam.example.org", True)] * 40 + [("good.org", False)] * 60 + [("x.org", None), ("once.org", True)], "host string, bad boolean")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.url_verdicts(pages, outcomes).collect()}
    assert rows == {
        1: ("spam.example.org", "/x", None, "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"),
        4: ("a.example.net", "/en/1", "example.net/en/", "allow"), 5: ("example.net", "", None, "allow"), 6: ("x.net", "/", "net/", "block"),
        7: ("notexample.com", "/de/", None, "allow"), 8: ("m.example.com", "/de/2", "example.com/de/", "block"), 9: ("good.org", "/fr/é", "org/fr/", "allow")}
    known = {r.host: r for r in reputation.reputation(outcomes).collect()}
    assert known["once.org"].rate < 0.9 and known["once.org"].bound < 0.5 < known["spam.example.org"].bound
    nothing = reputation.url_verdicts(pages, outcomes.limit(0))
    assert {r.verdict for r in nothing.where("rule is null").collect()} == {"allow"}


def brute_bounds(outcomes, hosts):
    """Lower bounds of all hosts, level by level, in plain Python."""
    count = {h: [0, 0] for h in [*hosts, *(h for h, _ in outcomes)]}
    for host, bad in outcomes:
        count[host][0] += 1
        count[host][1] += bad
    rate, weight = {"": sum(b for _, b in outcomes) / len(outcomes)}, {"": len(outcomes)}
    for name, above in ((lambda h: h.split(".")[-1], lambda k: ""), (lambda h: ".".join(h.split(".")[-2:]), lambda k: k.split(".")[-1]),
                        (lambda h: h, lambda k: ".".join(k.split(".")[-2:]))):
        level = {}
        for host, (n, bad) in count.items():
            old = level.get(name(host), (0, 0))
            level[name(host)] = (old[0] + n, old[1] + bad)
        mean = {k: rate[above(k)] for k in level}
        known = [(n, bad, mean[k]) for k, (n, bad) in level.items() if n]
        noise, full = sum(m * (1 - m) for _, _, m in known), sum(m * (1 - m) * n for n, _, m in known)
        over = (sum(n * (bad / n - m) ** 2 for n, bad, m in known) - noise) / (full - noise) if full > noise else 0
        s = min(max(1 / over - 1, reputation.STRENGTH[0]), reputation.STRENGTH[1]) if over > 0 else reputation.STRENGTH[1]
        own = {k: min(s, weight[above(k)]) for k in level}
        rate = {k: (bad + own[k] * mean[k]) / (n + own[k]) for k, (n, bad) in level.items()}
        weight = {k: n + own[k] for k, (n, _) in level.items()}
    return {k: rate[k] - reputation.Z * (rate[k] * (1 - rate[k]) / (weight[k] + 1)) ** 0.5 for k in count}


def test_hosts_without_labels(spark):
    outcomes = [(f"h{i}.bad.io", i % 20 != 0) for i in range(60) for _ in range(50)]
    outcomes += [(f"h{i}.fine{i % 7}.io", i % 30 == 0) for i in range(60) for _ in range(40)]
    outcomes += [(f"h{i}.worst{i % 30}.zz", True) for i in range(60) for _ in range(40)]
    hosts = ["new.bad.io", "new.fine1.io", "new.other.io", "a.never.zz", "www.unseen.qq", "h0.bad.io", "h1.bad.io"]
    known = spark.createDataFrame(outcomes, "host string, bad boolean")
    pages = spark.createDataFrame([(f"https://{h}/x",) for h in hosts for _ in range(3)] + [(None,)], "url string")
    want = brute_bounds(outcomes, hosts)
    got = {r.host: r for r in reputation.reputation(known, pages.select(reputation.host_of(pages.url).alias("host"))).collect()}
    assert got.keys() == want.keys() and got["new.bad.io"].n == 0
    assert all(abs(got[h].bound - want[h]) < 1e-9 for h in want)
    rows = reputation.url_verdicts(pages, known).collect()
    assert len(rows) == 3 * len(hosts) + 1
    verdicts = {r.host: r.verdict for r in rows}
    assert verdicts == {"": "allow", **{h: "block" if want[h] > reputation.BLOCK_ABOVE else "allow" for h in hosts}}
    assert verdicts["new.bad.io"] == verdicts["a.never.zz"] == "block" and verdicts["new.fine1.io"] == verdicts["www.unseen.qq"] == "allow"


def test_toxicity_held_out(spark):
    draw = random.Random(2)
    plain, bad = [f"w{i}" for i in range(400)], ["vile", "scum", "rotten"]

    def text(toxic):
        return " ".join(draw.choice(bad) if toxic and draw.random() < 0.06 else draw.choice(plain) for _ in range(120))

    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == toxicity.GRADES - 1
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(out[i]._tox_p > 0.5) == bool(y) for i, _, y in rows if i >= 300]
    assert sum(held) / len(held) > 0.97
    assert all(0 <= r._tox_severity <= 3 for r in out.values())
    kept = toxicity.toxicity_filter(docs, labels)
    assert kept.columns == docs.columns and kept.count() < 500
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "vile " * 30_000, "x")], docs.schema)
    assert [r._tox_p > 0.5 for r in toxicity.score(odd, model).orderBy("doc_id").collect()] == [False, False, True]
    assert toxicity.toxicity_filter(docs, labels.limit(0)).count() == 600
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_query_on_labels(spark):
    found = {r.doc_id: r.toxic for r in QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert sum(found[r.doc_id] == bool(r.toxic) for r in labels) / len(labels) > 0.97
