"""Cases that hashes and shared ids could get wrong, added tokens, and clashing columns."""

import random
import zlib

import duckdb
import numpy as np
import pytest

from siftloom.llm import byte_bpe, near_dedup, packing, quality, substrings, suffixes, toxicity
from siftloom.llm.queries import ORACLES, QUERIES

WORDS = "one two three four five six seven"


def clusters(spark, rows, width=2):
    got = near_dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=width).collect()
    return sorted((r.id, r.component_id) for r in got)


def test_words_with_the_same_polynomial_stay_apart(spark):
    """The Thue-Morse word of 2048 letters and its complement agree under every odd base modulo 2**64."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    assert clusters(spark, [(1, f"{morse} x"), (2, f"{other} x"), (3, f"{morse}  X")]) == [(1, 1), (2, 2), (3, 1)]


def test_long_words(spark):
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("ab") for _ in range(n))
    rows, want = [], []
    for i in range(12):
        own = [word(2000 + 100 * i), word(7), word(8), word(9), word(2048), word(2049)]
        rows += [(10 * i, " ".join(own)), (10 * i + 1, "\n".join(own)), (10 * i + 2, " ".join([own[0] + "a", *own[1:]]))]
        want += [(10 * i, 10 * i), (10 * i + 1, 10 * i), (10 * i + 2, 10 * i + 2)]  # one of six shingles differs: 4 / 6
    assert clusters(spark, rows) == want


def test_rows_that_share_an_id_link_their_texts(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "lone text here")]
    assert clusters(spark, rows) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert clusters(spark, [(5, "x y z"), (5, "p q r"), (4, "p q r")]) == [(4, 4), (5, 4), (5, 4)]


def test_a_text_of_distinct_words_repeats_nothing(spark):
    n = 5_000_000
    rows = spark.range(1).selectExpr("1L AS doc_id", f"array_join(transform(sequence(1, {n}), i -> cast(i as string)), ' ') AS text",
                                     "'en' AS lang", "'web' AS source")
    got = quality.measured(rows).select("_qr_n_words", "_qr_n_repeat_words").first()
    assert tuple(got) == (n, 0)


def test_added_tokens_are_matched_as_by_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>Y <|ENDOFTEXT|>", "plain", "", "é <|endoftext|><|endoftext|> É", "<|endoftext|", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.pieces(docs, path, with_ids=True).collect():
        assert list(r.ids) == [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]


CLASHES = ["id", "n", "h1", "set", "_g", "blob", "_tox_p", "_tox_grade", "_qr_words", "_qr_kept", "_key", "_y", "own0", "own3", "component_id", "_c", "kept"]


@pytest.fixture
def clashing(spark):
    texts = [" ".join(f"w{(i * 37 + j * j) % 401}" for j in range(80)) for i in range(6)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate([*texts, texts[0]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHES])


def rows_kept(docs, out):
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r[c] == c for r in got for c in CLASHES)
    return sorted(r.doc_id for r in got)


def test_filters_keep_columns_of_any_name(spark, clashing):
    assert rows_kept(clashing, near_dedup.near_dedup(clashing)) == [0, 1, 2, 3, 4, 5]
    assert rows_kept(clashing, quality.quality_filter(clashing)) == [0, 1, 2, 3, 4, 5, 6]
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    assert rows_kept(clashing, toxicity.toxicity_filter(clashing, labels)) == [0, 1, 2, 3, 4, 5, 6]
    out = suffixes.dedup_texts(clashing)
    assert rows_kept(clashing, out) == [0, 1, 2, 3, 4, 5, 6]
    assert {r.doc_id: (len(r.text), r.n_chars) for r in out.collect()}[6] == (0, 0)


def test_offsets_and_decoding_of_the_query(spark):
    """The query's offsets are those of ``encode``; its bytes come back through the reversed byte table."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    spans = {r.doc_id: r for r in byte_bpe.encode(docs, path).collect()}
    for r in QUERIES["op3_byte_bpe"](spark, "/root/testdata/sf0.001").collect():
        own = spans[r.doc_id]
        packed = b"".join(x.to_bytes(4, "little") for x in [*own.starts, *own.ends])
        assert r.offsets_crc32 == zlib.crc32(packed) and r.n_tokens == len(own.ids)
    bpe = byte_bpe.codec(path)
    table = {c: b for b, c in enumerate(byte_bpe.byte_table())}
    for i in (0, 255, 256, 1000, 50_000, 50_255):
        assert bpe.decode(np.array([i])).tobytes() == bytes(table[c] for c in bpe.library.id_to_token(i))


def test_reputation_of_hosts_without_labels_in_both_engines(spark, folder):
    pages = [(i, f"https://h{i % 3}.bad.org/{i}") for i in range(300)] + [(i, f"https://h{i % 3}.good.com/{i}") for i in range(300, 600)]
    pages += [(900, "https://new.bad.org/x"), (901, "https://new.good.com/y"), (902, None), (903, "no scheme"), (904, "https://alone.zz/q")]
    labels = [(i, 0 if i < 300 and i % 10 else 1, 0) for i in range(600)] + [(900, None, 1)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = QUERIES["op7_url_reputation"](spark, folder).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["op7_url_reputation"]).fetchall())
    verdicts = {r.page_id: r.verdict for r in got}
    assert (verdicts[900], verdicts[901], verdicts[0], verdicts[300]) == ("block", "allow", "block", "allow")


def test_repeated_passages_in_long_texts_null_ids_and_empty_tables(spark):
    draw = random.Random(21)
    passage = " ".join(f"p{draw.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"q{i}" for i in range(150_000))
    rows = [(None, passage), (3, f"{passage} own words"), (5, f"{long} {passage} {long}"), (6, "short"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') AS text", "1 AS _g", "2 AS blob")
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.dedup_digests(docs).collect()}
    # the null id counts as the largest, so its passage goes
    assert got == {(None, 60): 60, (3, 62): 0, (5, 300_060): 60, (6, 1): 0, (None, 0): 0}
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.dedup_digests(docs).collect()}
    assert got[(None, len(passage))] == len(passage) and got[(3, len(passage) + 10)] == 0 and got[(6, 5)] == 0
    # between the blanks beside it nothing else repeats in another document
    assert len(passage) <= got[(5, 2 * len(long) + len(passage) + 2)] <= len(passage) + 2
    for dedup in (substrings.dedup_digests, suffixes.dedup_digests):
        assert dedup(docs.limit(0)).collect() == []
