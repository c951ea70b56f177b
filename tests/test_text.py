import re
import time
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftloom import rules
from siftloom.functions import files as FN
from siftloom.functions import language as L
from siftloom.functions import quality as Q
from siftloom.functions import text as X
from siftloom.functions import textnorm as N
from siftloom.functions import topics as T
from siftloom.functions.text import paragraphs
from siftloom.operators import documents as D
from siftloom.plans import tables as TB
from siftloom.plans import text as PT


def test_stable_class_needs_no_normal_form():
    ranges = [(0, 0x7F), (0xC0, 0xFF), (0x400, 0x45F), (0x621, 0x63A), (0x641, 0x64A), (0x660, 0x669), (0x679, 0x6D3), (0x6D5, 0x6D5)]
    for low, high in ranges:
        for code in range(low, high + 1):
            assert unicodedata.normalize("NFKC", chr(code)) == chr(code) and not unicodedata.combining(chr(code))


@pytest.mark.parametrize("raw,expected", [
    ("ﬁle ①", "file 1"), ("é", "é"), ("كوردي", "کوردی"), ("ﻛﻮرد", "کورد"), ("plain", "plain"), (None, ""),
])
def test_unicode_normalise(one, raw, expected):
    assert one(N.normalize_text(F.col("t")), t=raw) == expected


def test_decode_verdicts(spark):
    rows = [(1, "ئگر تایبت پاداشت"), (2, "áâãäå " * 5), (3, "دەقێکی پاک"), (4, "  "), (5, None)]
    out = N.decode_kurdish(spark.createDataFrame(rows, "id int, t string"), "t").collect()
    got = {r.id: r.decoded for r in out}
    assert got[1].text == "ئەگەر تایبەت پاداشت" and got[1].repairs == 3 and got[1].encoding_type == "repaired_vowels"
    assert got[2].text == "ابپتج " * 5 and got[2].encoding_type == "ali_kurdish_legacy"
    assert got[3].encoding_type == "clean_unicode" and not got[3].is_legacy_encoded
    assert got[4].encoding_type == got[5].encoding_type == "empty"


def test_vowel_repair(spark):
    df = spark.createDataFrame([("کردنوە",), ("نوەک",)], "t string")
    assert [r.f for r in N.repair_words(df, "t", "f", "n").collect()] == ["کردنەوە", "نوەک"]


@pytest.mark.parametrize("text,language,script,confidence", [
    ("ئەمە دەقێکی کوردییە", "ckb", "arabic", 0.85), ("هذه جملة", "ar", "arabic", 0.7), ("plain words", "en", "latin", 0.6),
    ("это текст", "unknown", "cyrillic", 0.0), ("12345", "unknown", "mixed", 0.0), ("  ", "unknown", "unknown", 0.0),
])
def test_language_rules(spark, text, language, script, confidence):
    r = D.detect_languages(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0].language
    assert (r.language, r.script, r.confidence) == (language, script, confidence)


def test_strict_alphabet_keeps_arabic_apart(spark):
    df = spark.createDataFrame([(1, "هذا كتاب من العراق")], "doc_id long, text string")
    assert D.detect_languages(df).collect()[0].language.language == "ckb"
    assert D.detect_languages(df, strict_alphabet=True).collect()[0].language.language == "ar"


def test_guess_refines_undecided_text_only(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("kedi ve bir köpek", "tr")], "text string, lang string")
    profiles = D.train_language_profiles(train, ["en", "tr"])
    docs = spark.createDataFrame([(1, "bir kedi ve"), (2, "ئەمە دەقێکی"), (3, "the dog")], "doc_id long, text string")
    got = {r.doc_id: r.language for r in D.document_languages(docs, profiles).collect()}
    assert got[1].language == "tr" and got[1].confidence == 0.8 and got[2].language == "ckb" and got[3].language == "en"


def brute_topics(text):
    from siftloom import rules
    scores = {}
    for name, (first, second) in rules.TOPIC_KEYWORDS.items():
        hits = 2.0 * sum(text.count(k) for k in first) + sum(text.count(k) for k in second)
        scores[name] = min(1.0, hits / max(1, len(text) / 1000))
    best = max(scores, key=lambda k: scores[k])
    return (best if scores[best] >= 0.3 else "general"), scores[best]


def test_topics_match_brute_force(one):
    for text in ("مێژوو و تاریخی گەل " + "ب " * 3000, "یاسا", "nothing here", "داتا کار"):
        got = one(T.best_topic(T.topic_scores(F.col("t")), F.col("t")), t=text)
        category, score = brute_topics(text.strip())
        assert got.category == category and abs(got.confidence - score) < 1e-12
    assert one(T.best_topic(T.topic_scores(F.col("t")), F.col("t")), t=" ").category == "unknown"


def test_year_tags_and_paragraphs(one):
    assert one(T.year_tags(F.col("t")), t="1299 1300 2029 2030 1300 x1999 سالی 1946.") == ["1300", "2029", "1946"]
    assert one(paragraphs(F.col("t")), t="a  b\n \nc\n\na b\n\n\n") == ["a b", "c"]


def test_quality_score(spark):
    df = spark.createDataFrame([("x" * 1000, 1000), ("�" * 50, 50), ("", 0)], "t string, size long")
    q = Q.quality_score(F.col("t"), F.col("size"), F.lit(False), F.lit(""), F.lit(0.5))
    got = [r.q for r in df.select(q.alias("q")).collect()]
    assert got[0].score == round((0.25 + 0.15 + 0.30 + 0.5 * 0.15 + 0.15) * 100)
    assert got[1].encoding_quality == 0.0 and all(0 <= r.score <= 100 for r in got)
    pdf = df.select(Q.integrity_score(F.col("size"), F.lit(True), F.lit("PK")).alias("s")).collect()
    assert [r.s for r in pdf] == [0.3, 0.15, 0.0]


def test_pdf_verdicts(spark):
    rows = [("blank", 1, "", True), ("thin", 1, "few", False), ("good", 1, "clean text " * 20, False), ("good", 2, None, False),
            ("legacy", 1, "áâãäåæç " * 30, False), ("repair", 1, "ئگر " * 40, False), ("noise", 1, "\x01\x02ab" * 30, False)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, text string, has_images boolean")
    got = {r.doc_id: r for r in D.classify_documents(df).collect()}
    assert got["blank"].reason == "scanned_image_no_text_found" and got["blank"].has_images and got["blank"].folder_path == "pdf/ocr"
    assert got["thin"].reason == "low_text_density_3.0_chars_per_page"
    assert got["good"].classification == "digital" and got["good"].page_count == 2 and got["good"].text_density == 110.0
    assert got["legacy"].reason.endswith("ali_kurdish_legacy") and got["legacy"].text_sample.startswith("ابپتجچح")
    assert got["repair"].reason.endswith("repaired_vowels") and got["repair"].text_sample.startswith("ئەگەر")
    assert got["noise"].reason == "unprintable_garbage_encoding_ratio_0.50"


def test_structured_document(spark):
    df = spark.createDataFrame([("d1", "pub", "https://a.b.example.com/x/y", "k", "T", "كورد\n\nدووەم")],
                               "id string, publisher string, url string, file_path string, title string, text string")
    r = D.structured_documents(df).collect()[0]
    assert r.text.normalized_text == "کورد\n\nدووەم" and r.text.raw_text == "كورد\n\nدووەم"
    assert r.document.dialect == "sorani" and r.document.direction == "rtl" and r.structure.paragraph_count == 2
    assert (r.source.domain, r.source.subdomain, r.source.route) == ("example.com", "a.b", "/x/y")
    assert r.conversion.conversion_confidence == 0.95 and r.quality.language_verified


def test_files_without_text_have_quality_alone(spark, folder):
    """No document is built from no text; blanks are text."""
    texts = [None, "", " \n", "The end of it."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'src' AS source").write.parquet(f"{folder}/documents.parquet")
    files = TB.text_files(spark, folder)
    whole = {r.file_pk: r for r in D.process_text_files(files).collect()}
    for pk in ("doc-0", "doc-1"):
        assert whole[pk].quality_facts.score is not None
        assert [whole[pk][c] for c in ("language", "best_topic", "tags", "record")] == [None] * 4
    kept = D.process_text_files(files, only_records=True).collect()
    assert {r.file_pk: r for r in kept} == {pk: whole[pk] for pk in ("doc-2", "doc-3")}
    assert all(r.record is not None for r in kept)
    out = PT.x32p(spark, folder).collect()
    assert sorted((r.file_pk, r.language, r.text_quality) for r in out) == [("doc-2", "unknown", "verified"), ("doc-3", "en", "verified")]


@pytest.mark.parametrize("name,worker,catalog", [
    ("مۆرکی کورد.pdf", "مۆرکی_کورد.pdf", "مۆرکی_کورد.pdf"), ("a - b__c.PDF", "a_b_c.pdf", "a_b_c.PDF"),
    ("../../etc/passwd", "etc_passwd", "etc_passwd"), ("???", "unnamed", "file"),
])
def test_safe_names(one, name, worker, catalog):
    assert one(FN.sanitize_filename(F.col("n")), n=name) == worker
    assert one(FN.sanitize_catalog_name(F.col("n")), n=name) == catalog


def test_magic_bytes(spark):
    rows = [(bytearray(b"%PDF-1.7"), None, ".bin", "application/pdf"), (bytearray(b"\x89PNG\r\n\x1a\n"), "x/y", "", "image/png"),
            (bytearray(b"hello"), "text/csv; charset=x", "", "text/csv"), (bytearray(b"hello"), None, ".txt", "text/plain"),
            (bytearray(b"hello"), None, "", "application/octet-stream")]
    df = spark.createDataFrame(rows, "c binary, d string, e string, want string")
    for r in df.select(FN.resolve_mime(F.col("c"), F.col("d"), F.col("e")).alias("m"), "want").collect():
        assert r.m == r.want


def test_display_text(spark):
    df = spark.createDataFrame([(0,), (999,), (1024,), (1536,), (1048576,), (None,)], "n long")
    assert [r.t for r in df.select(FN.byte_text(F.col("n")).alias("t")).collect()] == ["0 B", "999 B", "1 KB", "1.5 KB", "1 MB", "—"]
    assert [r.t for r in df.select(FN.duration_text(F.col("n")).alias("t")).collect()][:3] == ["0ms", "999ms", "1s"]


def test_language_guesses_are_counted_in_the_reading_task(spark, monkeypatch):
    """Guesses as plain Python counts them, over pieces of a text; neither guesses nor verdicts are shuffled."""
    monkeypatch.setattr(D, "GRAM_CHARS", 5)
    texts = {0: ("en", "the  cat\nThe end"), 1: ("fr", "le chat le \U0001F600\U0001F600\U0001F601 fin"), 2: ("en", "ab"), 3: ("en", ""), 4: ("fr", None), 5: ("xx", "the the"), 6: ("en", "\U0001F600\U0001F600\U0001F601zz the")}
    docs = spark.createDataFrame([(i, *v) for i, v in texts.items()], "doc_id long, lang string, text string")

    def grams(t):
        flat = re.sub(r"\s+", " ", t or "").lower()
        return [flat[i : i + 3] for i in range(len(flat) - 2)]

    profile = {}
    for lang in ("en", "fr"):
        n = Counter(g for k, t in texts.values() if k == lang for g in grams(t))
        profile |= {(lang, g): 13 - place for place, g in enumerate(sorted(n, key=lambda g: (-n[g], g))[:12], 1)}
    trained = D.train_language_profiles(docs, ["fr", "en"], 12)
    assert {(r.lang, r.gram): r.weight for r in trained.collect()} == profile

    def guess(t):
        totals = Counter()
        for g in grams(t):
            totals.update({k: w for (k, x), w in profile.items() if x == g})
        return min(((-w, k) for k, w in totals.items()), default=(0, None))[::-1]

    guessed = D.guess_language(docs, trained)
    assert {r.doc_id: (r.guess, -r.total) for r in guessed.collect()} == {i: guess(t) for i, (_, t) in texts.items()}
    for df in (guessed, D.document_languages(docs, trained)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


ODD_TEXTS = [
    None, "", " ", "\n  \t", "a", "  a b\n\n c\t ", " x　y\u0085", "a   b c  d", "\x00\x01 ctl\x0b\x1f",
    "\U0001d518\U0001f600 \U0001f600  z ", "﻿ bom ", "Ünïcödé ÃŸ Ã© Â° â€™ â€\" Ã\u0080\u0081 ��� q", "âê ÿ",
    "سڵاو ێ latin", "العربية فقط يك", "كيىےہ", "привет мир", "नमस्ते", "ﬁ ﷺ Å é", "in 1999, 2024x 1300\n", "aaaa the thethe", "\x7f\u0080",
]


def test_text_helpers_on_odd_texts(spark):
    """Each helper equals its plain form, whatever the characters."""
    t = F.col("t")
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    count = lambda c, k: F.length(c) - F.length(F.regexp_replace(c, k, ""))
    full = F.coalesce(t, F.lit(""))
    bad = count(full, r"[\x{e0}-\x{ff}\x{fffd}\x00-\x08\x0B\x0C\x0E-\x1F]")
    for pattern in rules.MOJIBAKE_PATTERNS:
        bad = bad + F.regexp_count(full, F.lit(pattern))
    pairs = [
        (X.strip(t), strip(t)), (X.collapse(t), F.trim(F.regexp_replace(t, r"(?U)\s+", " "))),
        (X.beyond_ascii(t), F.regexp_replace(t, r"[\x00-\x7F]", "")), (Q.printable_ratio(t), F.when(F.length(full) == 0, 0.0).otherwise(
            (F.length(full) - count(full, Q.UNPRINTABLE_CLASS)) / F.greatest(F.length(full), F.lit(1)))),
        (Q.mojibake_ratio(t), F.least(F.lit(1.0), bad / F.greatest(F.length(full), F.lit(1)))),
        (T.year_tags(t), T.year_tags(strip(t))), (N.map_kurdish_letters(t), F.translate(t, rules.ARABIC_FORMS, rules.KURDISH_FORMS)),
        *[(X.occurrences(full, F.lit(w)), F.regexp_count(full, F.lit(w)).cast("long")) for w in ("the", "a", "aa", "é", "ÃŸ", "\U0001f600")],
        *[(L.script_profile(t)[f"{n}_ratio"], count(strip(full), c) / F.greatest(F.length(strip(full)), F.lit(1))) for n, c in L.SCRIPTS.items()],
    ]
    frame = spark.createDataFrame([(x,) for x in ODD_TEXTS], "t string")
    row = frame.select("t", F.array(*[F.to_json(F.struct(a.alias("x"))) for a, _ in pairs]).alias("a"), F.array(*[F.to_json(F.struct(b.alias("x"))) for _, b in pairs]).alias("b"))
    for r in row.collect():
        assert r.a == r.b, r.t
    forms = str.maketrans(rules.ARABIC_FORMS, rules.KURDISH_FORMS)
    for r in frame.select("t", N.normalize_text(t).alias("n"), L.detect_language(t, L.script_profile(t))["language"].alias("l")).collect():
        assert r.n == unicodedata.normalize("NFKC", r.t or "").translate(forms)
        assert (r.l == "unknown") >= (not (r.t or "").strip())


def test_long_blanks_inside_a_text_are_passed_once(spark):
    """The end of a text is not looked for behind every blank of a run."""
    wide = spark.createDataFrame([(" a" + " " * 300_000 + "b\n",)], "t string")
    start = time.time()
    assert wide.select(F.length(X.strip(F.col("t"))).alias("n")).first().n == 300_002
    assert time.time() - start < 10
