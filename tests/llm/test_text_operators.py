"""Each query against brute force, and the defined edge cases, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftloom.llm import merkle, near_dedup, overlaps, packing, quality, repeats, substrings, suffixes
from siftloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def overlapping():
    """Short documents that share parts of one text, with edge cases."""
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "x"]
    base = [draw.choice(vocabulary) for _ in range(400)]
    rows = []
    for i in range(50):
        a = draw.randint(0, 300)
        text = [draw.choice(vocabulary) for _ in range(draw.randint(0, 40))] + base[a: a + draw.randint(20, 120)]
        rows.append((i if draw.random() < 0.9 else 5, draw.choice([" ", "\n", "  "]).join(text)))
    rows += [(100, None), (101, ""), (102, " \t"), (103, " ".join(base)), (104, "\t".join(base) + "\n"), (104, " ".join(base))]
    rows += [(200 + i, "ab" * draw.randint(0, 60)) for i in range(8)] + [(220 + i, "é" * draw.randint(20, 60)) for i in range(8)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).selectExpr("doc_id", "coalesce(text, '') AS text")


def removed(rows, cut, size):
    """Flags of the units covered by a window that starts in a smaller id too."""
    first = {}
    for key, text in rows:
        units = cut(text)
        for j in range(len(units) - size + 1):
            window = tuple(units[j: j + size])
            first[window] = min(first.get(window, key), key)
    for key, text in rows:
        units = cut(text)
        gone = [False] * len(units)
        for j in range(len(units) - size + 1):
            if first[tuple(units[j: j + size])] < key:
                gone[j: j + size] = [True] * size
        yield key, units, gone


def expected_words(rows):
    return sorted((key, len(u), sum(gone), sha(" ".join(w for w, g in zip(u, gone, strict=True) if not g)))
                  for key, u, gone in removed(rows, words, 50))


def expected_bytes(rows):
    return sorted((key, len(u), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), sha(bytes(c for c, g in zip(u, gone, strict=True) if not g)))
                  for key, u, gone in removed(rows, lambda t: (t or "").encode(), 50))


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_substring_dedup(spark, overlapping, monkeypatch, hot):
    monkeypatch.setattr(repeats.repeated, "__defaults__", (hot,))
    monkeypatch.setattr(repeats.group_count, "__defaults__", (3000,))
    got = substrings.dedup_digests(frame(spark, overlapping)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expected_words(overlapping)


@pytest.mark.parametrize("hot", [overlaps.HOT_GROUPS, 1])
def test_suffix_array_dedup(spark, overlapping, monkeypatch, hot):
    monkeypatch.setattr(overlaps.repeated, "__defaults__", (hot,))
    monkeypatch.setattr(repeats.group_count, "__defaults__", (3000,))
    got = suffixes.dedup_digests(frame(spark, overlapping)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expected_bytes(overlapping)


def test_dedup_queries_on_whole_tables(spark, documents):
    got = QUERIES["op4_substring_dedup"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expected_words(documents)
    got = QUERIES["op10_suffix_array_dedup"](spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == expected_bytes(documents)


def test_suffix_array():
    draw = random.Random(5)
    cases = [[], [1], [1] * 50, list(range(30)), list(range(30))[::-1], [1, 2] * 20 + [1]]
    cases += [[draw.randrange(k) for _ in range(draw.randint(0, 90))] for k in (1, 2, 3, 26) for _ in range(150)]
    for text in cases:
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_dedup_texts_keeps_rows_and_columns(spark):
    long = "é" + "abcdefghij" * 12
    rows = [(1, long, 7, "p"), (2, "xy" + long, 9, None), (3, None, None, "q"), (None, "z" + long, 1, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, pos string")
    out = {r.doc_id: r for r in suffixes.dedup_texts(docs).collect()}
    assert suffixes.dedup_texts(docs).columns == docs.columns
    assert out[1].text == long and out[2].text == "xy" and out[2].n_chars == 2 and out[None].text == "z"
    assert out[3].text == "" and out[3].pos == "q"
    assert suffixes.dedup_texts(docs.limit(0)).collect() == []


def jaccard_components(rows, width):
    sets, parent, holders = [], list(range(len(rows))), {}
    for _, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[j: j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        common = Counter()
        for g in s:
            common.update(holders.setdefault(g, []))
            holders[g].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (key, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), key), key)
    return sorted((key, len(sets[k]), least[find(k)]) for k, (key, _) in enumerate(rows))


@pytest.mark.parametrize(("block", "width"), [(near_dedup.BLOCK, 2), (10, 5)])
def test_near_dedup(spark, monkeypatch, block, width):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    draw = random.Random(3)
    vocabulary = [f"W{i}" for i in range(300)] + ["é", "x"]
    rows = []
    for _ in range(8):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 30, 100, 150]))]
        for _ in range(40):
            w = list(base)
            for _ in range(draw.choice([0, 1, 2, 5, 8, 12, 20])):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            rows.append((len(rows), draw.choice([" ", "\n"]).join(w)))
    rows += [(9000, None), (9001, ""), (9002, "a"), (9003, "A"), (9004, "a b"), (9005, "A  b")]
    got = near_dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=width).collect()
    assert sorted(map(tuple, got)) == jaccard_components(rows, width)


def test_near_dedup_query_and_filter(spark, documents):
    got = QUERIES["op9_minhash_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_components(documents, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "k"), (2, text, "k"), (2, text, "k"), (None, text, "k"), (3, None, "k")], "doc_id long, text string, component_id string")
    out = near_dedup.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]
    assert near_dedup.near_dedup(docs.limit(0)).collect() == []


def measures(text):
    w, text = words(text), text or ""
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j + d for j in range(len(w) - 2) if triples[tuple(w[j: j + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_fences(spark, documents):
    rows = QUERIES["op5_quality_rules"](spark, SF).collect()
    assert len(rows) == len(documents)
    texts = dict(documents)
    for r in rows:
        n, chars, symbols, dup, rep = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        if r.max_word_length is None:  # a group of which every document fails the base rule
            assert r.base_failed
            continue
        within = symbols / max(n, 1) <= r.max_symbols_per_word and chars / max(n, 1) <= r.max_word_length
        if not r.base_failed and not within:
            assert not r.kept
        assert not (r.base_failed and r.kept)


def test_quality_adapts_to_source_and_edge_cases(spark):
    def text(i, mark):
        return " ".join(f"word{(i * 7 + j * j) % 997}{mark if j % 2 else ''}" for j in range(60))

    rows = [(i, text(i, "#"), "en", "code", 1) for i in range(150)] + [(1000 + i, text(i, ""), "en", "news", 1) for i in range(150)]
    rows += [(2000, text(3, "#"), "en", "news", 1), (2001, None, None, None, 1), (2002, "a " * 500, "en", "news", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(150)) <= ids and set(range(1000, 1150)) <= ids  # the symbols are usual in one source only
    assert not ids & {2000, 2001, 2002}
    assert quality.quality_filter(docs.limit(0)).collect() == []
    got = quality.measured(spark.createDataFrame([("a b c a b c a b c d",), ("x\n x\nx\n\t\nx",), ("",)], "text string")).collect()
    assert [r._qr_n_repeat_words for r in got] == [9, 4, 0]


def test_quality_fences_hold_with_a_third_of_junk(spark):
    draw = random.Random(5)

    def lines(n, size=10):
        return [" ".join(f"word{draw.randrange(10**6)}" for _ in range(size)) for _ in range(n)]

    def doc(kind):
        own = lines(20)
        if kind == "short":  # one repeated line, half the lines of a short text
            own = lines(2, 30)
            own.insert(1, "one line twice is no sign of junk")
            own.append(own[1])
        elif kind == "lines":  # 9 of 30 lines are copies, without three words in a row that repeat
            own = [x for line in own[:10] for x in (line, "next page")] + own[10:]
        elif kind == "repeats":  # the same phrase inside different lines
            own = [f"{line} all that you need now" for line in own]
        elif kind == "letters":
            own = [" ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(10)) for _ in range(20)]
        return "\n".join(own)

    rows, kinds = [], {}
    for source, junk in (("clean", []), ("copies", ["lines"]), ("phrases", ["repeats"]), ("codes", ["letters"]), ("refrains", ["repeats"] * 9)):
        for i in range(300):
            kind = junk[0] if junk and (i % 3 == 0 or len(junk) > 1) else "short" if i % 50 == 1 else "plain"
            kinds[len(rows)] = (source, kind)
            rows.append((len(rows), doc(kind), "en", source))
    judged = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for key, (source, kind) in kinds.items():
        r = judged[key]
        assert not r._qr_base_failed
        assert r._qr_kept == (kind in ("plain", "short") or source == "refrains"), (source, kind)  # a habit of the whole source stays
    assert all(r._qr_max_repeat_share <= 0.2 and r._qr_max_dup_line_share <= 0.2 for k, r in judged.items() if kinds[k][0] != "refrains")


def tree(text):
    """(paragraphs as (digest, pieces), section digests, root) of a text."""
    cut = re.compile(r"[^\n]{23,255}?[ 08HPXhpx]|[^\n]{1,256}")
    lines = [[sha(p)[:32] for p in cut.findall(line)] for line in (text or "").split("\n")]
    paras = [(sha(" ".join(pieces)), pieces) for pieces in lines]
    groups, open_group = [], []
    for digest, _ in paras:
        open_group.append(digest)
        if digest[-1] in "0123":
            groups.append(open_group)
            open_group = []
    groups += [open_group] if open_group else []
    digests = [sha(" ".join(g)) for g in groups]
    return paras, digests, sha(" ".join(digests))


def alike(a, b):
    """Likeness by walking down: whole paragraphs of both count, pieces of the others are compared."""
    x, y = dict(tree(a)[0]), dict(tree(b)[0])
    total = sum(len(set(p)) for p in x.values()) + sum(len(set(p)) for p in y.values())
    equal = sum(len(set(p)) for d, p in x.items() if d in y)
    below = {q for d, p in x.items() if d not in y for q in p} & {q for d, p in y.items() if d not in x for q in p}
    return 2 * (equal + len(below)) / total if total else 1.0


def check_trees(rows, documents):
    by_id = {r.doc_id: r for r in rows}
    ordered = sorted((k, t or "") for k, t in documents)
    for i, (key, text) in enumerate(ordered):
        following, half = ordered[(i + 1) % len(ordered)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = by_id[key]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(edited), tree(text)[2], tree(edited)[2])
        assert abs(r.near_edited - alike(text, edited)) < 1e-12 and abs(r.near_next - alike(text, following)) < 1e-12
        assert r.n_edited_sections == len(set(tree(edited)[1]) - set(tree(text)[1]))
        assert r.n_edited_paragraphs == len({d for d, _ in tree(edited)[0]} - {d for d, _ in tree(text)[0]})


def test_merkle_query(spark, documents):
    rows = QUERIES["op8_merkle_fingerprints"](spark, SF).collect()
    check_trees(rows, documents)
    prints = {r.doc_id: r.fingerprint for r in rows}
    texts = dict(documents)
    assert len(set(prints.values())) == len(set(texts.values()))


def test_merkle_of_odd_texts(spark, folder):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "é" * 1000 + "\nx"), (5, "word " * 60_000), (6, "a\n" * 500), (7, None), (8, "last h line")]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _place", "'x' AS next_text").write.parquet(f"{folder}/documents.parquet")
    check_trees(QUERIES["op8_merkle_fingerprints"](spark, folder).collect(), docs)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{folder}/none/documents.parquet")
    assert QUERIES["op8_merkle_fingerprints"](spark, f"{folder}/none").collect() == []


def test_an_insertion_leaves_most_of_a_long_line_alike(spark):
    line = " ".join(f"word{i * i % 977}" for i in range(300))
    rows = spark.createDataFrame([(line, "X" + line), (line, line[:700] + line[705:])], "a string, b string")
    leaf = lambda c: merkle.leaves(merkle.paragraphs(F.col(c)))
    assert all(r.v > 0.9 for r in rows.select(merkle.likeness(leaf("a"), leaf("b")).alias("v")).collect())


def test_merkle_buckets_and_edges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET", 3)
    rows = [(i * 5, f"text {i}") for i in range(10)] + [(None, "none"), (5, "again")]
    got = merkle.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted((r.text, r.next_text) for r in got) == sorted((ordered[i][1], ordered[(i + 1) % len(ordered)][1]) for i in range(len(ordered)))
    one = merkle.with_next(spark.createDataFrame([(1, "only")], "doc_id long, text string"), "doc_id", "text").collect()
    assert one[0].next_text == "only"


def test_packing_query(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {key: [*library.encode(text, add_special_tokens=False).ids, 2] for key, text in documents}
    rows = QUERIES["op6_packing"](spark, SF).collect()
    for r in rows:
        piece = b"".join(i.to_bytes(4, "little") for i in ids[r.doc_id][r.start: r.start + r.length])
        assert r.ids_crc32 == zlib.crc32(piece) and r.doc_tokens == len(ids[r.doc_id])
    assert Counter(r.doc_id for r in rows for _ in range(r.length)) == Counter({k: len(v) for k, v in ids.items()})
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096
    assert len(sequences) * 4096 <= 1.05 * sum(map(len, ids.values())) + 4096


def test_best_fit_matches_brute_force():
    draw = random.Random(1)
    for _ in range(100):
        import numpy as np

        lengths = np.array([draw.randint(1, 64) for _ in range(draw.randint(0, 70))], np.int64)
        windows = []
        for n in sorted(lengths.tolist(), reverse=True):
            fit = [x for x in windows if x >= n]
            if fit:
                windows.remove(min(fit))
            windows.append((min(fit) if fit else 64) - n)
        number, offset = packing.best_fit(lengths, 64)
        assert (number.max() + 1 if len(number) else 0) == len(windows)
        assert all(offset[i] + lengths[i] <= 64 for i in range(len(lengths)))


def test_packing_edges(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a b", 0), (2, "x " * 9000, 0)], "doc_id long, text string, start int")
    rows = packing.pack(packing.pieces(docs, path)).collect()
    assert sorted((str(r.doc_id), r.start, r.length) for r in rows) == sorted(
        [("1", 0, 1), ("1", 0, 1), ("None", 0, 3), ("2", 0, 4096), ("2", 4096, 4096), ("2", 8192, 9001 - 8192)])
    assert packing.pack(packing.pieces(docs.limit(0), path)).collect() == []
