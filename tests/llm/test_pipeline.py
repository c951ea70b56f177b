"""Every stage of the pipeline, and the toxicity query, against plain Python on the same rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_text_operators import jaccard_components, measures, removed

import corpus_pipeline
from siftloom.llm import quality, toxicity
from siftloom.llm.queries import QUERIES
from siftloom.llm.words import mix, non_letters, run_hashes, word_hashes, words_of
from siftloom.session import cut_lineage

SF = "/root/testdata/sf0.001"
#: Ranks by which a sketch's quantile may be off.
OFF = 0.03


@pytest.fixture(scope="module")
def stages(spark):
    """(rows in, rows out) of each stage."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, SF))
        seen[name] = (before, docs)
    return {name: (a.columns, a.collect(), b.columns, b.collect()) for name, (a, b) in seen.items()}


def test_stages_and_columns(spark, stages):
    assert list(stages) == ["quality_rules", "toxicity", "minhash_near_dedup", "suffix_array_dedup", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == stages["quality_rules"][0]
    assert corpus_pipeline.run(spark, SF).count() == len(stages["packing"][3])


def by_measure(row):
    n, chars, symbols, dup, rep = measures(row.text)
    lines = sum(1 for x in (row.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    return {"n": n, "base_failed": n < 50 or 100 * rep > 50 * n, "counts": {"n_dup_lines": dup, "n_repeat_words": rep, "n_lines": lines, "n_words": n},
            "symbols_per_word": symbols / max(n, 1), "dup_line_share": dup / max(lines, 1), "repeat_share": rep / max(n, 1), "word_length": chars / max(n, 1)}


def quantile_range(values, q):
    """Least and largest value whose rank is near the quantile's."""
    values = sorted(values)
    at = lambda x: values[min(len(values) - 1, max(0, math.ceil(x * len(values)) - 1))]
    return at(q - OFF), at(q + OFF)


def fence_ranges(levels, measure):
    """((least, largest) upper fence, (least, largest) lower fence) from corpus, language and group."""
    spread, mid = (0.0, 0.0), None
    for i, values in enumerate(levels):
        low, middle, high = (quantile_range([v[measure] for v in values], q) for q in (0.25, 0.5, 0.75))
        own = (max(0.0, min(middle[0] - low[1], high[0] - middle[1])), min(middle[1] - low[0], high[1] - middle[0]))
        n, above = len(values), quality.MIN_GROUP if i else 0
        spread = tuple((n * o + above * s) / (n + above) for o, s in zip(own, spread, strict=True))
        mid = middle if mid is None or n >= quality.MIN_GROUP else mid
    room = [quality.SPREAD * s + quality.SLACK[measure] for s in spread]
    return (mid[0] + room[0], mid[1] + room[1]), (mid[0] - room[1], mid[1] - room[0])


def test_quality_rules(stages):
    _, before, _, after = stages["quality_rules"]
    kept = Counter(r.doc_id for r in after)
    measured = [(r, by_measure(r)) for r in before]
    good = [(r, m) for r, m in measured if not m["base_failed"]]
    decided = 0
    for r, m in measured:
        if m["base_failed"]:
            assert not kept[r.doc_id]
            continue
        levels = [[v for _, v in good], [v for x, v in good if x.lang == r.lang], [v for x, v in good if (x.lang, x.source) == (r.lang, r.source)]]
        surely, maybe = True, True
        for name in quality.SLACK:
            upper, lower = fence_ranges(levels, name)
            for fence, sure in ((upper[0], True), (upper[1], False)):
                if name in quality.ALLOWED:
                    count, of, more = quality.ALLOWED[name]
                    fits = m["counts"][count] <= fence * m["counts"][of] + more
                else:
                    fits = m[name] <= fence
                surely, maybe = (surely and fits, maybe) if sure else (surely, maybe and fits)
            if name in quality.LOWER:
                surely, maybe = surely and m[name] >= lower[1], maybe and m[name] >= lower[0]
        assert not surely or kept[r.doc_id], r.doc_id
        assert maybe or not kept[r.doc_id], r.doc_id
        decided += surely == maybe
    assert decided > 0.9 * len(good)


def token(body: bytes, prefix: int = 0) -> int:
    data = np.frombuffer(body, np.uint8)
    if prefix:
        return int(mix(run_hashes(data, np.array([0]), np.array([prefix])) ^ np.uint64(prefix))[0])
    return int(word_hashes(data, words_of(data, np.array([0, len(data)]), non_letters()))[0])


def toxic_scores(model, text):
    """(expected grade, probability of any toxicity) of a text, term by term."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
    words = re.findall(rb"[a-z\x80-\xff]+", lower)
    tf = Counter(token(w) for w in words) + Counter(token(w, k) for w in words for k in toxicity.PREFIXES if len(w) > k)
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    score = sum(weight[h] * math.log1p(n) for h, n in tf.items() if h in weight)
    below = [0, *[1 / (1 + math.exp(-(t - score))) for t in model.thresholds], 1]
    p = [y - x for x, y in zip(below, below[1:], strict=False)]
    return sum(g * x for g, x in enumerate(p)), 1 - p[0]


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, before, _, after = stages["toxicity"]
    model = toxicity.fit(spark.createDataFrame(before, columns), labels)
    want = sorted(r.doc_id for r in before if toxic_scores(model, r.text)[1] <= 0.5)
    assert sorted(r.doc_id for r in after) == want
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    for r in QUERIES["op1_toxicity"](spark, SF).collect():
        severity, p = toxic_scores(model, docs[r.doc_id])
        assert abs(r.severity - severity) < 1e-9 and abs(r.p_toxic - p) < 1e-9
        assert r.toxic == (r.p_toxic > 0.5) and r.kept == (not r.toxic)


def test_near_dedup(stages):
    _, before, _, after = stages["minhash_near_dedup"]
    components = jaccard_components([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted(key for key, _, least in components if key == least)


def test_suffix_array_dedup(stages):
    _, before, _, after = stages["suffix_array_dedup"]
    got = {r.doc_id: r for r in after}
    for key, data, gone in removed([(r.doc_id, r.text) for r in before], lambda t: (t or "").encode(), 50):
        # a character of which a byte is covered is left out whole
        kept, run = "", bytearray()
        for byte, cut in zip(data, gone, strict=True):
            if cut:
                kept, run = kept + run.decode(errors="ignore"), bytearray()
            else:
                run.append(byte)
        kept += run.decode(errors="ignore")
        assert (got[key].text, got[key].n_chars) == (kept, len(kept))


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _, before, _, pieces = stages["packing"]
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in before}
    covered, windows = {}, {}
    for r in pieces:
        own = ids[r.doc_id][r.start: r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)) and r.doc_tokens == len(ids[r.doc_id])
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, own in ids.items():
        at = 0
        for start, length in sorted(covered[key]):
            assert start == at
            at += length
        assert at == len(own)
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(windows) * 4096 <= 1.05 * sum(map(len, ids.values())) + 4096
