"""Embedding whitening and benchmark decontamination against brute force, and their edge cases."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from siftloom.llm import decontaminate, exactpoly, whitening
from siftloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(decontaminate.WORD)


def test_whitening_query(spark):
    got = QUERIES["op12_embedding_whitening"](spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().set_index("vec_id")
    x = np.floor(64 * np.stack(rows.embedding.values).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    values, vectors = np.linalg.eigh(away.T @ away / n**3)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    assert len(got) == n * 32 and set(got.n) == {n}
    deviation = dict(zip(rows.index, (away * away).sum(axis=1), strict=True))
    assert all(deviation[a] == b for a, b in zip(got.vec_id, got.deviation, strict=True))
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.index].values
    theirs = (away / n) @ vectors / np.sqrt(values)
    sign = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine - theirs * sign).max() < 1e-9
    share = got.groupby("component").explained.first().values
    assert np.allclose(share, values / np.trace(away.T @ away / n**3), rtol=1e-9)
    error = np.abs(np.cov(mine.T, bias=True) - np.eye(32)).max()
    assert set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-9 and error < 1e-9


def frame(spark, vectors, kind="double"):
    rows = [(i, v, 7, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, id int, vec string").repartition(3)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 0.0, 2.0], [0.0, 1.5, 2.0], [-1.0, 0.5, 2.0], [1.0, 0.0, 2.0]]
    rows, model = whitening.whiten(frame(spark, [*good, None, [], [1.0, None, 2.0], [nan, 0.0, 0.0], [inf, 0.0, 1.0], [1.0, 2.0]]))
    found = {r.vec_id: r for r in rows.collect()}
    # one dimension never varies, so there are two components
    assert sorted(found) == [0, 1, 2, 3] and model.n == 4 and len(model.values) == 2
    assert found[0][1:] == found[3][1:] and whitening.identity_error(rows) < 1e-12
    assert abs(sum(model.explained) - 1) < 1e-12
    for same in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None]):
        rows, model = whitening.whiten(frame(spark, same))
        assert model is None and rows.collect() == []


def test_whitening_of_huge_entries_is_exact(spark):
    draw = random.Random(4)
    vectors = [[draw.uniform(-1, 1) * 10.0 ** draw.randint(0, 30), draw.gauss(0, 1)] for _ in range(30)]
    rows, model = whitening.whiten(frame(spark, vectors))
    x = [[int(Fraction(c) * 64 // 1) for c in v] for v in vectors]
    assert model.n == 30 and model.sums == [sum(v[j] for v in x) for j in range(2)]
    assert len(model.values) == 2 and all(r.deviation is None for r in rows.collect() if max(map(abs, x[r.vec_id])) > 2**70)


def test_equal_eigenvalues_take_a_basis(spark):
    vectors = [[s * float(i == j) for i in range(6)] for j in range(6) for s in (1.0, -1.0)]
    rows, model = whitening.whiten(frame(spark, vectors))
    assert len(set(model.values)) == 1 and len(model.values) == 6
    assert np.allclose(np.array(model.vectors) @ np.array(model.vectors).T, np.eye(6), atol=1e-14)
    assert whitening.identity_error(rows) < 1e-12


@pytest.mark.parametrize("d, n", [(1, 4), (2, 9), (5, 4), (9, 40)])
def test_exact_spectrum(d, n):
    draw = np.random.default_rng(d)
    y = draw.integers(-50, 50, (n, d))
    y[:, -1] = y[:, 0]
    a = (n * (y.T @ y) - np.outer(y.sum(axis=0), y.sum(axis=0))).tolist()
    trace = sum(a[i][i] for i in range(d))
    residues, product = [], 1
    for p in exactpoly.primes():
        if product > 2 * exactpoly.coefficient_bound(trace, d) + 1:
            break
        residues.append((p, exactpoly.characteristic_mod(a, p)))
        product *= p
    poly = exactpoly.remaindered(residues)
    # Cayley-Hamilton: the matrix is a root of its own polynomial
    total, power = np.zeros((d, d), dtype=object), np.eye(d, dtype=object) * 1
    for c in poly:
        total, power = total + c * power, power @ np.array(a, dtype=object)
    assert not total.any() and poly[-1] == 1
    while poly[0] == 0:
        poly.pop(0)
    values = np.linalg.eigvalsh(np.array(a, float))[::-1]
    for k in range(1, len(poly)):
        lo, hi, scale, place, group = exactpoly.root(list(poly), k, trace)
        e = float(Fraction(lo + hi, 1 << (scale + 1)))
        v = np.array(exactpoly.null_vectors(a, lo, hi, scale, group)[place - 1])
        assert abs(e - values[k - 1]) < 1e-12 * trace and np.abs(np.array(a, float) @ v - e * v).max() < 1e-13 * trace


# ---- benchmark decontamination


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s: s + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s: s + n]) in windows:
                    hit.update(range(s, s + n))
                    found.update(str(i) for i in windows[tuple(w[s: s + n])] if i is not None)
        yield (doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def order(row):
    return tuple((v is not None, v) for v in row)


def check(spark, folder, docs, items):
    extra = ["*", "1 AS _row", "2 AS _doc", "3 AS n_words", "4 AS found"]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr(*extra).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS window", "2 AS item").write.parquet(f"{folder}/benchmark.parquet")
    got = QUERIES["op13_benchmark_decontamination"](spark, folder).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=order) == sorted(expected(docs, items), key=order)


def test_decontamination(spark, folder, monkeypatch):
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    monkeypatch.setattr(decontaminate, "SHINGLES", 11)
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(25)] + ["é", "Ünï", "X", "l" * 90]
    text = lambda n: draw.choice([" ", "\n", ", ", "-"]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 1, 2, 3, 4, 9, 10, 11, 12, 30, 30])]
    items += [(50, items[8][1]), (51, items[9][1].upper().replace("É", "é")), (None, text(12)), (9, text(11)), (60, None), (61, "?!")]
    docs = [(i, text(draw.randint(0, 60))) for i in range(40)]
    for i, (_, body) in enumerate(items * 4):
        docs.append((100 + i, f"{text(draw.randint(0, 8))} {(body or '')[draw.randint(0, 20):]} {text(draw.randint(0, 8))}"))
    docs += [(None, items[9][1]), (None, None), (3, ""), (3, items[10][1]), (3, items[10][1]), (4, "w1 " * 30_000 + (items[9][1] or ""))]
    check(spark, folder, docs, items)


@pytest.mark.parametrize("docs, items", [([], [(1, "a b c")]), ([(1, "a b c"), (2, None)], []), ([(1, "a b c")], [(1, None), (2, "")]), ([], [])])
def test_decontamination_of_empty_tables(spark, folder, docs, items):
    check(spark, folder, docs, items)


def test_clean_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (None, "x", 6), (2, "A, b... C d", 7), (None, "y a b c", 8)], "doc_id long, text string, _hit int")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.clean_documents(docs, items).collect()] == []
    assert [tuple(r) for r in decontaminate.clean_documents(docs.where("_hit in (6, 7)"), items).collect()] == [(None, "x", 6)]
    found = decontaminate.contamination(docs, items).where("doc_id = 2").first()
    assert [tuple(s) for s in found.spans] == [(1, 3)] and found["items"] == ["1"]
