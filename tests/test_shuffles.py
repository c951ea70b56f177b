"""Plans that shuffle each row once, and only the columns asked for."""

import re

from pyspark.sql import functions as F

from siftloom.operators import catalog as CT
from siftloom.operators import changes as CH
from siftloom.operators import skew as SK
from siftloom.plans import catalog as PC


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_numbered_rows_hold_only_what_is_asked_for(spark, monkeypatch):
    written = []
    real = SK.cut_lineage
    monkeypatch.setattr(SK, "cut_lineage", lambda df: written.append(df.columns) or real(df))
    PC.w4(spark, "/root/testdata/sf0.001")
    assert [sorted(c) for c in written] == [["_at", "created_at", "file_pk"]]


FILES = "file_pk string, file_id string, file_name string, original_filename string, extension string, sha256 string, storage_key string, created_at int"


def test_reconciled_rows_are_shuffled_once(spark):
    hash_of = lambda c: c * 64
    files = spark.createDataFrame([(f"f{i}", None, None, None, None, h, k, i) for i, (h, k) in enumerate(
        [(hash_of("A"), "/a"), (hash_of("b"), "b"), ("odd", "b"), (None, "c"), (hash_of("d"), None)])], FILES)
    objects = spark.createDataFrame([("a", hash_of("a"), 1), ("a", hash_of("a"), 1), ("/x", hash_of("a"), 2), ("y", "ODD", 3), ("z", None, 4), (r"\w", hash_of("e"), 5)], "key string, sha256 string, size long")
    out = CT.reconcile(files, objects)
    got = {r.key: (r.in_catalog, r.in_storage, r.catalog_rows, r.sha256, r.size, r.state) for r in out.collect()}
    assert got == {
        "a": (True, True, 1, hash_of("a"), 1, "synced"), "b": (True, False, 2, None, None, "missing"), "c": (True, False, 1, None, None, "missing"),
        "x": (False, True, 0, hash_of("a"), 2, "known_content"), "y": (False, True, 0, "odd", 3, "known_content"),
        "z": (False, True, 0, None, 4, "new"), "w": (False, True, 0, hash_of("e"), 5, "new")}
    assert out.count() == len(got)
    assert "ReusedExchange" in plan_of(out.select("key", "catalog_rows", "state"))
    assert "ReusedExchange" in plan_of(CT.reconciliation_summary(out))


def test_ranges_of_keys_are_shuffled_once(spark, folder, monkeypatch):
    from siftloom.operators import indexes as IX

    keys = spark.createDataFrame([("/a",), ("a",), ("b",), (None,)], "storage_key string")
    plans = []
    real = IX.F.broadcast
    monkeypatch.setattr(IX.F, "broadcast", lambda df: plans.append(df) or real(df))
    for side in "ab":
        IX.write_key_index(keys, "storage_key", f"{folder}/{side}")
    rows = spark.read.parquet(f"{folder}/a/keys").select("key", "rows")
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 2), ("b", 1)]
    assert IX.reconcile_indexes(spark, f"{folder}/a", f"{folder}/b").collect() == [] and len(plans) == 2


def test_processing_summary_shuffles_no_files(spark):
    files = spark.createDataFrame([
        ("1", "RAW-000000001", "a.pdf", "a.pdf", ".pdf", "x", None, 1), ("2", "RAW-000000002", "b-RAW-000000002.pdf", None, ".pdf", "x", None, 2),
        ("3", "RAW-000000003", "c-RAW-000000003.pdf", None, ".pdf", "y", None, 3), ("4", "RAW-000000004", "d.pdf", "", ".pdf", " ", None, 4),
        ("5", "RAW-000000005", "e-RAW-000000005.pdf", None, ".pdf", None, None, 5), ("6", "RAW-000000006", None, None, ".pdf", None, None, 6)], FILES)
    out = CH.processing_summary(files)
    assert tuple(out.collect()[0]) == (6, 3, 2, 1)
    assert tuple(CH.processing_summary(files.limit(0)).collect()[0]) == (0, 0, 0, 0)
    assert "Join" not in plan_of(out)


def test_preview_names_only_the_rows_it_shows(spark):
    files = spark.createDataFrame([(str(i), f"RAW-{i:09}", f"{i}.pdf", f"{i}.pdf", ".pdf", "x", None, i) for i in range(9)], FILES)
    out = CH.preview_processing(files, 3)
    assert [(r.file_pk, r.new_name, r.is_duplicate) for r in out.collect()] == [(str(i), f"{i}-RAW-{i:09}.pdf", i > 0) for i in range(3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "new_name" not in plan[plan.index("Sort ["):]


def test_catalog_names_end_without_a_newline(spark, one):
    from siftloom.functions import files as FN

    assert one(FN.sanitize_catalog_name(F.col("n")), n="a9\n") == "a9"


def test_few_rows_are_compared_with_many_keys(spark, monkeypatch):
    monkeypatch.setattr(SK, "FEW_KEYS", 10)
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else f"k{i % 5000}") for i in range(20_000)], "n int, k string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 5000, 10)] + [(None,), ("k10",)], "k string")
    want = [i for i in range(20_000) if i % 11 == 0 or i % 5000 % 10]
    for words in (1 << 20, 1):
        monkeypatch.setattr(SK, "MARK_WORDS", words)
        seen = []
        real = SK.without
        monkeypatch.setattr(SK, "without", lambda r, *a, **b: seen.append(r) or real(r, *a, **b))
        assert sorted(r.n for r in real(rows, keys, "k", few_rows=True).collect()) == want
        assert (seen[-1].count() < 5000) == (words > 1)
        monkeypatch.setattr(SK, "without", real)
