"""Kept indexes: digests of key ranges, posting lists, mergeable sketches."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from siftloom.operators import indexes as IX


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "storage_key string")


def test_differences_of_two_sides(spark, folder):
    draw = random.Random(2)
    common = [f"00_raw/{draw.randrange(10**9)}" for _ in range(3000)]
    catalog, storage = [*common, *common[:50], "only/catalog", None], [*common, "only/storage"]
    IX.write_key_index(keys(spark, catalog).repartition(5), "storage_key", f"{folder}/a")
    IX.write_key_index(keys(spark, storage).repartition(3), "storage_key", f"{folder}/b")
    got = {(r.key, r.state) for r in IX.reconcile_indexes(spark, f"{folder}/a", f"{folder}/b").collect()}
    assert got == {("only/catalog", "missing"), ("only/storage", "new")}
    # two keys differ, so two leaves at most are read
    assert 1 <= IX.differing_leaves(spark, f"{folder}/a", f"{folder}/b").count() <= 2
    assert IX.reconcile_indexes(spark, f"{folder}/a", f"{folder}/a").collect() == []


def test_an_empty_side(spark, folder):
    IX.write_key_index(keys(spark, ["x", "y"]), "storage_key", f"{folder}/a")
    IX.write_key_index(keys(spark, []), "storage_key", f"{folder}/b")
    assert sorted(tuple(r) for r in IX.reconcile_indexes(spark, f"{folder}/a", f"{folder}/b").collect()) == [("x", "missing"), ("y", "missing")]
    assert {r.state for r in IX.reconcile_indexes(spark, f"{folder}/b", f"{folder}/a").collect()} == {"new"}


def test_search_finds_what_a_scan_finds(spark, folder):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abÄc ") for _ in range(draw.randint(0, 9)))
    rows = {f"p{i}": (word(), draw.choice([None, word()])) for i in range(300)}
    frame = lambda r: spark.createDataFrame([(k, *v) for k, v in r.items()], "pk string, name string, url string")
    IX.write_postings(frame(rows), "pk", ["name", "url"], folder, "0")
    changed = {f"p{i}": (word() + "abc", None) for i in range(0, 60, 2)} | {"new": ("ABC end", "x")}
    IX.write_postings(frame(changed), "pk", ["name", "url"], folder, "1")
    IX.write_postings(frame(changed), "pk", ["name", "url"], folder, "1")  # written again
    rows |= changed
    for search in ("abc", " ABC ", "bä", "c", "abca", "zzz", "b a", "a b c"):
        text = search.strip().lower()
        want = {k for k, v in rows.items() if any(x is not None and text in x.lower() for x in v)}
        assert {r.pk for r in IX.search_postings(spark, folder, search).collect()} == want, search
    plan = IX.search_postings(spark, folder, "abcab")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part" in plan or "part" in plan.split("PartitionFilters")[1]


def test_lists_of_shared_grams_stay_small(spark, folder):
    names = [f"Report {i} - file of the archive" for i in range(4000)]
    rows = spark.createDataFrame([(f"p{i}", n) for i, n in enumerate(names)], "pk string, name string").repartition(2)
    IX.write_postings(rows, "pk", ["name"], folder)
    listed = spark.read.parquet(f"{folder}/lists")
    by_row = sum(len({n[i: i + 3] for i in range(len(n) - 2)}) for n in names)
    assert listed.select(F.sum(F.size("units")).alias("n")).first().n < by_row / 5
    for search in ("report 12", "t 77", "archive", "3999 -", "xreport"):
        assert {r.pk for r in IX.search_postings(spark, folder, search).collect()} == {f"p{i}" for i, n in enumerate(names) if search in n.lower()}


def test_lists_name_units_of_blocks_in_pieces():
    def of(rows):
        ids, values = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.list_(pa.string()))], ["id", "values"])

    block = 1 << 16
    batches = [of([(0, ["abc", "", "b"]), (1, []), (15, ["Äbcd"])]), of([(16, ["xabc"]), (block, ["abc"]), (block + 40, ["ab", "cab"])])]
    got = {}
    for batch in IX.posting_lists(iter(batches)):
        for row in batch.to_pylist():
            got.setdefault((row["block"], row["gram"]), []).extend(row["units"])
    code = lambda gram: IX.gram_codes(gram)[0].item()
    assert got == {(0, code("abc")): [0, 1], (0, code("Äbc")): [0], (0, code("bcd")): [0], (0, code("xab")): [1],
                   (1, code("abc")): [0], (1, code("cab")): [2]}


def test_merged_sketches_stay_within_their_bounds(spark):
    draw = random.Random(7)
    values = [(i % 20, f"v{min(int(draw.expovariate(1 / 300)), 20_000)}" if i % 3 else f"rare{i}") for i in range(60_000)]
    rows = spark.createDataFrame(values, "run int, v string")
    merged = IX.merged_counts(IX.sketch_counts(rows, "run", F.col("v")).withColumn("all", F.lit(1)), ["all"], 10).first()
    exact = Counter(v for _, v in values)
    assert merged.n == 60_000
    assert abs(merged.distinct - len(exact)) < 0.08 * len(exact)
    bound = merged.n / (0.26 * 2048)
    assert all(abs(x["count"] - exact[x["item"]]) <= bound for x in merged.top)
    small = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (3, "a")], "run int, v string")
    few = IX.merged_counts(IX.sketch_counts(small, "run", F.col("v")).withColumn("all", F.lit(1)), ["all"], 5).first()
    assert (few.n, few.distinct, [(x["item"], x["count"]) for x in few.top]) == (4, 2, [("a", 3), ("b", 1)])
