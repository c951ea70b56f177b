"""Recording rows one after the other: batches against a plain replay."""

import random

import pytest
from pyspark.sql import functions as F

from siftloom.operators import changes as CH
from siftloom.operators import conflicts as CF

FILES = "file_pk string, file_id string, run_pk string, source_id string, file_name string, original_filename string, canonical_filename string, extension string, sha256 string, storage_key string, status string, metadata string"
ROWS = "seq long, run_pk string, source_id string, file_name string, sha256 string, storage_key string, status string, metadata string, extension string"


def replay(stored, rows):
    """(name, run, hash, status, key, metadata) of all files after recording rows in order."""
    files = [dict(r) for r in sorted(stored, key=lambda r: r["file_pk"])]
    for row in sorted(rows, key=lambda r: r["seq"]):
        match = None
        if row["status"] != "DUPLICATE":
            match = next((f for f in files if (row["sha256"] and f["sha256"] == row["sha256"]) or (row["storage_key"] and f["storage_key"] == row["storage_key"])), None)
        if match is None:
            files.append(dict(row))
        else:
            match.update({c: row[c] or match[c] for c in ("run_pk", "status", "storage_key", "metadata")})
    return sorted(tuple(f[c] or "" for c in ("file_name", "run_pk", "sha256", "status", "storage_key", "metadata")) for f in files)


def upserted(spark, stored, rows):
    columns = [c.split()[0] for c in FILES.split(", ")]
    files = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in stored], FILES)
    names = [c.split()[0] for c in ROWS.split(", ")]
    incoming = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ROWS)
    got = CH.upsert_files(files, incoming).collect()
    assert len({r.file_id for r in got}) == len(got) and all(r.file_pk for r in got)
    return sorted(tuple(r[c] or "" for c in ("file_name", "run_pk", "sha256", "status", "storage_key", "metadata")) for r in got)


def row(seq, sha, key, status="UPLOADED", run=None, metadata=None):
    return {"seq": seq, "run_pk": run, "source_id": "s", "file_name": f"n{seq}.txt", "sha256": sha, "storage_key": key,
            "status": status, "metadata": metadata, "extension": ".txt"}


@pytest.mark.parametrize("rows", [
    [row(1, "A", "k1"), row(2, "B", "k1"), row(3, "B", "k3")],
    [row(1, "A", "k1"), row(2, "A", "k9"), row(3, "C", "k1")],
    [row(1, "A", "k1", metadata="kept"), row(2, "A", "k1"), row(3, "A", None, run="r3")],
    [row(1, "A", "k1", "DUPLICATE"), row(2, "A", "k2"), row(3, None, "k1"), row(4, "A", None, "DUPLICATE")],
    [row(1, None, None), row(2, "", ""), row(3, None, "k"), row(4, "", "k")],
])
def test_files_that_share_keys(spark, rows):
    assert upserted(spark, [], rows) == replay([], rows)


@pytest.mark.parametrize("seed, hashes, keys, n", [(1, 4, 4, 40), (2, 30, 30, 60), (3, 3, 40, 60), (4, 40, 3, 60), (5, 200, 150, 150)])
def test_random_batches_equal_a_replay(spark, seed, hashes, keys, n):
    draw = random.Random(seed)
    sha = lambda: draw.choice([None, "", *[f"h{i}" for i in range(hashes)] * 3])
    key = lambda: draw.choice([None, "", *[f"k{i}" for i in range(keys)] * 3])
    stored = [{"file_pk": f"p{i:03}", "file_id": f"RAW-{i + 1:09}", "source_id": "s", "file_name": f"old{i}", "run_pk": draw.choice([None, "r"]),
               "sha256": sha() or None, "storage_key": key() or None, "status": draw.choice(["UPLOADED", "DUPLICATE", "FAILED"]), "metadata": "old"} for i in range(n // 2)]
    rows = [row(i, sha(), key(), draw.choices(["UPLOADED", "DUPLICATE", "FAILED"], [4, 1, 1])[0], draw.choice([None, "", f"run{i}"]), draw.choice([None, f"m{i}"])) for i in range(n)]
    draw.shuffle(rows)
    assert upserted(spark, stored, rows) == replay(stored, rows)


@pytest.mark.parametrize("few", [CF.FEW_EDGES, 0])
def test_components_of_a_chain_and_of_leaves(spark, monkeypatch, few):
    monkeypatch.setattr(CF.components, "__defaults__", (few,))
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(40)] + [(100 + i, "hub", f"leaf{i}") for i in range(5)]
    rows += [(200 + i, f"lone{i}", "one key") for i in range(3)] + [(300, None, "only b"), (301, "", ""), (302, "only a", None), (303, None, "leaf1")]
    df = spark.createDataFrame(rows, "seq long, a string, b string")
    groups = {}
    for r in CF.labels(df, "a", "b", "seq").collect():
        groups.setdefault(r.label, set()).add(r.seq)
    assert groups.pop(None) == {301}
    assert sorted(map(sorted, groups.values())) == [list(range(40)), [100, 101, 102, 103, 104, 303], [200, 201, 202], [300], [302]]


def test_first_claims_equal_a_replay(spark):
    draw = random.Random(8)
    for n, values in ((60, 12), (200, 60), (1, 1), (0, 1)):
        rows = [(i, draw.choice([None, *range(values)]), draw.choice([None, *range(values)])) for i in range(n)]
        want, seen = set(), (set(), set())
        for i, a, b in rows:
            if a not in seen[0] and b not in seen[1]:
                want.add(i)
                seen[0].update({a} - {None})
                seen[1].update({b} - {None})
        df = spark.createDataFrame(rows, "seq long, a string, b string").withColumn("extra", F.lit(1))
        assert {r.seq for r in CF.first_claims(df, ["a", "b"], "seq").collect()} == want
