"""The pattern index against plain matching."""

import random
import re

import pyarrow as pa

from siftloom.operators import patterns as PT


def test_required_literals():
    found = lambda p: PT.required_literals(p)
    assert found(r"/news/\d+/a?bc") == [["/news/", "/", "bc"]]
    assert found(r"x+yz|\.pdf$") == [["x", "yz"], [".pdf"]]
    assert found(r"ab{2}c*d[e)]f(g|h)i") == [["a", "d", "f", "i"]]
    assert found(r"[]x]q") == [["q"]] and found(r"[^]x]q") == [["q"]]
    assert found("(?i)abc") == [[]] and found(r"\x41b") == [[]] and found("a|") == [["a"], []]
    for p in (r"\d+", "", ".*", "[a-z]"):
        assert found(p) == [[]]


def test_grams_take_numbers_whole():
    batch = pa.RecordBatch.from_pydict({"pattern": [r"/(en|fr)/[0-9]*123456([/?#.]|$)", "/de/12", "ab", "archive/2024"]})
    got = {}
    for row in next(iter(PT._grams([batch]))).to_pylist():
        got.setdefault(row["pattern"], set()).add(row["gram"])
    # three digits of a number would make all numbers that share them meet the same URLs
    assert list(got.values()) == [{"123456"}, {"/de/12"}, {"ab"}, {"archive/", "rchive/2", "chive/20", "hive/202", "ive/2024"}]


def test_looked_up_rows_are_dealt_out(spark):
    rows = spark.createDataFrame([(f"https://a.test/{i}",) for i in range(200)], "url string")
    seen = []
    cut, PT.cut_lineage = PT.cut_lineage, lambda df: seen.append(df.rdd.getNumPartitions()) or cut(df)
    try:
        assert PT.pattern_matches(rows, spark.createDataFrame([("/17$",)], "pattern string")).count() == 1
    finally:
        PT.cut_lineage = cut
    assert seen[:2] == [8, 8]


def brute(urls, patterns):
    compiled = [(p, re.compile(p)) for p in patterns]
    return sorted((u, p) for u in set(urls) for p, c in compiled if c.search(u))


def test_random_patterns_equal_plain_matching(spark):
    draw = random.Random(3)
    parts = ["a", "b", "ab", "/", r"\.", "c+", "b*", "a?", "[ab]", "(a|bc)", ".", "abc", r"\d", "x{2}", "(?:ca)", "^", "$", "|"]
    patterns = []
    while len(patterns) < 300:
        p = "".join(draw.choice(parts) for _ in range(draw.randint(1, 6)))
        try:
            re.compile(p)
        except re.error:
            continue
        patterns.append(p)
    urls = ["".join(draw.choice("abc/.x1") for _ in range(draw.randint(0, 12))) for _ in range(150)] + [""]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, None, urls[0]])], "n int, url string")
    table = spark.createDataFrame([(p,) for p in [*patterns, None, patterns[0]]], "pattern string")
    assert sorted(map(tuple, PT.pattern_matches(rows, table).collect())) == brute(urls, set(patterns))


def test_a_hundred_thousand_patterns(spark):
    draw = random.Random(4)
    patterns = {f"/{draw.randrange(10**6)}/" if i % 2 else rf"item-{i}\.html?$" for i in range(100_000)}
    urls = [f"https://h.test/{draw.randrange(10**6)}/item-{draw.randrange(10**5)}.html" for _ in range(25)]
    some = draw.sample(sorted(patterns), 20)
    urls += ["https://h.test" + p.replace("\\", "").replace("?$", "") for p in some]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    literal = sorted((u, p) for u in set(urls) for p in patterns if p.replace("\\.html?$", "") in u and re.search(p, u))
    got = sorted(map(tuple, PT.pattern_matches(rows, table).collect()))
    assert got == literal and len(got) >= 20


def test_lists_and_empty_tables(spark):
    rows = spark.createDataFrame([("https://a.test/x",), ("https://a.test/y",), (None,)], "url string")
    patterns = lambda *p: spark.createDataFrame([(x,) for x in p], "pattern string")
    got = {r.url: (r.included_by, r.excluded_by, r.passes) for r in PT.filter_by_patterns(rows, patterns("x$", "a.te"), patterns("y")).collect()}
    assert got == {"https://a.test/x": ("a.te", None, True), "https://a.test/y": ("a.te", "y", False), None: (None, None, False)}
    got = {r.url: r.passes for r in PT.filter_by_patterns(rows, patterns(), patterns()).collect()}
    assert all(got.values())
