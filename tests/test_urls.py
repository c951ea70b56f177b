"""URL functions: generated cases against the standard library, and cases that combine rules."""

import itertools
from urllib.parse import parse_qsl, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from siftloom.functions import urls as U

#: Each address exercises several rules at once: (url, base, normal form or None).
COMBINED = [
    ("  HTTPS://Archive.Orchid.Test:443/Vol-3/Issue.HTML?page=2&utm_medium=mail&issue=9#notes ", None,
     "https://archive.orchid.test/Vol-3/Issue.HTML?issue=9&page=2"),
    ("/a/../b/./c/", "http://orchid.test:80/z", "http://orchid.test/b/c"),
    ("//cdn.orchid.test:8080/x/", "http://orchid.test/", "http://cdn.orchid.test:8080/x"),
    ("?lang=ku&from=list#end", "https://orchid.test/items/7?lang=en", "https://orchid.test/items/7?from=list&lang=ku"),
    ("../../covers/1 2.png", "https://orchid.test/books/7/pages/", "https://orchid.test/books/covers/1%202.png"),
    ("https://orchid.test/ئاو/%D8%A6%D8%A7%D9%88/", None, "https://orchid.test/%D8%A6%D8%A7%D9%88/%D8%A6%D8%A7%D9%88"),
    ("https://reader:pw@orchid.test/shelf;v=2?open", None, "https://orchid.test/shelf?open="),
    ("https://orchid.test/100%/!(x)*", None, "https://orchid.test/100%/%21%28x%29%2A"),
    ("data:text/plain,hello", None, None), ("sms:+100", None, None), ("\t\n", None, None), ("http://", None, None),
    ("https://orchid.test:70000/", None, None), ("https://orchid.test:eighty/", None, None), ("orchid", None, None),
]


def test_combined_rules(spark):
    rows = [(i, u, b or "") for i, (u, b, _) in enumerate(COMBINED)]
    df = spark.createDataFrame(rows, "i int, u string, b string")
    plain = df.where("b = ''").select("i", U.normalize_url(F.col("u")).alias("n"))
    joined = df.where("b <> ''").select("i", U.normalize_url(F.col("u"), F.col("b")).alias("n"))
    got = {r.i: r.n for r in plain.union(joined).collect()}
    assert got == {i: n for i, (_, _, n) in enumerate(COMBINED)}


BASES = ["https://lilac.test/one/two/three", "http://lilac.test:8081/one/", "https://lilac.test"]
REFERENCES = ["four", "./four/five", "../six", "../../../../seven", "/eight/../nine", "?k=v&a=b", "#part", "//fern.test/x", "ten//eleven/./twelve", "https://fern.test/y?z=1"]


def test_resolution_agrees_with_the_standard_library(spark):
    cases = list(itertools.product(BASES, REFERENCES))
    df = spark.createDataFrame([(i, r, b) for i, (b, r) in enumerate(cases)], "i int, u string, b string")
    for row in df.select("i", U.normalize_url(F.col("u"), F.col("b")).alias("n")).collect():
        base, reference = cases[row.i]
        mine, theirs = urlsplit(row.n), urlsplit(urljoin(base, reference))
        assert (mine.scheme, mine.netloc, mine.fragment) == (theirs.scheme, theirs.netloc, "")
        assert mine.path.rstrip("/").replace("//", "/") == theirs.path.rstrip("/").replace("//", "/"), (base, reference)
        assert parse_qsl(mine.query) == sorted(parse_qsl(theirs.query))


def test_spellings_of_one_address_meet_and_stay(spark):
    hosts, paths, queries = ["HTTPS://Fern.Test:443", "https://fern.test"], ["/Leaf/", "/Leaf"], ["?b=2&utm_source=a&a=1", "?a=1&b=2#x"]
    df = spark.createDataFrame([("".join(p),) for p in itertools.product(hosts, paths, queries)], "u string")
    once = df.select(U.normalize_url(F.col("u")).alias("n"))
    rows = once.select("n", U.normalize_url(F.col("n")).alias("m")).collect()
    assert {r.n for r in rows} == {r.m for r in rows} == {"https://fern.test/Leaf?a=1&b=2"}


@pytest.mark.parametrize("host,blocked", [
    ("127.8.9.10", True), ("LOCALHOST:3000", True), ("10.255.0.1", True), ("192.168.77.7", True), ("172.31.255.254", True), ("172.32.0.1", False),
    ("169.254.1.1", True), ("0.0.0.0", True), ("[::1]:80", True), ("[fd12::9]", True), ("8.8.4.4", False), ("10.fern.test", False), ("fern.test", False),
])
def test_private_hosts(one, host, blocked):
    assert one(U.private_host(F.col("u")), u=f"https://{host}/status?x=1") is blocked


def test_private_without_host(one):
    assert one(U.private_host(F.col("u")), u="/only/a/path") is True


@pytest.mark.parametrize("url,extensions,expected", [
    ("https://fern.test/catalog/v2.5", [], False), ("https://fern.test/people/jane.roe", [], False), ("https://fern.test/Annual.EPUB?x=1", [], True),
    ("https://fern.test/table.xlsx", [".xlsx", ".csv"], True), ("https://fern.test/table.xlsx", [".csv"], False), ("https://fern.test/site.css?next=a.zip", [], False),
    ("https://fern.test/plain", [".pdf"], False),
])
def test_downloadable(one, url, extensions, expected):
    assert one(U.is_downloadable_url(F.col("u"), extensions), u=url) is expected


@pytest.mark.parametrize("host,domain,expected", [
    ("leaf.fern.test", "fern.test", True), ("FERN.TEST", "fern.test", True), ("notfern.test", "fern.test", False), ("fern.test.evil.example", "fern.test", False),
])
def test_subdomains(one, host, domain, expected):
    assert bool(one(U.same_domain_or_subdomain(F.col("h"), F.col("d")), h=host, d=domain)) is expected


def test_allowed_domains(one):
    rule = lambda *domains: U.allowed_domain(F.col("u"), list(domains))
    assert one(rule("www.leaf.fern.test"), u="https://fern.test/q") and one(rule("fern.test"), u="https://deep.leaf.fern.test/")
    assert not one(rule("leaf.fern.test", "moss.test"), u="https://fir.test/") and one(rule(), u="nothing at all")
    assert one(U.allowed_resource_domain(F.col("u"), ["fern.test"]), u="https://img.fern.test/a.pdf")
    assert not one(U.allowed_resource_domain(F.col("u"), ["fern.test"]), u="https://fir.test/a.pdf")


def test_share_links(one):
    direct = U.cloud_share_to_direct(F.col("u"))
    key = "Zq-9_w"
    assert one(direct, u=f"https://drive.google.com/file/d/{key}/edit") == f"https://drive.google.com/uc?export=download&id={key}"
    assert one(direct, u="https://www.dropbox.com/s/q1/Leaf%20list.csv?dl=0").endswith("/s/q1/Leaf%20list.csv?dl=1")
    assert one(direct, u="https://fern.test/file/d/x/view") == "https://fern.test/file/d/x/view"


def test_file_names(one):
    name, header = U.filename_from_url(F.col("u")), U.filename_from_url(F.col("u"), F.col("h"))
    assert one(name, u="https://fern.test/get?file=%E2%82%AC%20list.csv") == "€ list.csv"
    assert one(name, u="https://fern.test/a/b/Leaf%20list.csv?x=1") == "Leaf list.csv"
    address = "https://fern.test/fetch"
    assert one(header, u=address, h="inline; filename*=utf-8''na%C3%AFve.txt") == "naïve.txt"
    assert one(header, u=address, h='attachment; filename="two words.odt"; size=3') == "two words.odt"
    assert one(header, u=address, h="attachment; filename=bare.odt") == "bare.odt"
    assert one(header, u=address, h=None) == "fetch"
