"""Page extraction on own markup: nesting, references, contexts and records."""

import random

from pyspark.sql import functions as F

from siftloom.functions import html as H
from siftloom.operators import links as LK

HOME = "https://garden.test/beds/rose"


def pages(spark, html, url=HOME):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def urls_of(df):
    return {r.url for r in df.select("url").collect()}


def test_anchors_of_every_spelling(spark):
    html = """<p><a class=n href=soil>Soil</a> <A HREF='../tools?b=2&amp;a=1'>Tools</A> <a href="//seeds.test/list#new">Seeds</a>
    <a href="#top">up</a> <a href="tel:5">text us</a> <a href="javascript:go()">go</a> <!-- <a href="/secret">no</a> --> <a>nothing</a></p>"""
    assert urls_of(LK.page_links(pages(spark, html))) == {
        "https://garden.test/beds/soil", "https://garden.test/tools?b=2&a=1", "https://seeds.test/list#new"}


def test_context_of_links(spark):
    html = """<h3>Spring</h3><p>intro</p><a href="/bulbs"><span>Bulb <b>chart</b></span></a>
    <h3>Autumn</h3><div class="panel-heading">Leaf care</div><a href="/rakes" title="All rakes">7</a><a href="/gloves">Gloves</a>"""
    rows = {r.url.rsplit("/", 1)[1]: r for r in LK.page_links(pages(spark, html)).collect()}
    assert (rows["bulbs"].heading, rows["bulbs"].text, rows["bulbs"].accordion_group) == ("Spring", "Bulb chart", "")
    assert (rows["rakes"].heading, rows["rakes"].accordion_group) == ("Autumn", "Leaf care")
    assert rows["gloves"].best_name == "Gloves"


def test_context_of_many_links(spark):
    draw, parts, expected, heading = random.Random(4), [], {}, ""
    for i in range(400):
        if draw.random() < 0.4:
            heading = f"Part {i}"
            parts.append(f"<h2>{heading}</h2>")
        parts.append(f'<a href="/n{i}.zip">Number {i}</a><a href="/n{i // 2}.zip">Again {i}</a>')
        expected[f"https://garden.test/n{i}.zip"] = heading
    page = pages(spark, "".join(parts))
    first = {r.url: r.heading for r in LK.page_links(page).where("text LIKE 'Number%'").collect()}
    assert all(expected[u] == h for u, h in first.items()) and len(first) >= 200
    files = LK.page_downloads(page).collect()[0].downloadable_files
    assert len(files) == len({f.url for f in files}) == 400


def test_resources_of_every_kind(spark):
    html = """<picture><source srcset="/w/small.webp 1x, /w/large.webp 2x"><img src="/w/plain.gif"></picture><audio src="/birds.ogg"></audio>
    <object data="plan.svg"></object><link rel="stylesheet" href="/main.css"><link rel="alternate" href="/news.rss">
    <section style='background-image: url("/bg/soil.png")'></section><script>load("https://files.garden.test/deep/map.geojson")</script>"""
    got = urls_of(LK.resource_urls(pages(spark, html)))
    assert {"https://garden.test" + p for p in ("/w/small.webp", "/w/large.webp", "/w/plain.gif", "/birds.ogg", "/beds/plan.svg", "/news.rss", "/bg/soil.png")} <= got
    assert "https://garden.test/main.css" not in got


def test_json_addresses(one):
    find = lambda t: one(H.json_urls(F.col("t"), F.lit("https://garden.test/")), t=t)
    text = '{"items": [{"url": "https://seeds.test/p\\u0061ck.zip"}, {"deep": {"href": "guides/sow.pdf"}}], "url": 5, "note": "guides"}'
    assert {"https://seeds.test/pack.zip"} <= set(find(text)) and "https://garden.test/guides" not in find(text)
    assert find('{"url": "https://seeds.test/cut') == [] and find("[]") == []


def test_json_with_a_very_long_string(one):
    text = '{"log": "' + "ab\\\\t" * 150_000 + '", "url": "https://seeds.test/late"}'
    assert one(H.json_urls(F.col("t"), F.lit("https://garden.test/")), t=text) == ["https://seeds.test/late"]


def lines(one, html):
    return one(H.page_lines(F.col("h")), h=html)


def test_text_ends_with_its_container(one):
    assert lines(one, '<body>before<div id="textbody">Row <b>one</b><div><div>deep</div>still in</div></div>after</body>') == ["Row", "one", "deep", "still in"]
    assert lines(one, "<article>outer<article>inner</article>outer again</article>rest") == ["outer", "inner", "outer again"]
    assert lines(one, "<div class='x entry-content y'>kept<div>also</div></div><div>gone</div>") == ["kept", "also"]
    assert lines(one, "<html><head><title>T</title></head>no body <i>tag</i></html>") == ["no body", "tag"]
    assert lines(one, "") == []


def test_furniture_goes_whole(one):
    html = """<body><div class="side menu"><div>a<div>b</div></div>tail of the menu</div><p>kept</p><nav><nav>c</nav>d</nav>
    <span class="sidebar"/><p>more</p><select><option>e</option></select><script>"<p>f</p>"</script><!-- <p>g</p> --><br>end<footer>h</footer></body>"""
    assert lines(one, html) == ["kept", "more", "end"]


def test_character_references(one):
    assert lines(one, "<main><p>caf&eacute; &rsquo;&euro;&hellip; &amp;lt; &#1705;&#x6CC; &bogus; R&D</p><p>x</p><p>x</p></main>") == ["café ’€… &lt; کی &bogus; R&D", "x"]
    assert one(H.title(F.col("h")), h="<title>&Uuml;ber &laquo;Gr&ouml;&szlig;e&raquo;</title>") == "Über «Größe»"


def test_web_page_record(spark):
    words = "Roses need deep soil, sun for half a day, and water at their roots in dry weeks."
    html = f"""<html lang="de"><head><title>Rose beds</title><meta name="description" content="How to lay a bed"></head><body><main><h1>Rose beds</h1>
    <p>{words}</p><p>{words.replace('Roses', 'Shrubs')}</p><a href="plan.pdf">Plan of the bed</a><a href="plan.pdf">repeat</a><a href="/all.zip">Everything</a></main></body></html>"""
    r = LK.web_page_records(pages(spark, html, "https://shop.garden.test/beds/rose#care")).collect()[0]
    assert (r.canonical_url, r.source_domain, r.source_subdomain, r.source_route) == ("https://shop.garden.test/beds/rose", "garden.test", "shop", "/beds/rose")
    assert r.is_usable and r.description == "How to lay a bed" and r.quality.word_count == r.word_count and len(r.content_fingerprint) == 64
    assert [(f.url, f.title) for f in r.downloadable_files] == [
        ("https://shop.garden.test/beds/plan.pdf", "Plan of the bed"), ("https://shop.garden.test/all.zip", "Everything")]


def test_unusable_record(spark):
    row = LK.web_page_records(pages(spark, "<title>Soon</title><body>Soon</body>"))
    assert not row.collect()[0].is_usable and LK.usable_pages(row).count() == 0


def test_interactive_targets(spark):
    html = """<button onclick="location.href='/open?bed=4'">Open</button><select><option value="https://seeds.test/s">s</option></select><object data="/map.pdf"></object>"""
    assert urls_of(LK.interactive_links(pages(spark, html))) == {"https://garden.test/open?bed=4", "https://seeds.test/s", "https://garden.test/map.pdf"}


def test_sitemap(one):
    xml = "<urlset><url><loc>\n  https://garden.test/p?x=1 </loc></url><url><loc>https://garden.test/q</loc></url></urlset>"
    assert one(H.sitemap_locs(F.col("x")), x=xml) == ["https://garden.test/p?x=1", "https://garden.test/q"]


def test_page_text_is_computed_once_for_a_filter_and_its_columns(spark):
    """The filter on usable records reads the text and the verdict, and does not compute them again."""
    html = "<html><title>T</title><body><h1>Head</h1><p>" + "plain words that fill the page " * 4 + "</p></body></html>"
    pages = spark.createDataFrame([(1, "https://a.example.com/x#y", html), (2, "https://a.example.com/z", "<p>short</p>")], "page_id long, url string, html string")
    usable = LK.usable_pages(LK.web_page_records(pages)).select("page_id", "word_count", "canonical_url")
    assert [tuple(r) for r in usable.collect()] == [(1, 25, "https://a.example.com/x")]
    plan = usable._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(<[a-zA-Z/!?][^>]*>|[^<]+|<)") == 1
