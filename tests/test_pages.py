"""Hand-made pages through the parser, the field rules and the record rules."""

import pytest
from pyspark.sql import functions as F

from tradebook.functions import urls
from tradebook.operators import extract as ex
from tradebook.operators import fields as fl
from tradebook.operators import html as h


def parsed(spark, html, url="https://a.com/x"):
    return h.parse_pages(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"))


def field(spark, html, column):
    return fl.with_json_ld(parsed(spark, html)).select(column.alias("f")).first().f


def test_tree_closes_implied_tags(spark):
    p = parsed(spark, "<ul><li>a<li>b <b>c</b></ul><p>x<p>y<div>z</div><table><tr><td>1<td>2<tr><td>3</table>")
    rows = {(r.tag, r.element_text) for r in h.elements(p).collect()}
    assert {("li", "a"), ("li", "b c"), ("p", "x"), ("p", "y"), ("td", "1"), ("td", "2"), ("tr", "3"), ("div", "z")} <= rows


def test_tree_entities_scripts_and_empty(spark):
    p = parsed(spark, "<p title='q&amp;a' class='x y'>a &lt; b&nbsp;c</p><script>if (a<b) {}</script><br/><i/>")
    got = {r.tag: r for r in h.elements(p).collect()}
    assert got["p"].element_text == "a < b\u00a0c" and got["p"].attrs == {"title": "q&a", "class": "x y"} and got["p"].classes == ["x", "y"]
    assert got["script"].element_text == "if (a<b) {}"
    assert parsed(spark, "").first().nodes == [] and parsed(spark, None).first().text == ""


def test_intervals_hold_descendants(spark):
    p = parsed(spark, "<div><p>a<b>c</b></p></div><div>d</div>")
    n = {(r.tag, r.seq): (r.last, r.parent, r.depth) for r in h.elements(p).collect()}
    assert n == {("div", 0): (2, -1, 0), ("p", 1): (2, 0, 1), ("b", 2): (2, 1, 2), ("div", 3): (3, -1, 0)}


def test_visible_text(spark):
    p = parsed(spark, "<head><title>t</title></head><body>a<nav>n<script>s</script></nav> b<footer>f</footer></body>")
    from tradebook.functions.fixed_values import HIDDEN_TAGS

    assert p.select(h.visible_text(HIDDEN_TAGS)).first()[0] == "a b"


def test_logo_is_absolute(spark):
    got = field(spark, '<div class="logo"><a href="/"><img src="/img/l.png"></a></div>', fl.logo())
    assert (got.value, got.confidence) == ("https://a.com/img/l.png", 0.95)


def test_logo_skips_trackers_and_falls_back(spark):
    got = field(spark, '<div id="logo"><img src="/pixel.gif"></div><link rel="icon" href="/f.ico">', fl.logo())
    assert (got.value, got.source) == ("https://a.com/f.ico", "favicon")


def test_description_order(spark):
    long = "x" * 60
    assert field(spark, f'<meta name="description" content="{long}"><p>{long}</p>', fl.description()).source == "meta_description"
    assert field(spark, f'<meta property="og:description" content="{long}">', fl.description()).confidence == 0.7
    assert field(spark, f"<p>short</p><p>{long}</p>", fl.description()).value == long
    assert field(spark, "<p>short</p>", fl.description()).value is None


def test_name_order(spark):
    ld = '<script type="application/ld+json">{"legalName": "Legal Co"}</script>'
    assert field(spark, ld + "<h1>H</h1>", fl.company_name()).value == "Legal Co"
    assert field(spark, '<meta property="og:site_name" content="Site Co"><h1>Head</h1>', fl.company_name()).source == "og_site_name"
    assert field(spark, "<title>Firm One - Home | x</title>", fl.company_name()).value == "Firm One"


def test_contacts(spark):
    html = '<a href="mailto:a@b.co?x=1">m</a> c@d.org you@placeholder.io <a href="tel:+966 11 222 3333">t</a><a href="https://twitter.com/firm">t</a>'
    assert field(spark, html, fl.emails()).value == ["a@b.co", "c@d.org"]
    assert field(spark, html, fl.phones()).value[0] == "+966 11 222 3333"
    assert field(spark, html, fl.social_links()).value == {"twitter": "https://twitter.com/firm"}


def test_address_and_website(spark):
    assert field(spark, '<meta name="geo.placename" content="Riyadh"><meta name="geo.region" content="SA">', fl.address()).value == "Riyadh, SA"
    got = field(spark, '<a href="https://facebook.com/x">official</a><a href="/go">Visit site</a><link rel="canonical" href="/c">', fl.website())
    assert (got.value, got.confidence) == ("https://a.com/go", 0.9)


def test_harvest(spark):
    html = """<script type="application/ld+json">[{"@type": ["Organization", "Store"], "name": "N", "telephone": ["1", "2"], "email": "e@x.y",
      "address": {"streetAddress": "S", "addressCountry": {"name": "KSA"}}, "sameAs": ["https://linkedin.com/n", "https://x.com/n"], "taxID": "7"},
      {"name": "M", "id": "1010101010", "telephone": "2", "address": "All of it"}]</script><script type="application/ld+json">{broken</script>
      <meta property="og:image" content="/i.png"><meta name="geo.placename" content="Riyadh">"""
    r = fl.harvested(parsed(spark, html)).first()
    assert (r.name, r.phones, r.emails, r.street, r.country, r.linkedin, r.twitter, r.tax_id, r.cr_number, r.logo, r.full_address, r.found_in) == (
        "N", ["1", "2"], ["e@x.y"], "S", "KSA", "https://linkedin.com/n", "https://x.com/n", "7", "1010101010", "/i.png", "All of it, Riyadh", ["Organization,Store"],
    )


def test_visuals(spark):
    html = '<img src="/assets/header-icon.png" alt="logo"><img src="/media/my-logo.png"><section class="hero"><img src="/media/hero.jpg"></section>'
    got = parsed(spark, html).select(fl.visuals().alias("v")).first().v
    assert (got.logo, got.banner, got.confidence) == ("https://a.com/media/my-logo.png", "https://a.com/media/hero.jpg", 0.5)


@pytest.mark.parametrize("n,found", [(2, 0), (3, 3)])
def test_lists_need_three_items(spark, n, found):
    html = "<ul>" + "".join(f'<li><a href="/{i}">Firm {i}</a></li>' for i in range(n)) + "</ul>"
    assert ex.extract_records(parsed(spark, html), ["list"]).count() == found


def test_first_strategy_wins(spark):
    html = '<div class="company-card"><h3>Card Firm</h3></div><ul>' + '<li><a href="/">L</a></li>' * 3 + "</ul>"
    rows = ex.extract_records(parsed(spark, html)).collect()
    assert [(r.strategy, r.name_en) for r in rows] == [("cards", "Card Firm")]


def test_unknown_site_gets_generic_rules(spark):
    got = spark.createDataFrame([("https://unknown.example.org/list",)], "u string").select(ex.site_family(F.col("u")).alias("f")).first().f
    assert (got.family, got.score) == ("generic", 0.05)


def test_single_record_takes_page_fields(spark):
    html = '<div class="company-card"><h3>Firm</h3></div><meta name="description" content="A description that is long enough"><address>Gate 7, Riyadh</address>'
    p = parsed(spark, html)
    rec = ex.extract_records(p).withColumn("full_address", F.lit(None).cast("string"))
    row = fl.fill_single_records(rec, fl.page_fields(p)).first()
    assert row.description_en == "A description that is long enough" and row.full_address == "Gate 7, Riyadh" and row.field_confidence["description_en"] == 0.8


def test_baseline_beats_extracted_name(spark):
    ld = '<script type="application/ld+json">{"name": "Real Name", "description": "A better description of the firm", "telephone": "123"}</script>'
    p = parsed(spark, ld + '<div class="company-card"><h3>Firm</h3></div>')
    rec = ex.extract_records(p, ["cards"])
    row = fl.apply_baseline(rec, fl.harvested(p)).first()
    assert (row.name_en, row.description_en, row.phone) == ("Real Name", "A better description of the firm", "123")


def test_best_address(spark):
    df = spark.createDataFrame([(1, "Riyadh"), (1, "12 King Fahd Road, Riyadh"), (1, "x" * 300)], "k long, address string")
    assert ex.best_address(df, "k").first().address == "12 King Fahd Road, Riyadh"


def test_deep_nesting_is_parsed(spark):
    html = "<div>" * 3000 + "x" + "</div>" * 3000
    row = parsed(spark, html).select(F.size("nodes").alias("n"), F.expr("nodes[2999].last").alias("last"), "text").first()
    assert (row.n, row.last, row.text) == (3000, 2999, "x")


def test_families_keep_the_order_of_strategies():
    order = list(ex.STRATEGIES)
    for steps in ex.FAMILIES.values():
        at = [order.index(s) for s in steps]
        assert at == sorted(at)


def test_short_main_element_beats_body(spark):
    p = parsed(spark, "<body><p>" + "long text outside " * 10 + "</p><article>short</article></body>")
    assert ex.main_content(p).first().main_text == "short"


@pytest.mark.parametrize(
    "html,want",
    [
        ('<meta property="og:image" content="https://i.com/a.png"><div class="logo"><img src="/l.png"></div>', "https://i.com/a.png"),
        ('<meta property="og:image" content="https://i.com/site/img/logo.svg"><div class="logo"><img src="/l.png"></div>', "https://a.com/l.png"),
        ('<div class="product-slider"><img src="https://i.com/s.png"></div>', "https://i.com/s.png"),
        ('<div class="logo"><picture><source srcset="/l.svg 1x, /m.svg 2x"></picture></div>', "https://a.com/l.svg"),
        ('<div class="logo"><svg><use href="#x"></use><image xlink:href="/v.png"></svg></div>', "https://a.com/v.png"),
        ("<img src='/other.png'>", None),
    ],
)
def test_profile_logo(spark, html, want):
    assert parsed(spark, html).select(ex.profile_logo()).first()[0] == want


def test_pages_of_one_file_are_parsed_by_all_cores(spark, tmp_path):
    spark.range(40).write.parquet(f"{tmp_path}/part")
    html = F.concat(F.lit("<p>page "), F.col("id").cast("string"), F.lit("</p>"))
    pages = spark.read.parquet(f"{tmp_path}/part").coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    parsed = h.parse_pages(pages)
    assert parsed.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["text"] for r in parsed.collect()) == sorted(f"page {k}" for k in range(40))


def test_profiles_work_out_a_title_once(spark):
    pages = spark.createDataFrame([(1, "https://g.sa/1", "<title>A firm</title><h1>A firm</h1>")], "page_id long, url string, html string")
    plan = ex.profiles(h.parse_pages(pages))._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate inline"):]
    assert "Filter" not in below  # a condition pushed below works the title out a second time


def test_links_without_a_value_resolve_to_nothing(spark):
    rows = [(None, "https://a.sa/x/y"), ("z", None), ("z", "no url"), ("z", "https://a.sa/x/y"), ("//b.sa/z", "https://a.sa"), ("mailto:m@a.sa", None), (" HTTP://B.sa ", None), ("", "https://a.sa/x?q")]
    df = spark.createDataFrame(rows, "r string, base string")
    got = [r[0] for r in df.select(urls.resolve(F.col("r"), F.col("base"))).collect()]
    assert got == [None, "z", "z", "https://a.sa/x/z", "https://b.sa/z", "mailto:m@a.sa", "http://b.sa/", "https://a.sa/x?q"]
