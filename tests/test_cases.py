"""Small inputs with known answers, one or more per rule."""

import pytest
from pyspark.sql import functions as F

from tradebook.functions import semantics as sem
from tradebook.functions import similarity as sim
from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.operators import crawl
from tradebook.operators import metrics as mt
from tradebook.operators import records as rec
from tradebook.operators import tables as tb
from tradebook.operators.slugs import unique_slugs


def value(spark, text, fn, dtype="string"):
    return spark.createDataFrame([(text,)], f"x {dtype}").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("http://www.A.com/b/?utm_source=x&z=1&a=2", "https://a.com/b?a=2&z=1"),
        ("a.com", "https://a.com/"),
        ("http://a.com:80/x#top", "https://a.com/x#top"),
        ("https://a.com:8443/", "https://a.com:8443/"),
        ("http://a.com/a%20b?q=a%20b&spJobID=1&x", "https://a.com/a%20b?q=a+b&x="),
        ("https://a.com/a/./b/../c//", "https://a.com/a/c/"),
        ("https://a.com/شركة", "https://a.com/%D8%B4%D8%B1%D9%83%D8%A9"),
        ("  https://a.com/x?  ", "https://a.com/x"),
        ("", None),
        (None, None),
        ("https://", None),
        ("not a host/x", None),
    ],
)
def test_canonical_url(spark, raw, want):
    assert value(spark, raw, urls.canonical_url) == want


def test_canonical_url_is_idempotent(spark):
    once = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(urls.canonical_url(F.col("url")).alias("u"))
    assert once.where(~urls.canonical_url(F.col("u")).eqNullSafe(F.col("u"))).count() == 0


@pytest.mark.parametrize(
    "link,base,want",
    [
        ("/img/l.png", "https://a.com/x/y", "https://a.com/img/l.png"),
        ("../z.html?q#f", "https://a.com/x/y/w", "https://a.com/x/z.html?q#f"),
        ("b", "https://a.com/x/y", "https://a.com/x/b"),
        ("?p=2", "https://a.com/x/y?p=1", "https://a.com/x/y?p=2"),
        ("#top", "https://a.com/x?p=1", "https://a.com/x?p=1#top"),
        ("//cdn.com/i.png", "http://a.com/", "http://cdn.com/i.png"),
        ("HTTP://B.com", "https://a.com/", "http://b.com/"),
        ("mailto:a@b.co", "https://a.com/", "mailto:a@b.co"),
        ("x", "no base", "x"),
        (None, "https://a.com/", None),
    ],
)
def test_resolve(spark, link, base, want):
    df = spark.createDataFrame([(link, base)], "l string, b string")
    assert df.select(urls.resolve(F.col("l"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("0512345678", "+966512345678"), ("512345678", "+966512345678"), ("(011) 234-5678", "+966112345678"), ("12", None),
        ("+966 50 1", None), ("00", None), ("+4912345678", "+4912345678"), ("1234567", "+1234567"), ("", None), (None, None),
    ],
)
def test_phone(spark, raw, want):
    got = value(spark, raw, tx.phone_number)
    assert (got["formatted"], got["confidence"]) == (want, 0.8 if want else 0.0)


@pytest.mark.parametrize(
    "raw,want", [("X Co. Ltd.", "X Co."), ("Acme LLC", "Acme"), ("Acme™ Company", "Acme"), ("  A   B  ", "A B"), (None, "")]
)
def test_company_name(spark, raw, want):
    assert value(spark, raw, tx.company_name) == want


def test_slugs(spark):
    assert value(spark, "Controls & Electrics Arabia Ltd.", tx.latin_slug) == "controls-electrics-arabia-ltd"
    assert value(spark, "شركة ABC & Co", tx.arabic_slug) == "شركة-abc-co"
    assert value(spark, "The Saudi Trading Company of Steel Pipes and Big Valves Now", tx.keyword_slug) == "steel-pipes-big-valves-now"
    assert value(spark, "Saudi Company", tx.keyword_slug) == "saudi-company"


def test_unique_slugs_skip_taken_numbers(spark, rows):
    df = spark.createDataFrame([(1, "b"), (2, "b"), (3, "b"), (4, "b-1"), (5, "b")], "id long, base string")
    out = dict(unique_slugs(df, "base", ["id"]).select("id", "slug").collect())
    assert out == {1: "b", 2: "b-2", 3: "b-3", 4: "b-1", 5: "b-4"}


def test_mapped_categories(spark):
    assert value(spark, ["Electrical", "4", "Unknown Category"], rec.mapped_categories, "array<string>") == ["2", "4", "Unknown Category"]


@pytest.mark.parametrize("raw,want", [(0.0, 0.0), (0.75, 0.75), (1.0, 1.0), (-0.1, 0.0), (1.1, 0.0), (float("nan"), 0.0), (None, 0.0)])
def test_clamped(spark, raw, want):
    assert value(spark, raw, rec.clamped, "double") == want


def test_clamp_payload(spark):
    df = spark.createDataFrame([(1.4, {"a": "0.8", "b": "-0.2", "c": "high"})], "confidence_score double, field_confidence map<string,string>")
    row = rec.clamp_payload(df).first()
    assert (row.confidence_score, row.field_confidence, row.clamped) == (0.0, {"a": 0.8, "b": 0.0, "c": 0.0}, True)


def test_storable_folds_place(spark):
    df = spark.createDataFrame([("", "Somewhere ", "Riyadh")], "full_address string, address string, city string")
    out = rec.storable(df)
    assert out.columns == ["full_address"] and out.first()[0] == "Somewhere, Riyadh"


def test_discovered_record_defaults(spark):
    df = spark.createDataFrame([("Firm", ["Electrical"], "Jeddah")], "name_en string, categories array<string>, city string")
    row = rec.discovered_record(df, F.lit("2024-01-01").cast("timestamp")).first()
    assert (row.slug, row.categories, row.status, row.full_address, row.city_id) == ("firm", ["2"], "pending", "Jeddah", "1")
    assert "city" not in row.asDict()


def test_enrichment_update(spark):
    text = '{"products": ["a", 1, "b"], "is_vat_registered": "true", "team_members": [{"name": "A", "role": " x "}, {"name": "", "role": "y"}, {"name": 3, "role": "z"}], "zzz": 1, "confidence_score": "0.9", "phone": ""}'
    row = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("p")).select(*rec.enrichment_update(F.col("p"))).first()
    assert row.products == ["a", "b"] and row.is_vat_registered is True and row.confidence_score == 0.0 and row.phone is None
    assert [(m.name, m.role) for m in row.team_members] == [("A", "x")]


def test_save_validation_rejects_score(spark):
    df = spark.createDataFrame([("A", "a", "vendor", 5.0)], "name_en string, slug string, business_type string, confidence_score double")
    row = rec.validated_for_save(df).first()
    assert not row.is_valid and row.errors == ["confidence_score out of range: 5.0"]


def test_batch_ids(spark):
    assert value(spark, [" a", "a", "", "b "], rec.batch_ids, "array<string>") == ["a", "b"]
    for bad in (None, [], [str(i) for i in range(101)]):
        with pytest.raises(Exception, match="1 to 100"):
            value(spark, bad, rec.batch_ids, "array<string>")


@pytest.mark.parametrize(
    "a,b,match,conf",
    [
        ("Acme Ltd", "acme", True, 0.95), ("abcdefgh", "abcdefghij", True, 0.64), ("abcdefghij", "abcdefghix", True, 0.81),
        ("abc", "xyz", False, 0.0), ("", "x", False, 0.0), ("ab", "abcd", False, 0.4),
    ],
)
def test_same_name(spark, a, b, match, conf):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    for x, y in (("a", "b"), ("b", "a")):
        got = df.select(sim.same_name(F.col(x), F.col(y)).alias("m")).first().m
        assert got.is_match == match and round(got.confidence, 6) == conf


def test_verdict_prefers_domain(spark):
    df = spark.createDataFrame([("A", "B", "http://www.x.com/1", "x.com")], "a string, b string, u string, v string")
    got = df.select(sim.duplicate_verdict(F.col("a"), F.col("b"), F.col("u"), F.col("v")).alias("d")).first().d
    assert (got.is_duplicate, got.confidence) == (True, 0.95)


def test_percentiles(spark):
    xs = F.array(*[F.lit(float(i)) for i in (1, 2, 3, 4)])
    got = spark.range(1).select(*[sem.sorted_percentile(xs, p) for p in (0.5, 0.9, 0.99)]).first()
    assert tuple(got) == (3.0, 4.0, 4.0)


def test_retry_plan(spark):
    df = spark.createDataFrame([(i, 5) for i in range(5)], "attempts int, max_attempts int")
    out = crawl.plan_retries(df, F.lit("2024-01-01").cast("timestamp")).orderBy("attempts").select("status", "wait_ms").collect()
    assert [tuple(r) for r in out] == [("pending", 1000), ("pending", 2000), ("pending", 4000), ("pending", 8000), ("dead_letter", None)]


ROBOTS = """# hello
User-agent: *
Disallow: /
Crawl-delay: 7
User-agent: MyBot
Allow: /Public/
Disallow: /public$
Disallow: /Private/*.pdf$   # papers
"""


@pytest.mark.parametrize(
    "path,agent,allowed,delay",
    [
        ("/anything", "other", False, 7), ("/anything", "mybot", True, 0), ("/public", "mybot", False, 0), ("/public/x", "mybot", True, 0),
        ("/Private/a.pdf", "mybot", False, 0), ("/Private/a.pdfx", "mybot", True, 0),
    ],
)
def test_robots(spark, path, agent, allowed, delay):
    texts = spark.createDataFrame([("https://a.com", ROBOTS)], "origin string, text string")
    pages = spark.createDataFrame([(f"https://A.com{path}",)], "url string")
    row = crawl.robots_allowed(pages, crawl.robots_policy(crawl.robots_rules(texts), agent)).first()
    assert (row.allowed, row.crawl_delay) == (allowed, delay)


def test_no_robots_allows(spark):
    texts = spark.createDataFrame([], "origin string, text string")
    row = crawl.robots_allowed(spark.createDataFrame([("https://a.com/x",)], "url string"), crawl.robots_policy(crawl.robots_rules(texts), "b")).first()
    assert row.allowed and row.crawl_delay == 0


def test_hex_mail_and_text_pieces(spark):
    key = 0x2A
    payload = f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in "a@b.co")
    assert value(spark, payload, tx.decode_hex_mail) == "a@b.co"
    assert value(spark, "zz", tx.decode_hex_mail) is None
    assert value(spark, "Makes goods such as Pumps, Valves , +966511111111, x@y.z. Also more, here", tx.products_in_sentence) == ["Pumps", "Valves"]
    assert value(spark, "call 00966 50 123 4567 now", tx.first_phone) == "+966501234567"
    got = value(spark, "شركة النور (Noor Co)", tx.split_title)
    assert (got.name_en, got.name_ar) == ("Noor Co", "شركة النور")
    assert value(spark, '["a", "b"]', tx.cell_to_array) == ["a", "b"]
    assert value(spark, "a, b,", tx.cell_to_array) == ["a", "b"]
    assert value(spark, "[object Object]", tx.cell_to_array) == []
    assert value(spark, "x<script>a<b</script>y javascript:z", tx.strip_scripts) == "xy z"


def test_upsert_twice_is_once(spark, rows):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    u = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = tb.upsert(t, u, ["id"])
    assert rows(once) == rows(tb.upsert(once, u, ["id"])) == [(1, "a"), (2, "c"), (3, "d")]


def test_contacts_null_and_blank_are_equal(spark):
    want = spark.createDataFrame([("1", "general", "a@b.co", None, None)], "company_id string, contact_type string, email string, phone string, whatsapp string")
    have = spark.createDataFrame([("1", "general", "a@b.co", "", "")], want.schema)
    assert tb.contacts_missing(want, have).count() == 0


def test_website_verdict(spark):
    def verdict(text, tags):
        df = spark.createDataFrame([(text, "A long title", "")], "b string, t string, m string")
        cond = {n: F.lit(n in tags) for n in ("nav", "footer", "contact", "about")}
        return df.select(rec.website_verdict(F.col("b"), F.col("t"), F.col("m"), F.lit(False), cond).alias("w")).first().w

    assert verdict("this domain is for SALE", []).confidence == 0.1
    good = verdict("About our company", ["nav", "footer", "contact", "about"])
    assert good.is_valid and good.confidence == 1.0


def test_queue_size_and_rate_limit(spark, rows):
    e = spark.createDataFrame([("q", i, a) for i, a in enumerate(["enqueued", "enqueued", "dequeued", "failed"])], "queue string, n long, action string")
    assert [r[2] for r in sorted(tuple(r) for r in mt.queue_size(e, ["n"]).select("queue", "n", "size").collect())] == [1, 2, 1, 1]
    c = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 1, 2, 9, 10, 11, 25, 26])], "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    out = mt.limited_calls(c, "k", "ts", "id", 10_000, 2).orderBy("id").select("allowed").collect()
    # windows open at 0, 10 and 25
    assert [r[0] for r in out] == [True, True, False, False, True, True, True, True]


def test_next_calls_are_found_in_one_pass(spark):
    times = spark.createDataFrame([(k, t) for k in "ab" for t in (0, 4, 9, 20)], "k string, t long")
    out = mt._next_at_or_after(times.select("k", (F.col("t") + 5).alias("at"), F.col("t").alias("from")), times)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()  # such a frame is read anew for every row
    assert {tuple(r) for r in out.collect()} == {(k, t, n) for k in "ab" for t, n in ((0, 9), (4, 9), (9, 20), (20, None))}
