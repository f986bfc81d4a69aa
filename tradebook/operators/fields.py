"""Company fields of a page: ranked branches over its elements, all inside the page's row.

Input is the result of ``parse_pages``; every function returns a column over its
``url``, ``text`` and ``nodes``.  A field is struct(value, confidence, source).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions import fixed_values as fv
from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.functions.semantics import let, trim_blanks
from tradebook.operators import html as h
from tradebook.operators.keys import top_per_key
from tradebook.session import checkpointed


def _field(value: Column, confidence: float, source: str, ok: Column) -> Column:
    return F.when(
        F.coalesce(ok, F.lit(False)),
        F.struct(value.alias("value"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source")),
    )


def _empty(dtype: str = "string") -> Column:
    return F.struct(
        F.lit(None).cast(dtype).alias("value"), F.lit(0.0).alias("confidence"), F.lit("").alias("source")
    )


def _text(node_sql: str) -> Column:
    """Trimmed text of a single element."""
    return trim_blanks(F.expr(f"transform(array({node_sql}), o -> {h.text_of('o')})[0]"))


def json_ld_texts() -> str:
    scripts = h.all_of("n.tag = 'script' AND n.attrs['type'] = 'application/ld+json'")
    return f"transform({scripts}, s -> {h.text_of('s')})"


def _first_json_ld() -> Column:
    return F.try_parse_json(F.get(F.expr(json_ld_texts()), F.lit(0)))


def with_json_ld(parsed: DataFrame) -> DataFrame:
    """Adds ``ld``, the page's first JSON-LD block, for the rules that look at it."""
    return parsed.withColumn("ld", _first_json_ld())


def description() -> Column:
    """Meta description, og:description, else the first paragraph of 51 to 499 characters."""
    m, og = F.expr(h.meta("description")), F.expr(h.meta("og:description", "property"))
    paragraphs = F.expr(f"transform({h.all_of(chr(110) + '.tag = ' + chr(39) + 'p' + chr(39))}, o -> {h.text_of('o')})")
    first = F.get(F.filter(F.transform(paragraphs, trim_blanks), lambda p: F.length(p).between(51, 499)), F.lit(0))
    return F.coalesce(
        _field(m, 0.8, "meta_description", F.length(m) > 20),
        _field(og, 0.7, "og_description", F.length(og) > 20),
        _field(first, 0.5, "first_paragraph", first.isNotNull()),
        _empty(),
    )


def emails(own_domains: list[str] | None = None) -> Column:
    """Mails of mailto links, then of the text; placeholders and the directory's own out."""
    links = F.expr(
        f"transform({h.all_of(chr(110) + '.tag = ' + chr(39) + 'a' + chr(39) + ' AND startswith(n.attrs[' + chr(39) + 'href' + chr(39) + '], ' + chr(39) + 'mailto:' + chr(39) + ')')}"
        r", a -> regexp_extract(a.attrs['href'], r'^mailto:([^\s?]+)', 1))"
    )
    found = F.array_distinct(
        F.concat(F.filter(links, lambda e: e != ""), F.regexp_extract_all(F.expr(h.body_text()), F.lit(f"({tx.MAIL_IN_TEXT})"), 1))
    )
    banned = ["placeholder", *(own_domains or [])]
    kept = F.filter(found, lambda e: ~e.rlike("|".join(b.replace(".", r"\.") for b in banned)) & (F.length(e) > 5))
    return F.coalesce(_field(kept, 0.8, "mailto_and_text", F.size(kept) > 0), _empty("array<string>"))


def phones() -> Column:
    """Phones of tel links, then phone-like runs of the text."""
    links = F.expr(
        "transform(filter(nodes, n -> n.tag = 'a' AND startswith(n.attrs['href'], 'tel:')), a -> trim(substring(a.attrs['href'], 5)))"
    )
    found = F.array_distinct(F.concat(F.filter(links, lambda p: p != ""), tx.phones_in(F.expr(h.body_text()))))
    return F.coalesce(_field(found, 0.7, "tel_and_pattern", F.size(found) > 0), _empty("array<string>"))


def social_links() -> Column:
    """platform -> first matching link."""
    hrefs = F.expr("transform(filter(nodes, n -> n.tag = 'a' AND n.attrs['href'] IS NOT NULL), a -> a.attrs['href'])")

    def first_of_platform(platform: str) -> Column:
        found = F.filter(F.transform(hrefs, lambda x: urls.social_url(x, platform)), lambda x: x.isNotNull())
        return F.struct(F.lit(platform).alias("key"), F.get(found, F.lit(0)).alias("value"))

    entries = [first_of_platform(p) for p, _ in fv.SOCIAL_PATTERNS]
    found = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    return F.coalesce(_field(found, 0.85, "social_links", F.size(found) > 0), _empty("map<string,string>"))


def _ld_text(path: str) -> Column:
    return F.try_variant_get(F.col("ld"), path, "string")


def address() -> Column:
    """Address element, JSON-LD, else the geo meta pair."""
    tag = _text(h.first_of("n.tag = 'address'"))
    ld = F.coalesce(_ld_text("$.address.streetAddress"), _ld_text("$.address.addressLocality"))
    place, region = F.expr(h.meta("geo.placename")), F.expr(h.meta("geo.region"))
    return F.coalesce(
        _field(tag, 0.9, "address_tag", F.length(tag) > 5),
        _field(ld, 0.85, "json_ld", ld != ""),
        _field(F.concat_ws(", ", place, F.when(region != "", region)), 0.7, "geo_meta", place != ""),
        _empty(),
    )


def company_name() -> Column:
    """JSON-LD name, og:site_name, first heading, else the title without its suffix."""
    ld = F.coalesce(*[F.when(_ld_text(p) != "", _ld_text(p)) for p in ("$.name", "$.legalName", "$.alternateName")])
    og = F.expr(h.meta("og:site_name", "property"))
    h1, title = _text(h.first_of("n.tag = 'h1'")), _text(h.first_of("n.tag = 'title'"))
    short = F.trim(F.regexp_replace(title, r"(?s)\s*[-|—–]\s*.*$", ""))
    return F.coalesce(
        _field(F.trim(ld), 0.95, "json_ld", F.length(ld) > 2),
        _field(og, 0.8, "og_site_name", F.length(og) > 2),
        _field(h1, 0.7, "h1", F.length(h1).between(3, 99)),
        _field(short, 0.5, "title_tag", F.length(title) > 2),
        _empty(),
    )


def logo() -> Column:
    """Logo: images in logo containers, JSON-LD, og:image, icons; the first of the best kind."""
    usable = "c IS NOT NULL AND trim(c) <> '' AND NOT startswith(trim(c), 'data:') AND NOT lower(c) RLIKE 'pixel|tracker|spacer|blank|1x1|analytics'"
    boxed = h.all_under("n.tag = 'img' AND n.attrs['src'] IS NOT NULL", f"{h.has_class('a', 'logo', 'site-logo')} OR a.id = 'logo'")
    images = f"transform({boxed}, o -> o.attrs['src'])"
    ld = "array(coalesce(try_variant_get(ld, '$.logo.url', 'string'), try_variant_get(ld, '$.logo', 'string'), try_variant_get(ld, '$.image', 'string')))"
    og = f"array({h.meta('og:image', 'property')})"
    icons = "transform(filter(nodes, n -> n.tag = 'link' AND n.attrs['rel'] IN ('apple-touch-icon', 'icon', 'shortcut icon')), o -> o.attrs['href'])"

    def absolute(conf: float, source: str):
        return lambda u: _field(u, conf, source, u.rlike("^(?i:https?)://"))

    out = []
    for sql, conf, source in ((images, 0.95, "dom_site_logo"), (ld, 0.9, "json_ld_logo"), (og, 0.55, "og_image"), (icons, 0.45, "favicon")):
        src = F.expr(f"get(filter({sql}, c -> {usable}), 0)")
        out.append(let(urls.resolve(src, F.col("url")), absolute(conf, source)))
    return F.coalesce(*out, _empty())


_SOCIAL_HOSTS = r"localhost|127\.0\.0\.1|facebook\.com|linkedin\.com|instagram\.com|twitter\.com|youtube\.com|tiktok\.com"


def website() -> Column:
    """Website: a link marked as such, canonical link, og:url; social hosts do not count."""
    marked = h.all_of(
        "n.tag = 'a' AND n.attrs['href'] IS NOT NULL AND "
        f"(lower({h.text_of('n')}) RLIKE 'website|homepage|visit site|official' OR contains(lower(coalesce(n.attrs['rel'], '')), 'external'))"
    )
    links = F.transform(F.expr(f"transform({marked}, o -> o.attrs['href'])"), lambda x: urls.resolve(x, F.col("url")))
    good = lambda u: u.rlike("^(?i:https?)://") & ~urls.host(u).rlike(_SOCIAL_HOSTS)
    link = F.get(F.filter(links, good), F.lit(0))
    canonical = urls.resolve(F.expr(f"{h.first_of('''n.tag = 'link' AND n.attrs['rel'] = 'canonical' ''')}.attrs['href']"), F.col("url"))
    og = urls.resolve(F.expr(h.meta("og:url", "property")), F.col("url"))
    return F.coalesce(
        let(link, lambda u: _field(u, 0.9, "anchor_website_text", u.isNotNull())),
        let(canonical, lambda u: _field(u, 0.7, "canonical_link", good(u))),
        let(og, lambda u: _field(u, 0.65, "og_url", good(u))),
        _empty(),
    )


def team() -> Column:
    """Names and roles inside member blocks."""
    blocks = h.all_of(h.has_class("n", "team-member", "team-member-name", "person", "leader", "executive", "board-member"))
    name = f"get(filter({h.within('k')}, m -> ({h.is_tag('m', 'h1', 'h2', 'h3', 'h4', 'h5')} OR {h.has_class('m', 'name', 'member-name')})), 0)"
    role = f"get(filter({h.within('k')}, m -> {h.has_class('m', 'role', 'title', 'position', 'designation')}), 0)"
    members = F.expr(
        f"""filter(transform({blocks}, k -> named_struct(
              'name', transform(array({name}), o -> {h.line_of('o')})[0],
              'role', transform(array({role}), o -> nullif({h.line_of('o')}, ''))[0])),
            m -> length(m.name) > 2 AND length(m.name) < 50)"""
    )
    return F.coalesce(
        _field(members, 0.6, "team_elements", F.size(members) > 0), _empty("array<struct<name:string,role:string>>")
    )


def page_fields(parsed: DataFrame, own_domains: list[str] | None = None, beside: Sequence[Column] = ()) -> DataFrame:
    """All fields of every page side by side; ``beside`` are further columns to find in the same pass."""
    return with_json_ld(parsed).select(
        "page_id", "url",
        description().alias("description"), emails(own_domains).alias("emails"), phones().alias("phones"),
        social_links().alias("socials"), address().alias("address"), company_name().alias("name"),
        logo().alias("logo"), website().alias("website"), team().alias("team"), *beside,
    )


def field_candidates(fields: DataFrame) -> DataFrame:
    """(page_id, field, value, confidence, source) rows of the fields that were found; lists and maps as JSON."""
    def entry(name: str) -> Column:
        value = F.col(f"{name}.value")
        text = value if name in ("description", "address", "name", "logo", "website") else F.to_json(value)
        return F.struct(
            F.lit(name).alias("field"), text.alias("value"), F.col(f"{name}.confidence").alias("confidence"),
            F.col(f"{name}.source").alias("source"),
        )

    names = ["name", "description", "website", "logo", "address", "emails", "phones", "socials", "team"]
    rows = fields.select("page_id", "url", F.explode(F.array(*[entry(n) for n in names])).alias("_f"))
    return rows.select("page_id", "url", "_f.*").where("value is not null and confidence > 0")


# --- structural data ------------------------------------------------------------------------------------


def json_ld_items(parsed: DataFrame) -> DataFrame:
    """(page_id, url, block, pos, item): every JSON-LD object, arrays and @graph opened."""
    blocks = parsed.select("page_id", "url", F.posexplode(F.expr(json_ld_texts())).alias("block", "_raw"))
    doc = blocks.withColumn("_doc", F.try_parse_json("_raw")).where("_doc is not null")
    whole = F.try_variant_get("_doc", "$", "array<variant>")
    graph = F.try_variant_get("_doc", "$['@graph']", "array<variant>")
    items = F.coalesce(whole, graph, F.array("_doc"))
    return doc.select("page_id", "url", "block", F.posexplode(items).alias("pos", "item"))


_ORG = "(?i)Organization|Corporation|LocalBusiness|Store|Place"


def harvested(parsed: DataFrame) -> DataFrame:
    """One row per page with what JSON-LD and meta elements say; the first block to name a field wins."""
    g = lambda path: F.try_variant_get("item", path, "string")
    many = lambda path: F.coalesce(F.try_variant_get("item", path, "array<string>"), F.array_compact(F.array(g(path))))
    kind = F.coalesce(F.array_join(F.try_variant_get("item", "$['@type']", "array<string>"), ","), g("$['@type']"))
    same_as = many("$.sameAs")
    items = json_ld_items(parsed).select(
        "page_id", F.struct("block", "pos").alias("o"),
        F.when(kind.rlike(_ORG), kind).alias("kind"),
        *[F.when(g(f"$.{p}") != "", g(f"$.{p}")).alias(n) for n, p in (
            ("name", "name"), ("legal_name", "legalName"), ("description", "description"), ("site", "url"), ("tax_id", "taxID"),
        )],
        F.coalesce(g("$.logo.url"), g("$.logo")).alias("logo"),
        F.when(g("$.id").rlike(r"^\d{10}$"), g("$.id")).alias("cr_number"),
        F.coalesce(g("$.address.streetAddress")).alias("street"), g("$.address.addressLocality").alias("city"),
        g("$.address.addressRegion").alias("region"), g("$.address.postalCode").alias("postal_code"),
        F.coalesce(g("$.address.addressCountry.name"), g("$.address.addressCountry")).alias("country"),
        F.when(F.schema_of_variant(F.try_variant_get("item", "$.address", "variant")) == "STRING", g("$.address")).alias("full_address"),
        many("$.telephone").alias("phones"), many("$.email").alias("emails"),
        F.try_element_at(F.filter(same_as, lambda u: u.contains("linkedin.com")), F.lit(-1)).alias("linkedin"),
        F.try_element_at(F.filter(same_as, lambda u: u.contains("twitter.com") | u.contains("x.com")), F.lit(-1)).alias("twitter"),
        F.try_element_at(F.filter(same_as, lambda u: u.contains("facebook.com")), F.lit(-1)).alias("facebook"),
        F.try_element_at(F.filter(same_as, lambda u: u.contains("instagram.com")), F.lit(-1)).alias("instagram"),
    )
    first = lambda n: F.min_by(n, F.when(F.col(n).isNotNull(), F.col("o"))).alias(n)
    last = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col("o"))).alias(n)
    # grouped by page: as many rows as one page has JSON-LD objects
    per_page = items.groupBy("page_id").agg(
        *[first(n) for n in ("name", "legal_name", "description", "site", "tax_id", "logo")],
        *[last(n) for n in ("cr_number", "street", "city", "region", "postal_code", "country", "full_address",
                            "linkedin", "twitter", "facebook", "instagram")],
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "phones"))), lambda x: x["phones"]))).alias("phones"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o", "emails"))), lambda x: x["emails"]))).alias("emails"),
        F.array_distinct(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("o", "kind"))), lambda x: x["kind"]))).alias("found_in"),
    )
    metas = parsed.select(
        "page_id", "url",
        F.expr(h.meta("og:site_name", "property")).alias("_name"),
        F.expr(
            "get(filter(nodes, n -> n.tag = 'meta' AND (n.attrs['name'] = 'description' OR n.attrs['property'] = 'og:description') AND n.attrs['content'] <> ''), 0)"
        )["attrs"]["content"].alias("_description"),
        F.expr(h.meta("og:url", "property")).alias("_site"), F.expr(h.meta("og:image", "property")).alias("_logo"),
        F.expr(h.meta("geo.placename")).alias("_place"),
    )
    out = metas.join(per_page, "page_id", "left")
    return out.select(
        "page_id", "url", F.coalesce("name", "_name").alias("name"), "legal_name",
        F.coalesce("description", "_description").alias("description"), F.coalesce("site", "_site").alias("site"),
        F.coalesce("logo", "_logo").alias("logo"), "street", "city", "region", "postal_code", "country",
        F.when(F.coalesce("full_address", "_place").isNotNull(), F.concat_ws(", ", "full_address", "_place")).alias("full_address"),
        "phones", "emails", "linkedin", "twitter", "facebook", "instagram", "tax_id", "cr_number", "found_in",
    )


# --- visuals ------------------------------------------------------------------------------------------------


def _is_company_image(u: Column, base: Column) -> Column:
    """An image that may be the company's own: no social hosts, no generic assets, no icons and buttons."""
    words = "|".join(fv.EXCLUDED_IMAGE_WORDS)
    no_icon = "|".join(w for w in fv.EXCLUDED_IMAGE_WORDS if w != "icon")

    def good(p: Column) -> Column:
        host, low, path = p["host"], p["low"], p["path"]
        generic = path.rlike("|".join(fv.GENERIC_ASSET_PATHS)) & (host == urls.host(base))
        generic_bad = generic & (~path.contains("logo") | path.rlike("|".join(fv.DIRECTORY_WORDS)))
        word_bad = low.rlike(words) & ~low.contains("logo") & low.rlike(no_icon)
        banned_host = host.rlike("|".join(x.replace(".", r"\.") for x in fv.EXCLUDED_IMAGE_HOSTS))
        return F.coalesce(u.rlike("^(?i:https?)://") & ~banned_host & ~generic_bad & ~word_bad, F.lit(False))

    # inside a lambda Spark works out a repeated expression anew each time, so the parts are named once
    return let(F.struct(urls.host(u).alias("host"), F.lower(u).alias("low"), F.lower(urls.path(u)).alias("path")), good)


def visuals() -> Column:
    """struct(logo, banner, confidence): ranked places, exclusion lists, banner unlike the logo."""
    src = lambda cond: f"transform({h.all_of(cond)}, o -> o.attrs['src'])"
    first = lambda cond: f"slice({src(cond)}, 1, 1)"
    part = lambda a: f"n.tag = 'img' AND contains(lower(n.attrs['{a}']), 'logo')"
    logo_sql = "concat(" + ", ".join(
        [
            f"array(coalesce({h.meta('og:image', 'property')}, {h.meta('twitter:image')}, {h.meta('og:image:secure_url', 'property')}))",
            "slice(transform(filter(nodes, n -> n.tag = 'link' AND (n.attrs['rel'] IN ('apple-touch-icon', 'shortcut icon') OR (n.attrs['rel'] = 'icon' AND n.attrs['sizes'] IN ('192x192', '512x512')))), o -> o.attrs['href']), 1, 1)",
            *[first(part(a)) for a in ("src", "id", "class", "alt")],
            *[first("n.tag = 'img' AND " + h.under(c)) for c in (
                h.has_class("a", "navbar-brand"), h.has_class("a", "header-logo"), "a.tag = 'header'", h.has_class("a", "logo"))],
        ]
    ) + ")"
    banner_sql = "concat(" + ", ".join(
        [
            *[first("n.tag = 'img' AND " + h.under(c)) for c in (
                h.has_class("a", "hero"), h.has_class("a", "banner"), h.has_class("a", "main-banner"), h.has_class("a", "slider"),
                "a.id = 'hero-banner'", "a.tag = 'main'", "a.tag = 'section'")],
            r"slice(transform(filter(nodes, n -> n.tag = 'div' AND contains(n.attrs['style'], 'background-image')), o -> regexp_extract(o.attrs['style'], r'url\([\x22\x27]?([^\x22\x27)]+)', 1)), 1, 1)",
        ]
    ) + ")"
    base = F.col("url")

    def usable(sql: str) -> Column:
        full = F.transform(
            F.filter(F.expr(sql), lambda c: (c != "") & ~c.startswith("data:")), lambda c: urls.resolve(c, base)
        )
        return F.filter(full, lambda u: _is_company_image(u, base))

    conf = (
        F.when(F.expr("exists(nodes, n -> n.tag = 'meta' AND (n.attrs['property'] = 'og:image' OR n.attrs['name'] = 'twitter:image'))"), 0.9)
        .when(F.expr("exists(nodes, n -> n.tag = 'link' AND n.attrs['rel'] IN ('apple-touch-icon', 'icon'))"), 0.8)
        .otherwise(0.5)
    )
    def chosen(logo_url: Column) -> Column:
        banners = F.filter(usable(banner_sql), lambda u: ~u.eqNullSafe(logo_url))
        return F.struct(logo_url.alias("logo"), F.get(banners, F.lit(0)).alias("banner"), conf.alias("confidence"))

    return let(F.get(usable(logo_sql), F.lit(0)), chosen)


# --- links ----------------------------------------------------------------------------------------------------


def links(parsed: DataFrame) -> DataFrame:
    """(page_id, seq, href, target): every link with its absolute address."""
    rows = parsed.select("page_id", "url", F.explode(F.expr("filter(nodes, n -> n.tag = 'a' AND n.attrs['href'] IS NOT NULL)")).alias("n"))
    return rows.select(
        "page_id", F.col("n.seq").alias("seq"), F.col("n.attrs")["href"].alias("href"),
        urls.resolve(F.col("n.attrs")["href"], F.col("url")).alias("target"),
    )


def next_pages(parsed: DataFrame) -> DataFrame:
    """(page_id, target): distinct pagination links by element rules and by the shape of the address."""
    boxed = h.under(h.has_class("a", "pagination", "pager", "page-numbers", "next-page"))
    rule = (
        f"n.tag = 'a' AND n.attrs['href'] IS NOT NULL AND ({boxed} OR n.attrs['rel'] = 'next' OR "
        r"n.attrs['href'] RLIKE r'(?i)PageFirstRow=\d+|[?&](page|p|offset)=\d+|page[=/]?\d+$|/p/\d+$')"
    )
    rows = parsed.select("page_id", "url", F.explode(F.expr(f"transform({h.all_of(rule)}, o -> o.attrs['href'])")).alias("href"))
    return rows.select("page_id", urls.resolve(F.col("href"), F.col("url")).alias("target")).distinct()


def numbered_pages(parsed: DataFrame, pattern: str, parameter: str = "page", most: int | None = None) -> DataFrame:
    """(page_id, page_no, target): the pages 2 to n of a listing that states how many it has.

    ``most`` is the listing's own limit of pages, if it has one.
    """
    total = F.regexp_extract("text", pattern, 1).try_cast("int")
    base = F.regexp_replace("url", rf"([?&]){parameter}=\d+&?", "$1")
    glue = F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?"))
    rows = parsed.select("page_id", base.alias("_base"), glue.alias("_glue"), total.alias("_total")).where("_total >= 2")
    rows = rows.withColumn("page_no", F.explode(F.sequence(F.lit(2), F.col("_total") if most is None else F.least("_total", F.lit(most)))))
    return rows.select(
        "page_id", "page_no",
        F.concat(F.regexp_replace("_base", "[?&]$", ""), F.when(F.regexp_replace("_base", "[?&]$", "").contains("?"), "&").otherwise("?"),
                 F.lit(f"{parameter}="), F.col("page_no").cast("string")).alias("target"),
    )


def profile_links(parsed: DataFrame) -> DataFrame:
    """Links to pages of the same host one segment deep: profiles of a directory."""
    segments = F.filter(F.split(urls.path(F.col("target")), "/"), lambda s: s != "")
    own = parsed.select("page_id", urls.host(F.col("url")).alias("_host"))
    return links(parsed).join(own, "page_id").where((F.size(segments) == 1) & (urls.host(F.col("target")) == F.col("_host"))).select(
        "page_id", "target"
    ).distinct()


# --- merging pages into records ------------------------------------------------------------------------------------


def fill_single_records(records: DataFrame, fields: DataFrame) -> DataFrame:
    """Page values fill gaps of a record only where the page gave exactly one record."""
    single = records.groupBy("page_id").agg(F.count("*").alias("_n")).where("_n = 1").select("page_id")
    return _fill_gaps(records, _page_values(fields.join(single, "page_id", "left_semi"), "page_id"), "page_id")


def fill_from_details(records: DataFrame, fields: DataFrame, pattern: str = fv.DETAIL_PAGE) -> DataFrame:
    """Listing records take what they lack from their own detail page, found by the canonical form of ``source_url``.

    A detail page speaks of one company, so its page-level values are safe.  Of
    several fetched copies the one with the smallest page_id counts.  Records that
    point to no detail page are passed by without a shuffle.
    """
    is_detail = F.coalesce(F.col("source_url").rlike(pattern), F.lit(False))
    page = _page_values(fields.withColumn("_at", urls.canonical_url(F.col("url"))).where("_at is not null"), "_at", "page_id")
    page = page.withColumn("_website", F.coalesce(urls.canonical_url(F.col("_website")), "_website")).drop("_logo")
    first = checkpointed(top_per_key(page, ["_at"], ["page_id"]).drop("page_id"))  # written, so that a hot address can be split
    filled = _fill_gaps(records.where(is_detail).withColumn("_at", urls.canonical_url(F.col("source_url"))), first, "_at")
    return filled.drop("_at").unionByName(records.where(~is_detail))


def _page_values(fields: DataFrame, *keys: str) -> DataFrame:
    """The values of a page that can fill a record, narrow, with their confidences as a map."""
    return fields.select(
        *keys, F.col("description.value").alias("_description"), F.get("emails.value", F.lit(0)).alias("_email"),
        F.get("phones.value", F.lit(0)).alias("_phone"), F.col("website.value").alias("_website"),
        F.col("logo.value").alias("_logo"), F.col("address.value").alias("_address"),
        F.map_filter(
            F.create_map(
                F.lit("description_en"), F.col("description.confidence"), F.lit("email"), F.col("emails.confidence"),
                F.lit("phone"), F.col("phones.confidence"), F.lit("website_url"), F.col("website.confidence"),
                F.lit("logo_url"), F.col("logo.confidence"), F.lit("full_address"), F.col("address.confidence"),
            ),
            lambda k, x: x > 0,
        ).alias("_conf"),
    )


def _fill_gaps(records: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """Empty fields of the records take the page's value and its confidence."""
    pairs = {
        "description_en": "_description", "email": "_email", "phone": "_phone", "website_url": "_website",
        "logo_url": "_logo", "full_address": "_address",
    }
    have = [c for c in pairs if c in records.columns and pairs[c] in page.columns]
    taken = {c: (F.col(c).isNull() | (F.col(c) == "")) & F.col(pairs[c]).isNotNull() for c in have}
    # a projection of its own: a lambda beside a redefined column would see the new value
    out = records.join(page, key, "left").withColumn(
        "_used", F.array_compact(F.array(*[F.when(taken[c], F.lit(c)) for c in have]))
    )
    if "field_confidence" in records.columns:
        extra = F.map_filter("_conf", lambda k, x: F.array_contains("_used", k))
        kept = F.map_filter("field_confidence", lambda k, x: ~F.array_contains("_used", k))
        out = out.withColumn(
            "field_confidence", F.when(F.col("_conf").isNotNull(), F.map_concat(kept, extra)).otherwise(F.col("field_confidence"))
        )
    filled = {c: F.when(taken[c], F.col(pairs[c])).otherwise(F.col(c)) for c in have}
    return out.withColumns(filled).select(*records.columns)


def apply_baseline(records: DataFrame, baseline: DataFrame) -> DataFrame:
    """Structural data of the page beats the extracted name, and fills a short description, phone and registry number."""
    b = baseline.select(
        "page_id", F.coalesce("name", "legal_name").alias("_name"), F.col("description").alias("_description"),
        F.get("phones", F.lit(0)).alias("_phone"), F.col("cr_number").alias("_cr"),
    )
    out = records.join(b, "page_id", "left")
    short = F.coalesce(F.length("description_en"), F.lit(0)) < 50
    return out.withColumns(
        {
            "name_en": F.coalesce("_name", "name_en"),
            "description_en": F.when(short, F.coalesce("_description", "description_en")).otherwise(F.col("description_en")),
            "phone": F.coalesce(F.when(F.col("phone") != "", F.col("phone")), "_phone"),
            "cr_number": F.coalesce("cr_number", "_cr"),
        }
    ).select(*records.columns)
