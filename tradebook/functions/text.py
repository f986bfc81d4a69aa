"""Names, phones, mails, cities, slugs and cleaning of free text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.functions import fixed_values as fv
from tradebook.functions.semantics import collapse_blanks, first_truthy, squeeze, trim_blanks

MAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
MAIL_IN_TEXT = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


# --- names -----------------------------------------------------------------------------------


def company_name(name: Column) -> Column:
    """Legal suffixes off the end, once each in their fixed order; blanks collapsed; marks dropped."""
    out = trim_blanks(F.coalesce(name, F.lit("")))
    for suffix in fv.LEGAL_SUFFIXES:
        out = F.regexp_replace(out, r"(?iu)\s+" + suffix.replace(".", r"\.") + "$", "")
    return F.regexp_replace(squeeze(out), "[™®©]", "")


def clean_text(text: Column) -> Column:
    """One line, zero-width characters and marks out."""
    out = collapse_blanks(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[\u200b-\u200d\ufeff]", ""), "[™®©]", ""))


def display_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(collapse_blanks(name), "[™®©]", ""))


def junk_to_null(text: Column) -> Column:
    """Null for placeholder words, else the cleaned text."""
    return F.when(~trim_blanks(text).isin(*fv.JUNK_VALUES), clean_text(text))


def match_key(name: Column) -> Column:
    """Lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")


def unicode_name_key(name: Column, source_suffix: str | None = None) -> Column:
    """Lower-case key of letters, digits, blanks, dots and dashes of any script."""
    out = F.lower(trim_blanks(F.coalesce(name, F.lit(""))))
    if source_suffix:
        out = F.regexp_replace(out, r"(?i)\s*\|\s*" + source_suffix.replace(" ", r"\s+") + r"\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}\s.-]+", " "), r"\s+", " "))


def strict_name_key(name: Column, source_suffix: str | None = None) -> Column:
    return F.regexp_replace(unicode_name_key(name, source_suffix), r"[\s.-]+", "")


def short_name_key(name: Column) -> Column:
    """Key with three long words shortened, each at its first occurrence only."""
    out = F.regexp_replace(F.lower(F.trim(name)), r"[^\w\s]", "")
    out = F.regexp_replace(out, r"\s+", " ")
    for long, short in (("limited", "ltd"), ("company", "co"), ("industrial", "ind")):
        out = F.regexp_replace(out, f"^(.*?){long}", f"$1{short}")
    return F.trim(out)


def brand_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", " "))


def bare_name(name: Column) -> Column:
    """Lower-case name without legal words, as compared by the duplicate rules."""
    words = "|".join(fv.LEGAL_WORDS)
    return squeeze(F.regexp_replace(F.lower(name), rf"\b({words})\b\.?", ""))


def split_title(title: Column) -> Column:
    """struct(name_en, name_ar) of an 'Arabic name (English name)' heading."""
    t = squeeze(title)
    left = F.trim(F.regexp_extract(t, r"^(.*?)\s*\((.*?)\)\s*$", 1))
    inside = F.trim(F.regexp_extract(t, r"^(.*?)\s*\((.*?)\)\s*$", 2))
    english = inside.rlike("[A-Za-z]")
    arabic_left = left.rlike(r"[\u0600-\u06ff]") & ~left.rlike("[A-Za-z]")
    return F.struct(
        F.when(english, inside).otherwise(t).alias("name_en"), F.when(english & arabic_left, left).alias("name_ar")
    )


def is_mostly_arabic(text: Column) -> Column:
    arabic = F.length(F.regexp_replace(text, r"[^\u0600-\u06ff]", ""))
    return F.coalesce((F.length(text) > 0) & (arabic / F.length(text) > 0.3), F.lit(False))


def script_share(text: Column, char_class: str) -> Column:
    """Share of characters of one class."""
    hits = F.length(F.regexp_replace(text, f"[^{char_class}]", ""))
    return F.when(F.length(text) > 0, hits / F.length(text)).otherwise(0.0)


def has_latin(text: Column) -> Column:
    return text.rlike("[a-zA-Z]")


def needs_shorter_name(name: Column, limit: int = 60) -> Column:
    """Names that read like a sentence rather than a name."""
    low = F.lower(name)
    return (F.length(name) > limit) | low.contains(" a ") | low.contains(" manufacturer ")


def is_corrupt_name(name: Column) -> Column:
    """A mail address, a leading ISO date or a bare number where a name should be."""
    number = r"^\s*-?(\d+\.?\d*|\.\d+)([eE]\d+)?\s*$"
    return (
        (name.contains("@") & ~name.contains(" "))
        | name.rlike(r"^\d{4}-\d{2}-\d{2}")
        | F.replace(name, F.lit("+"), F.lit("")).rlike(number)
    )


# --- phones, mails, places ---------------------------------------------------------------------


def phone_number(phone: Column, country: str = fv.COUNTRY_CODE) -> Column:
    """struct(formatted, confidence): international form of a phone, or null and 0."""
    c = F.regexp_replace(phone, r"[^\d+]", "")
    plus = F.concat(F.lit("+" + country), F.lit(""))
    full = (
        F.when(c.startswith("05"), F.concat(plus, F.substr(c, F.lit(2))))
        .when(c.startswith("5") & (F.length(c) == 9), F.concat(plus, c))
        .when(c.startswith("01") & (F.length(c) >= 10), F.concat(plus, F.substr(c, F.lit(2))))
        .when(c.startswith("1") & (F.length(c) == 9), F.concat(plus, c))
        .when(c.startswith("+" + country), c)
        .when(c.startswith(country), F.concat(F.lit("+"), c))
        .when(F.length(c).between(7, 15), F.when(c.startswith("+"), c).otherwise(F.concat(F.lit("+"), c)))
    )
    good = F.coalesce(full.rlike(r"^\+\d{7,15}$"), F.lit(False))
    return F.struct(F.when(good, full).alias("formatted"), F.when(good, 0.8).otherwise(0.0).alias("confidence"))


def phone_digits(phone: Column) -> Column:
    """Phone without blanks, dashes, brackets, plus and dots."""
    return F.regexp_replace(phone, r"[\s\-()+.]", "")


def first_phone(text: Column) -> Column:
    """First run of a free text that is a phone of 7 to 15 digits, with a leading plus."""
    runs = F.regexp_extract_all(squeeze(text), F.lit(r"(\+?\d[\d\s\-()]{6,30})"), 1)
    tail_parts = F.transform(
        F.filter(F.split(squeeze(text), r"\+"), lambda p: F.trim(p) != ""), lambda p: F.concat(F.lit("+"), F.trim(p))
    )
    marked = F.transform(
        F.concat(runs, tail_parts), lambda r: F.regexp_replace(F.regexp_replace(r, r"[^\d+]", ""), "^00", "+")
    )
    good = F.filter(marked, lambda d: F.length(F.replace(d, F.lit("+"), F.lit(""))).between(7, 15))
    hit = F.get(good, F.lit(0))
    return F.when(hit.startswith("+"), hit).otherwise(F.concat(F.lit("+"), hit))


def email_address(email: Column) -> Column:
    """struct(formatted, is_valid)."""
    c = F.lower(trim_blanks(email))
    good = F.coalesce(c.rlike(MAIL_SHAPE), F.lit(False))
    return F.struct(F.when(good, c).alias("formatted"), good.alias("is_valid"))


def emails_in(text: Column) -> Column:
    """Distinct mail addresses of a text in order, placeholders out."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({MAIL_IN_TEXT})"), 1))
    return F.filter(found, lambda e: ~e.contains("placeholder") & (F.length(e) > 5))


def phones_in(text: Column) -> Column:
    """Distinct phone-like runs of a text: international ones first, then local ones."""
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"(\+[\d\s\-()]{7,20})"), 1),
        F.regexp_extract_all(text, F.lit(r"([\d\s\-()]{7,15})"), 1),
    )
    trimmed = F.transform(found, lambda p: trim_blanks(p))
    return F.array_distinct(
        F.filter(trimmed, lambda p: F.regexp_replace(p, r"[\s\-()]", "").rlike(r"^(\+\d{6,14}|\d{7,15})$"))
    )


def city_name(city: Column) -> Column:
    """struct(normalized, confidence): first known spelling inside the text, else the text itself."""
    c = F.lower(trim_blanks(city))
    known = None
    for spelling, name in fv.CITY_SPELLINGS:
        known = F.when(c.contains(spelling), name) if known is None else known.when(c.contains(spelling), name)
    keep = F.length(c).between(2, 49)
    return F.struct(
        F.coalesce(known, F.when(keep, trim_blanks(city))).alias("normalized"),
        F.when(known.isNotNull(), 0.9).when(keep, 0.3).otherwise(0.0).alias("confidence"),
    )


def city_in(text: Column, words: list[str] = fv.CITY_WORDS) -> Column:
    """First known city that occurs in an address."""
    out = F.when(text.contains(words[0]), words[0])
    for w in words[1:]:
        out = out.when(text.contains(w), w)
    return out


def country_name(country: Column) -> Column:
    """struct(normalized, is_home).  The two-letter spelling matches inside longer words; kept so."""
    c = F.lower(trim_blanks(country))
    home = F.lit(False)
    for s in fv.COUNTRY_SPELLINGS:
        home = home | c.contains(s)
    return F.struct(
        F.when(home, fv.COUNTRY_NAME).otherwise(trim_blanks(country)).alias("normalized"),
        F.coalesce(home, F.lit(False)).alias("is_home"),
    )


def normalize_record(df: DataFrame) -> DataFrame:
    """Junk out of every string column, then the field rules for the columns that are there."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = df.withColumns({c: junk_to_null(F.col(c)) for c in strings})
    rules = {
        "name_en": lambda c: F.when(c.isNotNull(), company_name(c)),
        "name_ar": lambda c: F.when(c.isNotNull(), company_name(c)),
        "phone": lambda c: F.coalesce(phone_number(c)["formatted"], c),
        "email": lambda c: F.coalesce(email_address(c)["formatted"], c),
        "city": lambda c: F.coalesce(city_name(c)["normalized"], c),
        "country": lambda c: country_name(c)["normalized"],
    }
    return out.withColumns({n: rule(F.col(n)) for n, rule in rules.items() if n in strings})


# --- slugs and paths -----------------------------------------------------------------------------


def latin_slug(name: Column) -> Column:
    out = F.regexp_replace(F.lower(F.trim(name)), r"\s+", "-")
    out = F.regexp_replace(out, "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-|-$", "")


def url_slug(name: Column) -> Column:
    """Slug of the public path: other characters dropped first, then blanks to dashes."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"[^a-zA-Z0-9\s-]", ""), r"\s+", "-"))


def arabic_slug(name: Column) -> Column:
    """Slug that keeps Arabic letters."""
    out = F.regexp_replace(F.lower(name), r"[^a-z0-9\u0600-\u06ff]+", "-")
    return F.regexp_replace(out, "^-+|-+$", "")


def dotted_slug(name: Column) -> Column:
    """Arabic-keeping slug of the sanitising run: dots inside stay, at the end they go."""
    out = F.regexp_replace(F.lower(trim_blanks(name)), r"\s+", "-")
    out = F.regexp_replace(out, r"[^\w\u0621-\u064a.-]+", "")
    out = F.regexp_replace(F.regexp_replace(out, "--+", "-"), "^-+|-+$", "")
    return F.regexp_replace(out, r"\.+$", "")


def keyword_slug(name: Column) -> Column:
    """First five words that are no stop words; the first two words when nothing else is left."""
    words = F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", " "), r"\s+")
    keep = F.filter(words, lambda w: (w != "") & ~w.isin(*fv.SLUG_STOP_WORDS))
    return F.array_join(F.when(F.size(keep) > 0, F.slice(keep, 1, 5)).otherwise(F.slice(words, 1, 2)), "-")


def title_case(dashed: Column) -> Column:
    return F.initcap(F.replace(dashed, F.lit("-"), F.lit(" ")))


def language_of_path(path: Column, default: str = "en") -> Column:
    hit = F.regexp_extract(path, "^/(en|ar)(/|$)", 1)
    return F.when(hit != "", hit).otherwise(default)


def localized_path(path: Column, language: Column) -> Column:
    lang = F.when(language.isin("en", "ar"), language).otherwise("en")
    return F.concat(F.lit("/"), lang, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))


def company_path(company_id: Column, slug: Column, language: Column) -> Column:
    return localized_path(F.concat_ws("/", F.lit("/company"), company_id.cast("string"), slug), language)


def category_path(slug: Column, language: Column) -> Column:
    return localized_path(F.concat(F.lit("/category/"), slug), language)


def location_path(slug: Column) -> Column:
    return F.concat(F.lit("/location/"), slug)


def public_company_path(public_id: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("/company"), public_id.cast("string"), url_slug(name))


def swap_language(path: Column, language: str) -> Column:
    """The same page in the other language; paths that take no prefix stay as they are."""
    takes_prefix = F.lit(False)
    for root in fv.PREFIXABLE_ROOTS:
        takes_prefix = takes_prefix | path.startswith(root)
    return (
        F.when(path.isNull() | path.isin("", "/"), f"/{language}")
        .when(path.rlike("^/(en|ar)(/.*)?$"), F.regexp_replace(path, "^/(en|ar)", f"/{language}"))
        .when(takes_prefix, F.concat(F.lit(f"/{language}"), path))
        .otherwise(path)
    )


# --- cleaning cells --------------------------------------------------------------------------------


def strip_scripts(text: Column) -> Column:
    """Script and frame blocks, script schemes and two event attributes out of a text."""
    out = text
    for pattern in (
        r"(?i)<script\b[^<]*(?:(?!</script>)<[^<]*)*</script>",
        r"(?i)<iframe\b[^<]*(?:(?!</iframe>)<[^<]*)*</iframe>",
        r"(?i)javascript:", r"(?i)vbscript:", r"(?i)onload=", r"(?i)onerror=",
    ):
        out = F.regexp_replace(out, pattern, "")
    return trim_blanks(out)


def safe_url(url: Column) -> Column:
    return F.when(
        url != "", strip_scripts(F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url)))
    ).otherwise(url)


def truncated(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...[truncated]"))).otherwise(text)


def lenient_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def cell_to_text(cell: Column) -> Column:
    """Garbage cells become null."""
    return F.when(~trim_blanks(cell).isin(*fv.GARBAGE_CELLS), cell)


def cell_to_array(cell: Column) -> Column:
    """Array of a cell that holds JSON, a comma list, garbage or nothing."""
    v = trim_blanks(F.coalesce(cell, F.lit("")))
    listed = F.filter(F.split(v, r"\s*,\s*"), lambda x: x != "")
    parsed = F.when(v.startswith("[") & v.endswith("]"), F.from_json(v, "array<string>"))
    return F.when(v.isin(*fv.GARBAGE_CELLS), F.array().cast("array<string>")).otherwise(F.coalesce(parsed, listed))


def clean_items(items: Column) -> Column:
    """Trimmed, non-empty elements; null becomes an empty array."""
    return F.coalesce(
        F.filter(F.transform(items, trim_blanks), lambda x: x != ""), F.array().cast("array<string>")
    )


def union_keep_order(*arrays: Column) -> Column:
    """Distinct union in first-seen order; null arrays count as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays]))


# --- text pieces --------------------------------------------------------------------------------------


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens of three and more letters over the smaller set."""

    def tokens(c: Column) -> Column:
        words = F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\u0600-\u06ff\s]", " "), r"\s+")
        return F.array_distinct(F.filter(words, lambda t: F.length(t) >= 3))

    ta, tb = tokens(a), tokens(b)
    smaller = F.least(F.size(ta), F.size(tb))
    return F.when(smaller > 0, F.size(F.array_intersect(ta, tb)) / smaller).otherwise(0.0)


def labelled_line(text: Column, label: str) -> Column:
    """Value of the first 'Label: value' line; a dash counts as nothing."""
    v = F.trim(F.regexp_extract(text, rf"(?mi)^[ \t]*{label}[ \t]*:[ \t]*(.+?)[ \t]*$", 1))
    return F.when(~v.isin("", "—", "-"), v)


def bullet_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"^\s*-"))


def heading_sections(text: Column) -> Column:
    """array<struct(name, block)> of the '### name' sections of a text."""
    pattern = r"(?:^|\n)[ \t]*###[ \t]+([^\n]+?)[ \t]*\n([\s\S]*?)(?=\n[ \t]*###[ \t]+|\z)"
    names = F.regexp_extract_all(text, F.lit(pattern), 1)
    blocks = F.regexp_extract_all(text, F.lit(pattern), 2)
    return F.transform(names, lambda n, i: F.struct(F.trim(n).alias("name"), F.get(blocks, i).alias("block")))


def products_in_sentence(text: Column, limit: int | None = None) -> Column:
    """Items listed after 'namely', 'such as', 'including' or 'like', up to the sentence end; ``limit`` keeps the first ones."""
    t = squeeze(text)
    tail = None
    for m in fv.PRODUCT_MARKERS:
        hit = F.locate(f"{m} ", F.lower(t))
        piece = F.substr(t, hit + F.lit(len(m) + 1))
        tail = F.when(hit > 0, piece) if tail is None else tail.when(hit > 0, piece)
    items = F.transform(
        F.split(F.regexp_extract(tail, r"^([^.;…]*)", 1), ","),
        lambda s: F.trim(F.regexp_replace(F.regexp_replace(squeeze(s), r"^[\-•*]+\s*", ""), "[|/]+", " ")),
    )
    junk = lambda s: (
        ~F.length(s).between(2, 80)
        | s.rlike(r"(?i)^(call now|send mail|share|claim this business|open in google maps)$")
        | s.rlike(r"(?i)^(https?://|www\.)")
        | F.regexp_replace(s, r"\s", "").rlike(r"^\+?\d{7,15}$")
        | s.contains("@")
    )
    return F.coalesce(
        F.array_distinct(F.filter(items, lambda s: ~junk(s)) if limit is None else F.slice(F.filter(items, lambda s: ~junk(s)), 1, limit)), F.array().cast("array<string>")
    )


def decode_hex_mail(payload: Column) -> Column:
    """Mail behind a hex payload whose first byte masks the rest; null unless it looks like a mail."""
    h = F.regexp_replace(F.trim(payload), "^#", "")
    ok = h.rlike("^[0-9a-fA-F]{4,}$") & (F.length(h) % 2 == 0)
    byte = lambda pos: F.conv(F.substring(h, pos, F.lit(2)), 16, 10).cast("int")
    chars = F.transform(
        F.sequence(F.lit(3), F.greatest(F.length(h) - 1, F.lit(3)), F.lit(2)),
        lambda p: F.char(byte(p).bitwiseXOR(byte(F.lit(1)))),
    )
    mail = F.array_join(chars, "")
    return F.when(ok, F.when(mail.rlike(MAIL_SHAPE), mail))


def name_or(fallback: Column, *names: Column) -> Column:
    """First non-empty name, else the fallback."""
    return F.coalesce(first_truthy(*names), fallback)


def lenient_json(text: Column) -> Column:
    """VARIANT of a text that is JSON as a whole or holds one JSON block; null otherwise."""
    block = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.try_parse_json(text), F.when(block != "", F.try_parse_json(block)))
