"""Queries over texts and names: cleaning, keys, phones, mails, cities, slugs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.functions import fixed_values as fv
from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.functions.semantics import squeeze
from tradebook.operators.keys import numbered, top_per_key
from tradebook.operators.slugs import slug_or_id_tail, slugs_against_stored, unique_slugs
from tradebook.plans import views as v
from tradebook.plans.registry import query, table

_WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_CLEAN = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '{_WS}', ' ', 'g'), '[\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g'), '[™®©]', '', 'g'))"


@query("clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    """Whole document texts on one line, without invisible characters and marks."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


_CELL = "CASE c_custkey % 7 WHEN 0 THEN ' N/A ' WHEN 1 THEN '-' WHEN 2 THEN 'TBD' WHEN 3 THEN '  ' || c_name || '  ' WHEN 4 THEN 'null' ELSE c_mktsegment || '™ ' END"
_JUNK = ", ".join(f"'{j}'" for j in fv.JUNK_VALUES)


@query(
    "junk_to_null",
    f"""WITH c AS (SELECT c_custkey, {_CELL} AS cell FROM customer)
SELECT c_custkey, CASE WHEN trim(cell) IN ({_JUNK}) THEN NULL ELSE trim(replace(cell, '™', '')) END AS cell FROM c""",
)
def junk_to_null(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_CELL.replace("||", "||")).alias("cell"))
    return c.select("c_custkey", tx.junk_to_null(F.col("cell")).alias("cell"))


_RAW_NAME = "p_name || CASE p_partkey % 6 WHEN 0 THEN ' Co.' WHEN 1 THEN '  LLC' WHEN 2 THEN ' Trading Company Limited' WHEN 3 THEN ' Ltd. ' WHEN 4 THEN ' (Est) ™' ELSE '' END"
_SUFFIXES_SQL = "trim(raw)"
for _s in fv.LEGAL_SUFFIXES:
    _SUFFIXES_SQL = f"regexp_replace({_SUFFIXES_SQL}, '\\s+{_s.replace('.', chr(92) + '.')}$', '', 'i')"


@query(
    "name_normalize",
    f"""WITH r AS (SELECT p_partkey AS id, {_RAW_NAME} AS raw FROM part)
SELECT id, regexp_replace(trim(regexp_replace({_SUFFIXES_SQL}, '\\s+', ' ', 'g')), '[™®©]', '', 'g') AS name FROM r""",
)
def name_normalize(spark, sf_dir):
    """Names with legal endings taken off in their fixed order."""
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_RAW_NAME).alias("raw"))
    return r.select("id", tx.company_name(F.col("raw")).alias("name"))


@query(
    "match_key",
    f"""WITH r AS (SELECT p_partkey AS id, {_RAW_NAME} AS raw FROM part)
SELECT id, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS match_key,
  trim(regexp_replace(regexp_replace(lower(trim(raw)), '[^\\p{{L}}\\p{{N}}\\s.-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS name_key,
  regexp_replace(trim(regexp_replace(regexp_replace(lower(trim(raw)), '[^\\p{{L}}\\p{{N}}\\s.-]+', ' ', 'g'), '\\s+', ' ', 'g')), '[\\s.-]+', '', 'g') AS strict_key,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'),
    'limited', 'ltd'), 'company', 'co'), 'industrial', 'ind')) AS short_key,
  lower(regexp_replace(trim(raw), '\\s+', ' ', 'g')) AS brand_key
FROM r""",
)
def match_key(spark, sf_dir):
    """The five comparison keys of a name."""
    n = F.col("raw")
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_RAW_NAME).alias("raw"))
    return r.select(
        "id", tx.match_key(n).alias("match_key"), tx.unicode_name_key(n).alias("name_key"),
        tx.strict_name_key(n).alias("strict_key"), tx.short_name_key(n).alias("short_key"),
        tx.brand_key(n).alias("brand_key"),
    )


_PHONE = """CASE c_custkey % 9 WHEN 0 THEN '05' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN '5' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')
  WHEN 2 THEN '01 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '-1' WHEN 3 THEN '1' || lpad(CAST(c_custkey AS VARCHAR), 8, '1')
  WHEN 4 THEN '+966 (11) ' || lpad(CAST(c_custkey AS VARCHAR), 7, '2') WHEN 5 THEN '966' || lpad(CAST(c_custkey AS VARCHAR), 9, '3')
  WHEN 6 THEN '+49.' || CAST(c_custkey AS VARCHAR) || '.4455' WHEN 7 THEN CAST(c_custkey AS VARCHAR) ELSE 'tel: ' || c_name END"""


@query(
    "phone_normalize",
    f"""WITH p AS (SELECT c_custkey, {_PHONE} AS phone FROM customer), c AS (SELECT *, regexp_replace(phone, '[^\\d+]', '', 'g') AS c FROM p),
f AS (SELECT c_custkey, phone, CASE WHEN starts_with(c, '05') THEN '+966' || c[2:] WHEN starts_with(c, '5') AND length(c) = 9 THEN '+966' || c
  WHEN starts_with(c, '01') AND length(c) >= 10 THEN '+966' || c[2:] WHEN starts_with(c, '1') AND length(c) = 9 THEN '+966' || c
  WHEN starts_with(c, '+966') THEN c WHEN starts_with(c, '966') THEN '+' || c
  WHEN length(c) BETWEEN 7 AND 15 THEN CASE WHEN starts_with(c, '+') THEN c ELSE '+' || c END END AS full_form FROM c)
SELECT c_custkey, CASE WHEN regexp_matches(full_form, '^\\+\\d{{7,15}}$') THEN full_form END AS formatted,
  (CASE WHEN regexp_matches(full_form, '^\\+\\d{{7,15}}$') THEN 0.8 ELSE 0 END)::DOUBLE AS confidence,
  regexp_replace(phone, '[\\s\\-()+.]', '', 'g') AS digits FROM f""",
)
def phone_normalize(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_PHONE.replace("VARCHAR", "STRING")).alias("phone"))
    return p.select(
        "c_custkey", tx.phone_number(F.col("phone")).alias("n"), tx.phone_digits(F.col("phone")).alias("digits")
    ).select("c_custkey", "n.formatted", "n.confidence", "digits")


_MAIL = "CASE c_custkey % 4 WHEN 0 THEN ' Sales@' || c_name || '.COM ' WHEN 1 THEN c_name || '@host' WHEN 2 THEN 'a b@' || c_name || '.sa' ELSE replace(c_name, '#', '.') || '@mail.example.sa' END"


@query(
    "email_normalize",
    f"""WITH m AS (SELECT c_custkey, lower(trim({_MAIL})) AS c FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(c, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN c END AS formatted, regexp_matches(c, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS is_valid FROM m""",
)
def email_normalize(spark, sf_dir):
    m = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MAIL).alias("email"))
    return m.select("c_custkey", tx.email_address(F.col("email")).alias("e")).select("c_custkey", "e.formatted", "e.is_valid")


_CITY = "CASE id % 5 WHEN 0 THEN 'King Road, Riyadh ' || id WHEN 1 THEN city WHEN 2 THEN 'حي الملز الرياض' WHEN 3 THEN 'AL KHOBAR / ' || city ELSE upper(name_en) || ' Medina' END"
_CITY_CASE = " ".join(f"WHEN contains(c, '{s}') THEN '{n}'" for s, n in fv.CITY_SPELLINGS)
_COUNTRY_ANY = " OR ".join(f"contains(c, '{s}')" for s in fv.COUNTRY_SPELLINGS)


@query(
    "city_alias",
    f"""WITH {v.COMPANIES_SQL}, t AS (SELECT id, trim({_CITY}) AS raw, lower(trim({_CITY})) AS c FROM companies),
k AS (SELECT id, raw, c, CASE {_CITY_CASE} END AS known FROM t)
SELECT id, coalesce(known, CASE WHEN length(c) BETWEEN 2 AND 49 THEN raw END) AS city,
  (CASE WHEN known IS NOT NULL THEN 0.9 WHEN length(c) BETWEEN 2 AND 49 THEN 0.3 ELSE 0 END)::DOUBLE AS confidence,
  CASE WHEN {_COUNTRY_ANY} THEN 'Saudi Arabia' ELSE raw END AS country FROM k""",
)
def city_alias(spark, sf_dir):
    """City of an address by the first known spelling; country by its synonyms."""
    c = v.companies(spark, sf_dir).select("id", F.expr(_CITY).alias("raw"))
    return c.select(
        "id", tx.city_name(F.col("raw")).alias("c"), tx.country_name(F.col("raw"))["normalized"].alias("country")
    ).select("id", F.col("c.normalized").alias("city"), "c.confidence", "country")


@query(
    "script_share",
    """SELECT doc_id, round(length(regexp_replace(text, '[^\\x{00c0}-\\x{017f}]', '', 'g')) / length(text)::DOUBLE, 6) AS accented,
  length(regexp_replace(text, '[^\\x{0600}-\\x{06ff}]', '', 'g')) / length(text)::DOUBLE > 0.3 AS arabic FROM documents WHERE length(text) > 0""",
)
def script_share(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return d.select(
        "doc_id", F.round(tx.script_share(F.col("text"), "\\u00c0-\\u017f"), 6).alias("accented"),
        tx.is_mostly_arabic(F.col("text")).alias("arabic"),
    )


@query(
    "emails_found",
    """WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}')) AS email FROM documents)
SELECT DISTINCT doc_id, email FROM e WHERE NOT contains(email, 'placeholder') AND length(email) > 5""",
)
def emails_found(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(tx.emails_in(F.col("text"))).alias("email"))


@query(
    "phones_found",
    r"""WITH f AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '\+[\d\s\-()]{7,20}'), regexp_extract_all(text, '[\d\s\-()]{7,15}'))) AS p FROM documents),
t AS (SELECT doc_id, regexp_replace(p, '^\s+|\s+$', '', 'g') AS phone FROM f)
SELECT DISTINCT doc_id, phone FROM t WHERE regexp_matches(regexp_replace(phone, '[\s\-()]', '', 'g'), '^(\+\d{6,14}|\d{7,15})$')""",
)
def phones_found(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(tx.phones_in(F.col("text"))).alias("phone"))


# --- slugs ----------------------------------------------------------------------------------------

_SLUG_NAME = "p_name || ' & ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ' Trading Co.' ELSE '' END"
_ARABIC_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\x{{0600}}-\\x{{06ff}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in fv.SLUG_STOP_WORDS)


@query(
    "slug_latin",
    f"""WITH r AS (SELECT p_partkey AS id, {_SLUG_NAME} AS n FROM part)
SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(n)), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS latin,
  {_ARABIC_SLUG.format('n')} AS arabic,
  lower(regexp_replace(regexp_replace(trim(n), '[^a-zA-Z0-9\\s-]', '', 'g'), '\\s+', '-', 'g')) AS public_slug,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(n)), '\\s+', '-', 'g'), '[^\\w\\x{{0621}}-\\x{{064a}}.-]+', '', 'g'), '--+', '-', 'g'), '^-+|-+$', '', 'g'), '\\.+$', '') AS dotted
FROM r""",
)
def slug_latin(spark, sf_dir):
    """The four slug forms of a name."""
    n = F.col("n")
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_SLUG_NAME).alias("n"))
    return r.select(
        "id", tx.latin_slug(n).alias("latin"), tx.arabic_slug(n).alias("arabic"), tx.url_slug(n).alias("public_slug"),
        tx.dotted_slug(n).alias("dotted"),
    )


@query(
    "slug_keywords",
    f"""WITH r AS (SELECT p_partkey AS id, string_split_regex(regexp_replace(lower({_SLUG_NAME}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') AS w FROM part),
k AS (SELECT id, w, list_filter(w, lambda x: x <> '' AND x NOT IN ({_STOP})) AS keep FROM r)
SELECT id, array_to_string(CASE WHEN len(keep) > 0 THEN keep[1:5] ELSE w[1:2] END, '-') AS slug FROM k""",
)
def slug_keywords(spark, sf_dir):
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_SLUG_NAME).alias("n"))
    return r.select("id", tx.keyword_slug(F.col("n")).alias("slug"))


@query(
    "slug_unique",
    f"""WITH r AS (SELECT p_partkey AS id, p_size, {_ARABIC_SLUG.format('p_name')} AS base FROM part)
SELECT id, base, CASE WHEN rn = 1 THEN base ELSE base || '-' || (rn - 1) END AS slug FROM (
  SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_size, id) AS rn FROM r)""",
)
def slug_unique(spark, sf_dir):
    """Unique slugs: the first holder keeps the base, the others count up; size stands for creation time."""
    r = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), "p_size", tx.arabic_slug(F.col("p_name")).alias("base")
    )
    return unique_slugs(r, "base", ["p_size", "id"]).select("id", "base", "slug")


@query(
    "slug_against_stored",
    f"""WITH r AS (SELECT p_partkey AS id, {_ARABIC_SLUG.format('p_name')} AS base FROM part),
s AS (SELECT base, count(*) AS n FROM r WHERE id % 2 = 0 GROUP BY 1)
SELECT id, base || '-' || (coalesce(n, 0) - 1 + row_number() OVER (PARTITION BY base ORDER BY id)) AS slug
FROM r LEFT JOIN s USING (base) WHERE id % 2 = 1 AND n IS NOT NULL
UNION ALL SELECT id, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY id) = 1 THEN base ELSE base || '-' || (row_number() OVER (PARTITION BY base ORDER BY id) - 1) END
FROM r LEFT JOIN s USING (base) WHERE id % 2 = 1 AND n IS NULL""",
)
def slug_against_stored(spark, sf_dir):
    """Slugs for new rows beside stored ones: even ids are stored, odd ids arrive."""
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.arabic_slug(F.col("p_name")).alias("base"))
    stored = unique_slugs(r.where("id % 2 = 0"), "base", ["id"]).select("slug")
    return slugs_against_stored(r.where("id % 2 = 1"), stored, "base", ["id"]).select("id", "slug")


@query(
    "slug_id_tail",
    f"""WITH r AS (SELECT c_custkey AS id, {_ARABIC_SLUG.format("c_mktsegment || '-' || c_nationkey")} AS base FROM customer)
SELECT id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '-' || CAST(id AS VARCHAR)[1:4] ELSE base END AS slug FROM r""",
)
def slug_id_tail(spark, sf_dir):
    """Slug clashes solved by the first four characters of the id."""
    r = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), tx.arabic_slug(F.expr("c_mktsegment || '-' || c_nationkey")).alias("base")
    )
    return slug_or_id_tail(r, "base", "id").select("id", "slug")


@query(
    "public_paths",
    f"""WITH {v.NAMES_SQL}, s AS (SELECT id, lower(regexp_replace(regexp_replace(trim(name_en), '[^a-zA-Z0-9\\s-]', '', 'g'), '\\s+', '-', 'g')) AS slug, category FROM names)
SELECT id, '/en/company/' || id || '/' || slug AS path_en, '/ar/company/' || id || '/' || slug AS path_ar,
  '/company/' || id || '/' || slug AS public_path, '/ar/category/' || lower(category) AS category_path,
  CASE WHEN id % 3 = 0 THEN '/ar' ELSE '/ar/company/' || id || '/' || slug END AS swapped FROM s""",
)
def public_paths(spark, sf_dir):
    """Localised paths of a company and the same page in the other language."""
    n = v.names(spark, sf_dir).withColumn("slug", tx.url_slug(F.col("name_en")))
    en = tx.company_path(F.col("id"), F.col("slug"), F.lit("en"))
    public = tx.public_company_path(F.col("id"), F.col("name_en"))
    current = F.when(F.col("id") % 3 == 0, F.lit("/")).when(F.col("id") % 3 == 1, en).otherwise(public)
    return n.select(
        "id", en.alias("path_en"), tx.company_path(F.col("id"), F.col("slug"), F.lit("ar")).alias("path_ar"),
        public.alias("public_path"), tx.category_path(F.lower("category"), F.lit("ar")).alias("category_path"),
        tx.swap_language(current, "ar").alias("swapped"),
    )


# --- cells and pieces ---------------------------------------------------------------------------------


@query(
    "strip_scripts",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?i)javascript:|vbscript:|onload=|onerror=', '', 'g'))) AS stripped_md5,
  length(trim(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g')))::INTEGER AS stripped_length FROM pages""",
)
def strip_scripts(spark, sf_dir):
    """Script blocks out of whole page texts."""
    s = tx.strip_scripts(F.col("html"))
    return v.pages(spark, sf_dir).select("page_id", F.md5(s).alias("stripped_md5"), F.length(s).alias("stripped_length"))


@query(
    "truncate_text",
    "SELECT doc_id, CASE WHEN length(text) > 300 THEN text[1:300] || '...[truncated]' ELSE text END AS kept FROM documents",
)
def truncate_text(spark, sf_dir):
    """Long texts cut with a marker, as the provider log keeps them."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncated(F.col("text"), 300).alias("kept"))


_CELLS = """CASE p_partkey % 5 WHEN 0 THEN '["' || p_brand || '","' || p_type || '"]' WHEN 1 THEN p_brand || ' , ' || p_type || ',' WHEN 2 THEN '[object Object]'
  WHEN 3 THEN '[broken, ' || p_name ELSE NULL END"""


@query(
    "cell_arrays",
    f"""WITH c AS (SELECT p_partkey AS id, p_brand, p_type, p_name FROM part)
SELECT id, CASE id % 5 WHEN 0 THEN p_brand || '|' || p_type WHEN 1 THEN p_brand || '|' || p_type WHEN 3 THEN '[broken|' || p_name ELSE '' END AS items FROM c""",
)
def cell_arrays(spark, sf_dir):
    """Cells that hold JSON, comma lists, garbage or nothing, read as arrays."""
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_CELLS).alias("cell"))
    return c.select("id", F.array_join(tx.cell_to_array(F.col("cell")), "|").alias("items"))


@query(
    "corrupt_names",
    r"""WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'info@' || c_name || '.com' WHEN 1 THEN '2024-01-0' || (c_custkey % 9 + 1) || ' note' WHEN 2 THEN '+' || c_custkey
  WHEN 3 THEN 'mail me @ home' ELSE c_name END AS name FROM customer)
SELECT id, name FROM n WHERE id % 5 IN (0, 1, 2)""",
)
def corrupt_names(spark, sf_dir):
    """Rows whose name is a mail address, a date or a number: the delete list."""
    raw = F.expr(
        "CASE c_custkey % 5 WHEN 0 THEN 'info@' || c_name || '.com' WHEN 1 THEN '2024-01-0' || (c_custkey % 9 + 1) || ' note'"
        " WHEN 2 THEN '+' || c_custkey WHEN 3 THEN 'mail me @ home' ELSE c_name END"
    )
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), raw.alias("name"))
    return n.where(tx.is_corrupt_name(F.col("name")))


@query(
    "needs_shorter_name",
    """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id FROM d WHERE length(t) > 60 OR contains(t, ' a ') OR contains(t, ' manufacturer ')""",
)
def needs_shorter_name(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(tx.needs_shorter_name(F.col("text"))).select("doc_id")


@query(
    "token_overlap",
    """WITH t AS (SELECT page_id, lower(regexp_extract(html, '<title>(.*?)</title>', 1)) AS a, lower(regexp_extract(html, '<h1>(.*?)</h1>', 1)) AS b FROM pages),
s AS (SELECT page_id, list_distinct(list_filter(string_split_regex(regexp_replace(a, '[^a-z0-9\\x{0600}-\\x{06ff}\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 3)) AS a,
  list_distinct(list_filter(string_split_regex(regexp_replace(b, '[^a-z0-9\\x{0600}-\\x{06ff}\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 3)) AS b FROM t)
SELECT page_id, CASE WHEN least(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE, 6) ELSE 0.0::DOUBLE END AS overlap FROM s""",
)
def token_overlap(spark, sf_dir):
    """How far the title and the heading of a page speak of the same company."""
    p = v.pages(spark, sf_dir).select(
        "page_id",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("a"),
        F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("b"),
    )
    return p.select("page_id", F.round(tx.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


_NOTE = r"""'### ' || p_name || '\nSome line\nWebsite: www.' || replace(p_name, ' ', '') || '.com \nEmail: -\nPhone: 0' || p_partkey || '\n### ' || p_brand || '\nLocation: Hall ' || p_size || '\n'"""


@query(
    "note_sections",
    """SELECT p_partkey AS id, 0 AS section_no, p_name AS name, 'www.' || replace(p_name, ' ', '') || '.com' AS website, NULL::VARCHAR AS email, '0' || p_partkey AS phone, NULL::VARCHAR AS location FROM part
UNION ALL SELECT p_partkey, 1, p_brand, NULL, NULL, NULL, 'Hall ' || p_size FROM part""",
)
def note_sections(spark, sf_dir):
    """Headed sections of a note, with their labelled lines."""
    notes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_NOTE).alias("note"))
    s = notes.select("id", F.posexplode(tx.heading_sections(F.col("note"))).alias("section_no", "s"))
    return s.select(
        "id", "section_no", "s.name",
        *[tx.labelled_line(F.col("s.block"), label).alias(label.lower()) for label in ("Website", "Email", "Phone", "Location")],
    )


@query(
    "products_listed",
    """SELECT p_partkey AS id, array_to_string(list_distinct_ordered, '|') AS products FROM (SELECT p_partkey,
  CASE WHEN p_name = lower(p_type) THEN [p_name] ELSE [p_name, lower(p_type), p_brand] END AS list_distinct_ordered FROM part)""",
)
def products_listed(spark, sf_dir):
    """Products named in a sentence; numbers, links and mails among them do not count."""
    sentence = F.expr(
        "'We make many goods such as ' || p_name || ', ' || lower(p_type) || ' , 0501234567, a@b, ' || p_brand || '. More, to come'"
    )
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), sentence.alias("t"))
    return n.select("id", F.array_join(tx.products_in_sentence(F.col("t")), "|").alias("products"))


@query(
    "hex_mail",
    """SELECT s_suppkey AS id, lower(replace(s_name, '#', '.')) || '@' || 'mail.example.sa' AS mail FROM supplier""",
)
def hex_mail(spark, sf_dir):
    """Mails hidden as hex bytes masked by their first byte: masked in the query, unmasked by the operator."""
    plain = F.expr("lower(replace(s_name, '#', '.')) || '@mail.example.sa'")
    key = (F.col("s_suppkey") % 200 + 17).cast("int")
    hexed = lambda b: F.lower(F.lpad(F.hex(b), 2, "0"))
    masked = F.array_join(F.transform(F.split(plain, ""), lambda ch: hexed(F.ascii(ch).bitwiseXOR(key))), "")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(hexed(key), masked).alias("payload"))
    return s.select("id", tx.decode_hex_mail(F.col("payload")).alias("mail"))


@query(
    "website_texts",
    """WITH s AS (SELECT s_suppkey AS id, lower(replace(s_name, '#', '')) AS h FROM supplier)
SELECT id, CASE id % 4 WHEN 0 THEN 'https://' || h || '.com' WHEN 1 THEN 'https://' || h || '.com' WHEN 2 THEN 'https://' || h || '.com/x' ELSE NULL END AS website,
  CASE id % 4 WHEN 0 THEN 'www.' || h || '.com' WHEN 1 THEN h || '.com' WHEN 2 THEN 'https://' || h || '.com/x' ELSE NULL END AS url_like,
  CASE WHEN id % 4 IN (1, 2) THEN 'https://' || h || '.com' END AS from_name FROM s""",
)
def website_texts(spark, sf_dir):
    """Websites out of messy cells and names."""
    cell = F.expr(
        "CASE s_suppkey % 4 WHEN 0 THEN 'Website: www.' || lower(replace(s_name, '#', '')) || '.com' WHEN 1 THEN lower(replace(s_name, '#', '')) || '.com'"
        " WHEN 2 THEN 'https://' || lower(replace(s_name, '#', '')) || '.com/x).' ELSE 'call ' || s_name END"
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), cell.alias("cell"))
    c = F.col("cell")
    return s.select(
        "id", urls.website_candidate(c).alias("website"),
        F.regexp_replace(urls.first_url_like(c), r"[).]+$", "").alias("url_like"), urls.website_from_name(c).alias("from_name"),
    )
