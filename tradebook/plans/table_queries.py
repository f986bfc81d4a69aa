"""Queries that change, match and renumber tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.functions import text as tx
from tradebook.operators import categories as cat
from tradebook.operators import crawl
from tradebook.operators import tables as tb
from tradebook.plans import views as v
from tradebook.plans.registry import query, table


@query(
    "filters",
    f"""WITH {v.RICH_SQL} SELECT id, status, balance FROM rich WHERE status IN ('approved', 'pending') AND segment NOT IN ('BUILDING') AND balance >= 100 AND balance < 9000
  AND nation <> 3 AND name_en LIKE 'Customer#%' AND data_source ILIKE '%DIR%' AND coalesce(slug, '') = '' AND list_has_any(string_split(categories_text, '|'), ['MACHINERY', '2', 'chemicals', 'Electrical'])""",
)
def filters(spark, sf_dir):
    """Every comparison of the filter list at once."""
    out = tb.select_rows(
        v.rich(spark, sf_dir),
        [
            ("status", "in", ["approved", "pending"]), ("segment", "not-in", ["BUILDING"]), ("balance", ">=", 100), ("balance", "<", 9000),
            ("nation", "!=", 3), ("name_en", "like", "Customer#%"), ("data_source", "contains", "DIR"), ("slug", "is-blank", None),
            ("categories", "array-contains-any", ["MACHINERY", "2", "chemicals", "Electrical"]),
        ],
    )
    return out.select("id", "status", "balance")


@query(
    "filters_all_items",
    f"WITH {v.RICH_SQL} SELECT id FROM rich WHERE list_contains(categories, '2') AND list_contains(categories, 'chemicals')",
)
def filters_all_items(spark, sf_dir):
    return tb.select_rows(v.rich(spark, sf_dir), [("categories", "array-contains", ["2", "chemicals"])]).select("id")


@query("page_of_rows", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_of_rows(spark, sf_dir):
    """The third page of fifty of a list ordered by price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tb.select_rows(o, order_by="o_totalprice", descending=True, limit=50, offset=100, tie="o_orderkey")


_LAST = "(SELECT max(o_orderdate) FROM orders)"


@query("recent_rows", f"SELECT o_orderkey FROM orders WHERE o_orderdate >= {_LAST} - INTERVAL 24 HOURS")
def recent_rows(spark, sf_dir):
    """Rows of the 24 hours before the newest one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    as_of = o.agg(F.max("o_orderdate").alias("as_of"))  # one row
    joined = o.crossJoin(F.broadcast(as_of))
    return joined.where(F.col("o_orderdate") >= F.col("as_of") - F.expr("INTERVAL 24 HOURS")).select("o_orderkey")


# --- writes as tables --------------------------------------------------------------------------------------

_T = "t AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer)"
_ID = "CASE WHEN c_custkey % 5 IN (0, 1) THEN c_custkey ELSE c_custkey + 1000000000 END AS id"  # some are there, some are new
_U = f"u AS (SELECT {_ID}, upper(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'NEW' END AS segment, c_acctbal + 1 AS balance FROM customer)"


def _target(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_mktsegment AS segment", "c_acctbal AS balance"
    )


def _updates(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        _ID, "upper(c_name) AS name", "CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'NEW' END AS segment", "c_acctbal + 1 AS balance"
    )


@query("upsert", f"WITH {_T}, {_U} SELECT * FROM u UNION ALL SELECT * FROM t WHERE id NOT IN (SELECT id FROM u)")
def upsert(spark, sf_dir):
    return tb.upsert(_target(spark, sf_dir), _updates(spark, sf_dir), ["id"])


@query(
    "upsert_composite",
    """WITH t AS (SELECT l_orderkey AS company_id, l_linenumber AS field_no, l_comment AS value FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_comment FROM lineitem)),
u AS (SELECT l_orderkey AS company_id, l_linenumber + CASE WHEN l_linenumber > 2 THEN 100 ELSE 0 END AS field_no, min(l_linestatus) AS value FROM lineitem GROUP BY 1, 2)
SELECT * FROM u UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.company_id = t.company_id AND u.field_no = t.field_no)""",
)
def upsert_composite(spark, sf_dir):
    """Upsert on a two-column key."""
    li = table(spark, sf_dir, "lineitem")
    t = li.selectExpr("l_orderkey AS company_id", "l_linenumber AS field_no", "l_returnflag AS value")
    field = F.col("l_linenumber") + F.when(F.col("l_linenumber") > 2, 100).otherwise(0)
    u = li.groupBy(F.col("l_orderkey").alias("company_id"), field.alias("field_no")).agg(
        F.min("l_linestatus").alias("value")
    )
    return tb.upsert(t, u, ["company_id", "field_no"])


@query(
    "partial_update",
    f"WITH {_T}, {_U} SELECT t.id, t.name, CASE WHEN u.id IS NOT NULL THEN u.segment ELSE t.segment END AS segment, CASE WHEN u.id % 4 = 0 THEN u.balance ELSE t.balance END AS balance FROM t LEFT JOIN u ON t.id = u.id",
)
def partial_update(spark, sf_dir):
    """Only supplied columns change; a null means 'not supplied'."""
    changes = _updates(spark, sf_dir).selectExpr("id", "segment", "CASE WHEN id % 4 = 0 THEN balance END AS balance")
    return tb.partial_update(_target(spark, sf_dir), changes, ["id"])


@query(
    "upsert_keep_old",
    f"""WITH {_T}, {_U} SELECT coalesce(u.id, t.id) AS id, coalesce(u.name, t.name) AS name, CASE WHEN u.id IS NULL THEN t.segment ELSE coalesce(nullif(u.segment, ''), t.segment) END AS segment,
  coalesce(u.balance, t.balance) AS balance FROM t FULL JOIN u ON t.id = u.id""",
)
def upsert_keep_old(spark, sf_dir):
    return tb.upsert_keep_old(_target(spark, sf_dir), _updates(spark, sf_dir), ["id"], ["segment"])


@query("insert_absent", f"WITH {_T}, {_U} SELECT * FROM t UNION ALL SELECT * FROM u WHERE id NOT IN (SELECT id FROM t)")
def insert_absent(spark, sf_dir):
    return tb.insert_absent(_target(spark, sf_dir), _updates(spark, sf_dir), ["id"])


@query("delete_rows", f"WITH {_T}, {_U} SELECT * FROM t WHERE id NOT IN (SELECT id FROM u)")
def delete_rows(spark, sf_dir):
    return tb.delete_rows(_target(spark, sf_dir), _updates(spark, sf_dir), ["id"])


@query(
    "repair_unique",
    """WITH s AS (SELECT p_partkey AS id, p_name || ' ' || p_size AS name_en, lower(p_type) || '-' || p_size AS slug FROM part WHERE p_partkey % 2 = 0),
i AS (SELECT p_partkey AS id, upper(p_name) || ' ' || p_size AS name_en, lower(p_type) || '-' || p_size AS slug FROM part WHERE p_partkey % 2 = 1),
n AS (SELECT coalesce(k.sid, i.id) AS id, i.name_en, i.slug FROM i LEFT JOIN (SELECT lower(name_en) AS k, min(id) AS sid FROM s GROUP BY 1) k ON k.k = lower(i.name_en)),
o AS (SELECT slug, coalesce(min(CASE WHEN stored THEN id END), min(id)) AS owner FROM (SELECT slug, id, true AS stored FROM s UNION ALL SELECT slug, id, false FROM n) GROUP BY 1)
SELECT n.id, n.name_en, CASE WHEN owner <> n.id THEN regexp_replace(n.slug, '-\\d+$', '') || '-' || n.id ELSE n.slug END AS slug FROM n JOIN o USING (slug)""",
)
def repair_unique(spark, sf_dir):
    """Incoming rows that would break a unique name or slug."""
    p = table(spark, sf_dir, "part")
    s = p.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "p_name || ' ' || p_size AS name_en", "lower(p_type) || '-' || p_size AS slug")
    i = p.where("p_partkey % 2 = 1").selectExpr("p_partkey AS id", "upper(p_name) || ' ' || p_size AS name_en", "lower(p_type) || '-' || p_size AS slug")
    return tb.repair_unique(s, i)


# --- matching ------------------------------------------------------------------------------------------------

_CAND = """cand AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ' ' || p_size END AS name_en, '' AS name_ar,
  CASE WHEN p_partkey % 3 = 0 THEN 'http://www.' || replace(p_name, ' ', '') || p_size || '.com/?utm_source=x' ELSE '' END AS website_url,
  'https://dir.example.org/' || lower(p_type) || '/' || p_size || '/' AS source_url FROM part)"""


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ' ' || p_size END AS name_en",
        "'' AS name_ar",
        "CASE WHEN p_partkey % 3 = 0 THEN 'http://www.' || replace(p_name, ' ', '') || p_size || '.com/?utm_source=x' ELSE '' END AS website_url",
        "'https://dir.example.org/' || lower(p_type) || '/' || p_size || '/' AS source_url",
    )


_KEYS_SQL = """k AS (SELECT id, CASE WHEN website_url = '' THEN '' ELSE 'https://' || split_part(split_part(website_url, 'www.', 2), '/', 1) || '/' END AS w,
  rtrim(source_url, '/') AS s, regexp_replace(lower(name_en), '[^a-z0-9]', '', 'g') AS n FROM cand)"""


@query(
    "match_existing",
    f"""WITH {_CAND}, {_KEYS_SQL}, st AS (SELECT * FROM k WHERE id % 2 = 0), nw AS (SELECT * FROM k WHERE id % 2 = 1),
w AS (SELECT w, max(id) AS e FROM st WHERE w <> '' GROUP BY 1), s AS (SELECT s, max(id) AS e, arg_max(n, id) AS n FROM st GROUP BY 1), n AS (SELECT n, max(id) AS e FROM st WHERE n <> '' GROUP BY 1)
SELECT id, existing_id, rule FROM (SELECT nw.id, CASE WHEN w.e IS NOT NULL THEN w.e WHEN nw.n <> '' AND s.n = nw.n THEN s.e WHEN n.e IS NOT NULL THEN n.e WHEN nw.n = '' THEN s.e END AS existing_id,
  CASE WHEN w.e IS NOT NULL THEN 1 WHEN nw.n <> '' AND s.n = nw.n THEN 2 WHEN n.e IS NOT NULL THEN 3 WHEN nw.n = '' AND s.e IS NOT NULL THEN 4 END AS rule
  FROM nw LEFT JOIN w USING (w) LEFT JOIN s ON s.s = nw.s LEFT JOIN n ON n.n = nw.n) WHERE rule IS NOT NULL""",
)
def match_existing(spark, sf_dir):
    """New records (odd ids) against stored ones (even ids) by website, source and name."""
    c = _candidates(spark, sf_dir)
    return tb.match_existing(c.where("id % 2 = 1"), c.where("id % 2 = 0"), "id")


@query(
    "first_seen",
    f"""WITH {_CAND}, {_KEYS_SQL}, i AS (SELECT id, CASE WHEN w <> '' THEN 'website:' || w WHEN n <> '' THEN 'name:' || n || '|source:' || s ELSE 'source:' || s END AS identity FROM k)
SELECT min(id) AS id, identity FROM i GROUP BY identity""",
)
def first_seen(spark, sf_dir):
    """The first record of every identity of a batch."""
    c = _candidates(spark, sf_dir)
    return tb.first_per_identity(c, "id").select("id", "identity")


@query(
    "sync_plan",
    f"""WITH {_CAND}, k AS (SELECT id, regexp_replace(lower(name_en), '[^a-z0-9]', '', 'g') AS n FROM cand),
d AS (SELECT DISTINCT n FROM k WHERE id % 2 = 1 AND n <> '')
SELECT CASE WHEN n IN (SELECT n FROM k WHERE id % 2 = 0) THEN 'update' ELSE 'insert' END AS action, count(*) AS n FROM d GROUP BY 1""",
)
def sync_plan(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return tb.sync_plan(c.where("id % 2 = 1"), c.where("id % 2 = 0"))


@query(
    "csv_against_stored",
    """WITH n AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part),
s AS (SELECT k, max(id) AS stored_id FROM n WHERE id % 2 = 0 GROUP BY 1) SELECT n.id, stored_id FROM n LEFT JOIN s USING (k) WHERE n.id % 2 = 1""",
)
def csv_against_stored(spark, sf_dir):
    """Imported rows with the stored id of the same match key."""
    n = v.names(spark, sf_dir).select("id", tx.match_key(F.col("name_en")).alias("k"))
    s = n.where("id % 2 = 0").groupBy("k").agg(F.max("id").alias("stored_id"))
    return n.where("id % 2 = 1").join(s, "k", "left").select("id", "stored_id")


# --- ids -----------------------------------------------------------------------------------------------------

_MAP = "m AS (SELECT c_custkey AS old_id, 100000 + row_number() OVER (ORDER BY c_acctbal, c_custkey) AS new_id FROM customer)"


@query("renumber", f"WITH {_MAP} SELECT * FROM m")
def renumber(spark, sf_dir):
    """New ids for all rows in (balance, id) order from 100001."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old_id"), "c_acctbal")
    return tb.renumber(c, ["c_acctbal", "old_id"], 100_001, "new_id").select("old_id", "new_id")


@query("public_ids", "SELECT p_partkey AS id, 1000000 + row_number() OVER (ORDER BY p_size, p_name, p_partkey) AS public_company_id FROM part")
def public_ids(spark, sf_dir):
    """Public ids in (creation, name) order; size stands for the creation time."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_name")
    return tb.renumber(p, ["p_size", "p_name", "id"], 1_000_001, "public_company_id").select("id", "public_company_id")


@query(
    "resequence",
    "SELECT p_partkey AS id, 8880000 + row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS public_company_id FROM part WHERE p_size % 2 = 0",
)
def resequence(spark, sf_dir):
    """Ids handed out again by name after deletions."""
    p = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), "p_name")
    return tb.renumber(p, ["p_name", "id"], 8_880_000, "public_company_id").select("id", "public_company_id")


@query(
    "continue_ids",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 1000000 + p_partkey END AS public_id FROM part)
SELECT p_partkey, public_id FROM p WHERE public_id IS NOT NULL UNION ALL
SELECT p_partkey, (SELECT max(public_id) FROM p) + row_number() OVER (ORDER BY p_partkey) FROM p WHERE public_id IS NULL""",
)
def continue_ids(spark, sf_dir):
    """Rows without a public id continue the sequence."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_size % 3 <> 0 THEN 1000000 + p_partkey END").alias("public_id"))
    return tb.continue_ids(p, "public_id", ["p_partkey"])


@query(
    "reserve_ids",
    """SELECT o_orderkey, (SELECT greatest(max(c_custkey), 100000) FROM customer) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders WHERE o_orderstatus = 'P'""",
)
def reserve_ids(spark, sf_dir):
    """A block of ids for new rows after the largest id in use."""
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    taken = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return tb.reserve_ids(new, taken, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


@query(
    "keep_or_reserve_ids",
    """WITH n AS (SELECT p_partkey AS row_no, p_size * 40 + p_partkey % 40 + 1 AS wish FROM part), used AS (SELECT DISTINCT c_custkey * 2 AS id FROM customer),
w AS (SELECT min(row_no) AS row_no, wish FROM n WHERE wish NOT IN (SELECT id FROM used) GROUP BY wish)
SELECT row_no, wish AS new_id FROM w UNION ALL
SELECT row_no, greatest(100000, (SELECT max(id) FROM used), (SELECT max(wish) FROM w)) + row_number() OVER (ORDER BY row_no) FROM n WHERE row_no NOT IN (SELECT row_no FROM w)""",
)
def keep_or_reserve_ids(spark, sf_dir):
    """Proposed ids kept where free, the others numbered on."""
    n = table(spark, sf_dir, "part").selectExpr("p_partkey AS row_no", "'' || (p_size * 40 + p_partkey % 40 + 1) AS wish")
    used = table(spark, sf_dir, "customer").selectExpr("'' || (c_custkey * 2) AS id")
    return tb.keep_or_reserve(n, used, "wish", ["row_no"]).select("row_no", "new_id")


@query("remap_ids", f"WITH {_MAP} SELECT o_orderkey, new_id AS o_custkey FROM orders JOIN m ON old_id = o_custkey")
def remap_ids(spark, sf_dir):
    """Foreign keys of orders rewritten through the renumbering of customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old_id"), "c_acctbal")
    id_map = tb.renumber(c, ["c_acctbal", "old_id"], 100_001, "new_id")
    return tb.remap(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", id_map)


@query(
    "remap_array_ids",
    f"""WITH {_MAP}, a AS (SELECT o_orderkey, o_custkey AS first_id, o_custkey + 1 AS second_id FROM orders),
x AS (SELECT o_orderkey, 0 AS pos, first_id AS item FROM a UNION ALL SELECT o_orderkey, 1, second_id FROM a)
SELECT o_orderkey, pos, coalesce(new_id, item) AS item FROM x LEFT JOIN m ON old_id = item""",
)
def remap_array_ids(spark, sf_dir):
    """Array elements rewritten through the map; ids the map lacks stay."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("old_id"), "c_acctbal")
    id_map = tb.renumber(c, ["c_acctbal", "old_id"], 100_001, "new_id")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("merged_from"))
    return tb.remap_items(o, "o_orderkey", "merged_from", id_map)


@query(
    "restore_ids",
    """WITH b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || p_size ELSE p_name || '-' || p_partkey END AS name_en FROM part), s AS (SELECT p_partkey + p_partkey % 2 AS id, upper(p_name || p_size) AS name_en FROM part),
n AS (SELECT lower(name_en) AS k, min(id) AS nid FROM s GROUP BY 1)
SELECT id AS old_id, coalesce(nid, id) AS new_id FROM b LEFT JOIN n ON k = lower(name_en)""",
)
def restore_ids(spark, sf_dir):
    """Ids of backup rows after a restore: by name, by id, or their own."""
    p = table(spark, sf_dir, "part")
    b = p.selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN p_name || p_size ELSE p_name || '-' || p_partkey END AS name_en")
    s = p.selectExpr("p_partkey + p_partkey % 2 AS id", "upper(p_name || p_size) AS name_en")
    return tb.restore_ids(b, s)


@query(
    "names_or_default",
    "SELECT o_orderkey, '' || o_custkey AS company_id, coalesce(c_name, 'Unknown') AS name_en FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey % 2 = 0",
)
def names_or_default(spark, sf_dir):
    """Jobs with the names of their companies, 'Unknown' where there is none."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "'' || o_custkey AS company_id")
    c = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").selectExpr("'' || c_custkey AS id", "c_name AS name_en")
    return tb.names_or_default(o, c, "company_id", "name_en", F.lit("Unknown")).select("o_orderkey", "company_id", "name_en")


# --- contacts, brands, categories -------------------------------------------------------------------------------

_CONTACTS = f"""WITH {v.RICH_SQL}, w AS (
  SELECT id AS company_id, 'general' AS contact_type, email, phone FROM rich WHERE coalesce(email, '') <> '' OR coalesce(phone, '') <> ''
  UNION ALL SELECT id, 'general', contact_email, NULL FROM rich WHERE contact_email <> '' UNION ALL SELECT id, 'sales', sales_email, NULL FROM rich WHERE sales_email <> '')
SELECT company_id, contact_type, email, phone FROM w"""


@query("contacts", _CONTACTS)
def contacts(spark, sf_dir):
    """Contact rows of the company records."""
    r = v.rich(spark, sf_dir).withColumns({"whatsapp": F.lit(None).cast("string"), "procurement_email": F.lit(None).cast("string")})
    return tb.contacts_of(r).select("company_id", "contact_type", "email", "phone")


@query("contacts_missing", _CONTACTS + " WHERE NOT (try_cast(company_id AS BIGINT) % 2 = 0 AND contact_type = 'general')")
def contacts_missing(spark, sf_dir):
    """Contact rows not stored yet; the general contacts of even ids are stored, with '' for null."""
    r = v.rich(spark, sf_dir).withColumns({"whatsapp": F.lit(None).cast("string"), "procurement_email": F.lit(None).cast("string")})
    wanted = tb.contacts_of(r)
    stored = wanted.where("cast(company_id as bigint) % 2 = 0 and contact_type = 'general'").na.fill("", ["email", "phone", "whatsapp"])
    return tb.contacts_missing(wanted, stored).select("company_id", "contact_type", "email", "phone")


_BRANDS = "x AS (SELECT l_suppkey AS id, unnest(['  ' || p_brand || ' ', upper(p_brand), lower(p_type), '']) AS brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1)"
_BRAND_KEY = "lower(regexp_replace(trim(brand), '\\s+', ' ', 'g'))"


def _company_brands(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem").where("l_linenumber = 1"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("id"),
        F.array(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" ")), F.upper("p_brand"), F.lower("p_type"), F.lit("")).alias("brands"),
        F.array("p_type", "p_name").alias("categories"),
    )


@query(
    "brand_dimension",
    f"WITH {_BRANDS} SELECT {_BRAND_KEY} AS normalized_name, min(trim(brand)) AS name FROM x WHERE {_BRAND_KEY} <> '' GROUP BY 1",
)
def brand_dimension(spark, sf_dir):
    return cat.brand_dimension(_company_brands(spark, sf_dir), F.col("brands")).select("normalized_name", "name")


@query("brand_junction", f"WITH {_BRANDS} SELECT DISTINCT id, {_BRAND_KEY} AS brand FROM x WHERE {_BRAND_KEY} <> ''")
def brand_junction(spark, sf_dir):
    cb = _company_brands(spark, sf_dir)
    dim = cat.brand_dimension(cb, F.col("brands"))
    j = cat.brand_junction(cb, "id", F.col("brands"), dim)
    return j.join(dim.select(F.col("id").alias("brand_id"), F.col("normalized_name").alias("brand")), "brand_id").select("id", "brand")


_LINE = "lower(p_brand || ' ' || p_type)"


@query(
    "brand_orphans",
    f"SELECT DISTINCT {_LINE} AS brand FROM part WHERE {_LINE} NOT IN (SELECT {_LINE} FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND l_quantity >= 49 AND l_discount >= 0.08)",
)
def brand_orphans(spark, sf_dir):
    """Brand lines of the dimension that no company of a certain kind uses."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    dim = p.select(F.expr(_LINE).alias("brand")).distinct()
    used = (
        li.where("l_returnflag = 'A' and l_quantity >= 49 and l_discount >= 0.08")
        .join(p, li.l_partkey == p.p_partkey).select(F.expr(_LINE).alias("ref"))
    )
    return cat.unused(dim, used, "brand", "ref")


@query(
    "brand_sync",
    f"""WITH {_BRANDS.replace("FROM lineitem", "FROM lineitem")}, k AS (SELECT id, {_BRAND_KEY} AS brand FROM x WHERE {_BRAND_KEY} <> '')
SELECT DISTINCT id, brand FROM k WHERE id % 2 = 0 UNION SELECT DISTINCT id, 'renamed ' || id FROM k WHERE id % 2 = 1""",
)
def brand_sync(spark, sf_dir):
    """Brand tables after the companies with odd ids changed their brands."""
    cb = _company_brands(spark, sf_dir)
    dim = cat.brand_dimension(cb, F.col("brands"))
    junction = cat.brand_junction(cb, "id", F.col("brands"), dim)
    changed = cb.where("id % 2 = 1").select("id").distinct().withColumn("brands", F.array(F.concat(F.lit("Renamed  "), F.col("id").cast("string"))))
    brands, after = cat.synced_brands(dim, junction, changed, "id", F.col("brands"))
    return after.join(brands.select(F.col("id").alias("brand_id"), F.col("normalized_name").alias("brand")), "brand_id").select("id", "brand")


_CATV = "c AS (SELECT l_suppkey AS id, unnest([p_type, p_name]) AS val FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1)"
_TITLE = "array_to_string(list_transform(string_split(val, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("category_dimension", f"WITH {_CATV} SELECT lower(replace(val, ' ', '-')) AS id, min({_TITLE}) AS name_en, lower(replace(val, ' ', '-')) AS slug FROM c GROUP BY 1, 3")
def category_dimension(spark, sf_dir):
    """Dimension rows for the category values in use."""
    return cat.category_dimension(_company_brands(spark, sf_dir), ["categories"])


@query("category_junction", f"WITH {_CATV} SELECT DISTINCT id, lower(replace(val, ' ', '-')) AS category_id FROM c")
def category_junction(spark, sf_dir):
    cb = _company_brands(spark, sf_dir)
    return cat.category_junction(cb, "id", ["categories"], cat.category_dimension(cb, ["categories"]))


# --- jobs --------------------------------------------------------------------------------------------------------

_JOBS = "jobs AS (SELECT o_orderkey AS id, o_orderpriority AS queue_name, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status, o_custkey || ':' || o_orderpriority AS idempotency_key, o_orderdate AS created_at, (o_orderkey % 6)::INTEGER AS attempts, o_totalprice FROM orders)"


def _jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderpriority AS queue_name",
        "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status",
        "o_custkey || ':' || o_orderpriority AS idempotency_key", "o_orderdate AS created_at", "cast(o_orderkey % 6 as int) AS attempts", "o_totalprice",
    )


@query(
    "enqueue_jobs",
    f"""WITH {_JOBS}, r AS (SELECT DISTINCT c_custkey || ':' || queue_name AS idempotency_key FROM customer, (SELECT DISTINCT queue_name FROM jobs) WHERE c_mktsegment <> 'BUILDING')
SELECT idempotency_key, 'pending' AS status, 0 AS attempts FROM r WHERE idempotency_key NOT IN (SELECT idempotency_key FROM jobs WHERE status <> 'completed')""",
)
def enqueue_jobs(spark, sf_dir):
    """Requests that become jobs because no unfinished job has their key; every request comes twice."""
    jobs = _jobs(spark, sf_dir)
    queues = F.array(*[F.lit(q) for q in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    c = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("ordinal"), F.explode(queues).alias("queue")
    )
    r = c.select(F.concat_ws(":", F.col("ordinal").cast("string"), "queue").alias("idempotency_key"), "ordinal")
    return crawl.enqueue(jobs, r.union(r), "ordinal").select("idempotency_key", "status", "attempts")


@query(
    "retry_plan",
    f"""WITH {_JOBS} SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 5 THEN 'dead_letter' ELSE 'pending' END AS status,
  CASE WHEN attempts + 1 < 5 THEN (1000 * 2 ** attempts)::BIGINT END AS wait_ms FROM jobs WHERE status = 'failed'""",
)
def retry_plan(spark, sf_dir):
    """Next state of the failed jobs."""
    failed = _jobs(spark, sf_dir).where("status = 'failed'").withColumn("max_attempts", F.lit(5))
    out = crawl.plan_retries(failed, F.lit("2024-01-01").cast("timestamp"))
    return out.select("id", "attempts", "status", "wait_ms")


@query(
    "status_pivot",
    f"""WITH {_JOBS} SELECT queue_name, count_if(status = 'pending')::BIGINT AS pending, count_if(status = 'processing')::BIGINT AS processing, count_if(status = 'completed')::BIGINT AS completed,
  count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'dead_letter')::BIGINT AS dead_letter FROM jobs GROUP BY 1""",
)
def status_pivot(spark, sf_dir):
    return crawl.queue_statistics(_jobs(spark, sf_dir))


@query("jobs_recent", f"WITH {_JOBS} SELECT id, queue_name FROM jobs WHERE queue_name = '2-HIGH' AND status = 'failed' ORDER BY created_at DESC, id LIMIT 50")
def jobs_recent(spark, sf_dir):
    """The newest failed jobs of one queue."""
    return tb.select_rows(
        _jobs(spark, sf_dir), [("queue_name", "==", "2-HIGH"), ("status", "==", "failed")], "created_at", True, 50, tie="id"
    ).select("id", "queue_name")


@query(
    "due_rows",
    """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'daily' WHEN 'O' THEN 'weekly' ELSE 'monthly' END AS frequency,
  strftime(TIMESTAMP '1998-01-01' + CASE o_orderstatus WHEN 'F' THEN INTERVAL 1 DAY WHEN 'O' THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END, '%Y-%m-%d') AS next_run
FROM orders WHERE o_custkey % 2 = 0 AND o_orderdate <= TIMESTAMP '1998-01-01'""",
)
def due_rows(spark, sf_dir):
    """Schedules that are due, with their next run."""
    s = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'daily' WHEN 'O' THEN 'weekly' ELSE 'monthly' END AS frequency",
        "o_custkey % 2 = 0 AS is_active", "o_orderdate AS next_run_at",
    )
    out = crawl.due_schedules(s, F.lit("1998-01-01").cast("timestamp"))
    return out.select("id", "frequency", F.date_format("next_run_at", "yyyy-MM-dd").alias("next_run"))
