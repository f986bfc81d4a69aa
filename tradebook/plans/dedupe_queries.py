"""Queries over duplicates: pairs, groups, golden records, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradebook.functions import fixed_values as fv
from tradebook.functions import similarity as sim
from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.operators import dedupe as dd
from tradebook.operators import resolve as rs
from tradebook.plans import views as v
from tradebook.plans.registry import query, table

_FIRMS = {
    "id": "p_partkey",
    "name_en": "p_name || ' ' || lower(p_type) || CASE p_partkey % 5 WHEN 0 THEN ' Ltd' WHEN 1 THEN 's' WHEN 2 THEN ' co.' ELSE '' END",
    "name_ar": "''",
    "website_url": "CASE WHEN p_partkey % 9 = 0 THEN 'http://www.site' || p_size || '.com/en/' || p_partkey ELSE '' END",
    "linkedin_url": "CASE WHEN p_partkey % 13 = 0 THEN 'https://www.linkedin.com/company/' || lower(replace(p_brand, '#', '')) || '/' ELSE '' END",
    "city": "CASE p_size % 4 WHEN 0 THEN 'Riyadh' WHEN 1 THEN 'Jeddah' WHEN 2 THEN 'Dammam' ELSE '' END",
}
_FIRMS_SQL = "firms AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FIRMS.items()) + " FROM part)"


def _firms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(*[F.expr(e).alias(n) for n, e in _FIRMS.items()])


_BARE = f"trim(regexp_replace(regexp_replace(lower(name_en), '\\b({'|'.join(fv.LEGAL_WORDS)})\\b\\.?', '', 'g'), '\\s+', ' ', 'g'))"


def _match_sql(a: str, b: str) -> str:
    """Confidence of a name pair, null when it is no match."""
    sh, lo = f"least(length({a}), length({b}))", f"greatest(length({a}), length({b}))"
    s = f"(({lo} - levenshtein({a}, {b}))::DOUBLE / {lo})"
    return (
        f"CASE WHEN {a} = {b} THEN 0.95 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN CASE WHEN {sh}::DOUBLE / {lo} > 0.7 THEN {sh}::DOUBLE / {lo} * 0.8 END "
        f"WHEN {s} > 0.85 THEN {s} * 0.9 END"
    )


_KEYED = f"""keyed AS (SELECT id, {_BARE} AS name, CASE WHEN city <> '' THEN lower(city) END AS city,
  regexp_extract(website_url, '^http://www\\.([^/]+)', 1) AS domain, linkedin_url AS linkedin FROM firms)"""

_PAIRS_SQL = f"""{_FIRMS_SQL}, {_KEYED},
nc AS (SELECT name, city, min(id) AS first_id FROM keyed GROUP BY 1, 2),
near AS (SELECT a.first_id AS x, b.first_id AS y, {_match_sql('a.name', 'b.name')} AS c FROM nc a JOIN nc b ON a.city = b.city AND a.name < b.name),
raw AS (
  SELECT f.src, k.id AS dst, 0.95::DOUBLE AS confidence FROM keyed k JOIN (SELECT domain, min(id) AS src FROM keyed WHERE domain <> '' GROUP BY 1) f USING (domain)
  UNION ALL SELECT f.src, k.id, 0.9::DOUBLE FROM keyed k JOIN (SELECT linkedin, min(id) AS src FROM keyed WHERE linkedin <> '' GROUP BY 1) f USING (linkedin)
  UNION ALL SELECT first_id, k.id, 0.8075::DOUBLE FROM keyed k JOIN nc USING (name, city)
  UNION ALL SELECT f.src, k.id, 0.665::DOUBLE FROM keyed k JOIN (SELECT name, min(id) AS src FROM keyed GROUP BY 1) f USING (name)
  UNION ALL SELECT least(x, y), greatest(x, y), c * 0.85 FROM near WHERE c > 0.7),
pairs AS (SELECT src, dst, max(confidence) AS confidence FROM raw WHERE src <> dst GROUP BY 1, 2)"""


@query("duplicate_pairs", f"WITH {_PAIRS_SQL} SELECT src, dst, round(confidence, 6) AS confidence FROM pairs")
def duplicate_pairs(spark, sf_dir):
    """Pairs by domain, profile address and name; every key gives a star, not all its pairs."""
    return dd.duplicate_pairs(_firms(spark, sf_dir)).select("src", "dst", F.round("confidence", 6).alias("confidence"))


@query(
    "similar_names",
    f"""WITH {_FIRMS_SQL}, n AS (SELECT DISTINCT {_BARE} AS name FROM firms), p AS (SELECT a.name AS a, b.name AS b, {_match_sql('a.name', 'b.name')} AS c FROM n a JOIN n b ON a.name < b.name)
SELECT a, b, round(c, 6)::DOUBLE AS confidence FROM p WHERE c IS NOT NULL""",
)
def similar_names(spark, sf_dir):
    """All pairs of distinct names that match, found without comparing all of them."""
    n = _firms(spark, sf_dir).select(tx.bare_name(F.col("name_en")).alias("name"))
    return dd.similar_names(n).select("a", "b", F.round("confidence", 6).alias("confidence"))


@query(
    "name_scores",
    f"""WITH {_FIRMS_SQL}, p AS (SELECT id, name_en AS a, upper(lag(name_en) OVER (ORDER BY id)) AS b FROM firms),
q AS (SELECT id, a, b, trim(regexp_replace(regexp_replace(lower(a), '\\b({'|'.join(fv.LEGAL_WORDS)})\\b\\.?', '', 'g'), '\\s+', ' ', 'g')) AS x,
  trim(regexp_replace(regexp_replace(lower(b), '\\b({'|'.join(fv.LEGAL_WORDS)})\\b\\.?', '', 'g'), '\\s+', ' ', 'g')) AS y FROM p WHERE b IS NOT NULL)
SELECT id, levenshtein(a, b) AS distance, round((greatest(length(a), length(b)) - levenshtein(lower(a), lower(b)))::DOUBLE / greatest(length(a), length(b)), 6) AS similarity,
  {_match_sql('x', 'y')} IS NOT NULL AS is_match FROM q""",
)
def name_scores(spark, sf_dir):
    """Distance, similarity and verdict of each name and the one before it."""
    f = _firms(spark, sf_dir).select("id", "name_en")
    before = f.select((F.col("id") + 1).alias("id"), F.upper("name_en").alias("b"))
    p = f.join(before, "id").withColumnRenamed("name_en", "a")
    a, b = F.col("a"), F.col("b")
    return p.select(
        "id", F.levenshtein(a, b).cast("long").alias("distance"), F.round(sim.similarity(a, b), 6).alias("similarity"),
        sim.same_name(a, b)["is_match"].alias("is_match"),
    )


@query(
    "duplicate_groups",
    f"""WITH RECURSIVE {_PAIRS_SQL}, e AS (SELECT src AS x, dst AS y FROM pairs UNION SELECT dst, src FROM pairs),
reach(id, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM reach r JOIN e ON e.x = r.id),
g AS (SELECT id, min(root) AS component FROM reach GROUP BY 1)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM g""",
)
def duplicate_groups(spark, sf_dir):
    """Groups as connected components of the pairs."""
    return dd.duplicate_groups(dd.duplicate_pairs(_firms(spark, sf_dir))).select("id", "component", "size")


@query(
    "domain_groups",
    f"""WITH {v.URL_PARTS_SQL}, d AS (SELECT page_id, regexp_replace(host, '^(www|m|blog)\\.', '') AS site, regexp_replace(host, '^www\\.', '') AS domain FROM url_parts)
SELECT page_id AS id, min(page_id) OVER (PARTITION BY site) AS component FROM d QUALIFY count(*) OVER (PARTITION BY site) > 1""",
)
def domain_groups(spark, sf_dir):
    """Pages of one site, reached over several pair rules: same host, same host without its mobile or blog prefix."""
    h = v.pages(spark, sf_dir).select(
        F.col("page_id").alias("id"), urls.domain(F.col("url")).alias("domain"),
        F.regexp_replace(urls.host(F.col("url")), r"^(www|m|blog)\.", "").alias("site"),
    )
    pairs = dd.star_pairs(h, "domain", F.lit("domain"), 0.95).unionByName(dd.star_pairs(h, "site", F.lit("site"), 0.9))
    return dd.components(pairs)


# --- one of several ----------------------------------------------------------------------------------------

_LIST = "cand AS (SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END AS name_en, CASE WHEN p_size % 3 = 0 THEN 'https://x' || p_size || '.com' ELSE ' ' END AS website_url, CASE WHEN p_size % 5 = 0 THEN 'a@b.co' ELSE '' END AS email, CASE WHEN p_size % 2 = 0 THEN '1234567' END AS phone, p_retailprice / 10000 AS confidence_score FROM part)"


def _list(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_name || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END AS name_en", "'' AS name_ar",
        "CASE WHEN p_size % 3 = 0 THEN 'https://x' || p_size || '.com' ELSE ' ' END AS website_url",
        "CASE WHEN p_size % 5 = 0 THEN 'a@b.co' ELSE '' END AS email", "CASE WHEN p_size % 2 = 0 THEN '1234567' END AS phone",
        "p_retailprice / 10000 AS confidence_score",
    )


@query(
    "most_complete",
    f"""WITH {_LIST} SELECT id, name_en FROM (SELECT *, row_number() OVER (PARTITION BY replace(name_en, '!', '') ORDER BY trim(website_url) <> '' DESC, email <> '' DESC, coalesce(phone, '') <> '' DESC, confidence_score DESC, id) AS rn FROM cand) WHERE rn = 1""",
)
def most_complete(spark, sf_dir):
    """The fullest record of every name."""
    return dd.most_complete_by_name(_list(spark, sf_dir), "id").select("id", "name_en")


@query(
    "filled_from_twins",
    f"""WITH {_LIST}, t AS (SELECT name_en, arg_min(website_url, id) FILTER (WHERE trim(website_url) <> '') AS w, arg_min(email, id) FILTER (WHERE email <> '') AS e, arg_min(phone, id) FILTER (WHERE phone <> '') AS p FROM cand GROUP BY 1)
SELECT id, CASE WHEN trim(website_url) <> '' THEN website_url ELSE w END AS website_url, CASE WHEN email <> '' THEN email ELSE e END AS email, coalesce(phone, p) AS phone FROM cand JOIN t USING (name_en)""",
)
def filled_from_twins(spark, sf_dir):
    """Stub records take what their best twin of the same name has."""
    return dd.filled_from_twins(_list(spark, sf_dir), "name_en", "id", ["website_url", "email", "phone"]).select("id", "website_url", "email", "phone")


@query("first_by_name_site", f"WITH {_LIST} SELECT min(id) AS id FROM cand GROUP BY lower(trim(name_en)), lower(trim(website_url))")
def first_by_name_site(spark, sf_dir):
    return dd.first_by_name_and_site(_list(spark, sf_dir), "id").select("id")


@query(
    "short_name_deletes",
    f"WITH {_LIST}, k AS (SELECT id, replace(name_en, '!', '') AS key FROM cand) SELECT id FROM k WHERE id NOT IN (SELECT min(id) FROM k GROUP BY key)",
)
def short_name_deletes(spark, sf_dir):
    """Records to delete because an earlier one has the same shortened name."""
    return dd.duplicates_by_short_name(_list(spark, sf_dir), "id").select("id")


@query("last_wins", f"WITH {_LIST} SELECT max(id) AS id, regexp_replace(lower(name_en), '[^a-z0-9]', '', 'g') AS match_key FROM cand GROUP BY 2")
def last_wins(spark, sf_dir):
    """The last row per match key of an import."""
    return dd.last_per_match_key(_list(spark, sf_dir), "id").select("id", tx.match_key(F.col("name_en")).alias("match_key"))


# --- golden records ---------------------------------------------------------------------------------------------

_F = rs.FIELDS


@query(
    "golden_master",
    f"WITH {v.RICH_SQL} SELECT nation, arg_min(id, seq) AS id, " + ", ".join(f"arg_min({f}, seq) FILTER (WHERE {f} <> '') AS {f}" for f in _F) + " FROM rich GROUP BY nation",
)
def golden_master(spark, sf_dir):
    """One record per group, the master's values first; nations stand for groups."""
    return rs.golden_master(v.rich(spark, sf_dir), "nation", "seq")


@query(
    "golden_latest",
    f"WITH {v.RICH_SQL} SELECT nation, arg_min(id, seq) AS id, " + ", ".join(f"arg_max({f}, seq) FILTER (WHERE {f} <> '') AS {f}" for f in _F) + " FROM rich GROUP BY nation",
)
def golden_latest(spark, sf_dir):
    return rs.golden_latest(v.rich(spark, sf_dir), "nation", "seq")


@query(
    "golden_majority",
    f"""WITH {v.RICH_SQL}, l AS ({' UNION ALL '.join(f"SELECT nation, seq, '{f}' AS field, {f} AS value FROM rich" for f in _F)}),
c AS (SELECT nation, field, value, count(*) AS n, min(seq) AS first FROM l WHERE trim(value) <> '' GROUP BY ALL),
w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY nation, field ORDER BY n DESC, first) = 1)
SELECT nation, {', '.join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in _F)} FROM w GROUP BY nation""",
)
def golden_majority(spark, sf_dir):
    """The most frequent value of every field."""
    return rs.golden_majority(v.rich(spark, sf_dir), "nation", "seq")


@query(
    "golden_items",
    f"""WITH {v.RICH_SQL}, x AS (SELECT nation, 'categories' AS field, seq, unnest(categories) AS item, unnest(range(0, len(categories))) AS pos FROM rich
  UNION ALL SELECT nation, 'products', seq, unnest(products), unnest(range(0, len(products))) FROM rich)
SELECT nation, field, item, min(seq) AS first_member FROM x GROUP BY ALL""",
)
def golden_items(spark, sf_dir):
    """Distinct list items of every group and the member that brought them."""
    return rs.golden_items(v.rich(spark, sf_dir), "nation", "seq").select("nation", "field", "item", "first_member")


@query(
    "merged_pairs",
    f"""WITH {v.RICH_SQL}, m AS (SELECT * FROM rich WHERE seq % 2 = 0), d AS (SELECT * FROM rich WHERE seq % 2 = 1)
SELECT m.id, CASE WHEN trim(coalesce(m.name_en, '')) <> '' THEN m.name_en ELSE coalesce(nullif(d.name_en, ''), m.name_en) END AS name_en,
  coalesce(nullif(trim(m.phone), ''), d.phone) AS phone, CASE WHEN m.score <> 0 THEN m.score ELSE coalesce(d.score, m.score) END AS score,
  len(list_distinct(list_concat(coalesce(m.categories, []), coalesce(d.categories, []))))::INTEGER AS n_categories, m.id || CASE WHEN d.id IS NOT NULL THEN '|' || d.id ELSE '' END AS merged_from
FROM m LEFT JOIN d ON d.seq = m.seq + 1""",
)
def merged_pairs(spark, sf_dir):
    """Each even record merged with the odd one after it."""
    r = v.rich(spark, sf_dir).select("id", "seq", "name_en", "phone", "score", "categories")
    m = r.where("seq % 2 = 0").withColumn("pair", F.col("seq"))
    d = r.where("seq % 2 = 1").withColumn("pair", F.col("seq") - 1)
    out = rs.merged_pair(m, d, "pair")
    return out.select(
        "id", "name_en", "phone", "score", F.size(F.coalesce("categories", F.array().cast("array<string>"))).alias("n_categories"),
        F.array_join("merged_from", "|").alias("merged_from"),
    )


_CONFLICTS = " + ".join(f"(CASE WHEN count(DISTINCT nullif({f}, '')) > 1 THEN 1 ELSE 0 END)" for f in _F)


@query(
    "conflicts",
    f"""WITH {v.RICH_SQL} SELECT seq // 3 AS grp, array_to_string(list_filter([{', '.join(f"CASE WHEN count(DISTINCT nullif({f}, '')) > 1 THEN '{f}' END" for f in _F)}], lambda x: x IS NOT NULL), ',') AS conflicts FROM rich GROUP BY 1""",
)
def conflicts(spark, sf_dir):
    """Fields in which the members of a group disagree; runs of three customers stand for groups."""
    r = v.rich(spark, sf_dir).withColumn("grp", F.floor(F.col("seq") / 3).cast("long"))
    return rs.conflicts(r, "grp").select("grp", F.array_join("conflicts", ",").alias("conflicts"))


@query(
    "resolution_confidence",
    f"""WITH {v.RICH_SQL}, m AS (SELECT *, seq // 3 AS grp, CASE WHEN regexp_matches(website_url, '^https?://') THEN regexp_extract(website_url, '^https?://(?:www\\.)?([^/]+)', 1) END AS site FROM rich),
f AS (SELECT grp, arg_min(id, seq) AS fid, arg_min(email, seq) AS femail, arg_min(phone, seq) AS fphone FROM (SELECT grp, seq, id, coalesce(email, '') AS email, coalesce(phone, '') AS phone FROM m) GROUP BY 1),
c AS (SELECT grp, {_CONFLICTS} AS n, count(site) = count(*) AND min(site) = max(site) AS sd FROM m GROUP BY 1),
s AS (SELECT m.grp, bool_or(m.id <> f.fid AND ((m.email <> '' AND m.email = f.femail) OR (m.phone <> '' AND m.phone = f.fphone))) AS sc FROM m JOIN f USING (grp) GROUP BY 1)
SELECT grp, coalesce(sd, false) AS shared_domain, coalesce(sc, false) AS shared_contact,
  greatest(0, least(100, 70 - 5 * n + CASE WHEN coalesce(sd, false) THEN 10 ELSE 0 END + CASE WHEN coalesce(sc, false) THEN 10 ELSE 0 END)) / 100.0::DOUBLE AS confidence FROM c JOIN s USING (grp)""",
)
def resolution_confidence(spark, sf_dir):
    r = v.rich(spark, sf_dir).withColumn("grp", F.floor(F.col("seq") / 3).cast("long"))
    return rs.resolution_confidence(r, "grp", "seq").select("grp", "shared_domain", "shared_contact", "confidence")


@query(
    "resolved_groups",
    f"""WITH {_FIRMS_SQL}, m AS (SELECT id, name_en, {_BARE} AS bare, website_url, regexp_extract(website_url, '^http://www\\.([^/]+)', 1) AS site, city, id // 4 AS grp FROM firms),
f AS (SELECT grp, min(id) AS fid, arg_min(bare, id) AS fname, arg_min(site, id) AS fsite FROM m GROUP BY 1),
j AS (SELECT m.*, f.fid, (site <> '' AND site = fsite) OR {_match_sql('bare', 'fname')} > 0.85 AS dup FROM m JOIN f USING (grp)),
k AS (SELECT * FROM j WHERE id = fid OR dup)
SELECT grp, min(id) AS id, arg_min(name_en, id) AS name_en, arg_min(website_url, id) FILTER (WHERE website_url <> '') AS website_url FROM k GROUP BY grp HAVING count(*) > 1""",
)
def resolved_groups(spark, sf_dir):
    """Groups of four checked against their first member and merged."""
    m = _firms(spark, sf_dir).withColumn("grp", F.floor(F.col("id") / 4).cast("long"))
    real = rs.verified_members(m, "grp", "id")
    return rs.golden_master(real, "grp", "id", ["name_en", "website_url"]).select("grp", "id", "name_en", "website_url")


@query(
    "rank_candidates",
    f"""WITH {_FIRMS_SQL}, p AS (SELECT id, lower(name_en) AS name, regexp_extract(website_url, '^http://([^/]+)', 1) AS host, {_BARE} AS bare, name_en, linkedin_url FROM firms),
c AS (SELECT a.id AS probe_id, b.id AS candidate_id, a.name_en AS an, b.name_en AS bn, a.bare AS ab, b.bare AS bb, a.host AS ah, b.host AS bh, a.linkedin_url AS al, b.linkedin_url AS bl
  FROM p a JOIN p b ON a.id <> b.id AND ((a.host <> '' AND (a.host = b.host OR ends_with(b.host, '.' || a.host))) OR (a.host = '' AND contains(b.name, a.name)))),
s AS (SELECT *, CASE WHEN ah <> '' AND ah = bh THEN 0.95 WHEN {_match_sql('ab', 'bb')} > 0.85 THEN {_match_sql('ab', 'bb')} ELSE 0 END AS verdict,
  (greatest(length(an), length(bn)) - levenshtein(lower(an), lower(bn)))::DOUBLE / greatest(length(an), length(bn)) AS sim FROM c)
SELECT probe_id, candidate_id, floor(greatest(verdict, sim * 0.8) * 1000 + 0.5) / 1000 AS match_score,
  CASE WHEN greatest(verdict, sim * 0.8) >= 0.9 THEN 'merge' WHEN greatest(verdict, sim * 0.8) >= 0.75 THEN 'review' ELSE 'dismiss' END AS recommended_action FROM s""",
)
def rank_candidates(spark, sf_dir):
    """Candidates of every company, scored."""
    f = _firms(spark, sf_dir)
    out = rs.ranked_candidates(rs.candidates(f, f), f)
    return out.select("probe_id", "candidate_id", "match_score", "recommended_action")
