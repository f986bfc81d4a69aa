"""Duplicate pairs and groups without comparing all rows with all rows.

Equal keys (domain, profile address, name) give a star: every row is paired with
the first row of its key, never with all others.  Similar names are looked for
among distinct names only, by a join on their rarest letter triples that loses no
pair; groups are the connected components of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.functions.semantics import has_value, let_sql, sql_on, trim_blanks
from tradebook.functions.similarity import same_bare_name
from tradebook.operators.keys import top_per_key
from tradebook.session import checkpointed

_Q = 3
_MAX_DISTANCE_SHARE = 0.15  # similarity above .85
_MAX_EXTRA_SHARE = 0.3  # containment ratio above .7
EDGES_PER_TASK = 200_000  # about, in a round of components


# --- pairs -------------------------------------------------------------------------------------


def star_pairs(df: DataFrame, key: str, reason: Column, confidence: float) -> DataFrame:
    """(src, dst, reason, confidence): each row of a key with the first one of it."""
    rows = df.where(F.col(key).isNotNull() & (F.col(key) != "")).select("id", key)
    firsts = checkpointed(rows.groupBy(key).agg(F.min("id").alias("src")))  # written, so that a hot key's join can be split
    return rows.join(firsts, key).where("id <> src").select(
        "src", F.col("id").alias("dst"), reason.alias("reason"), F.lit(confidence).alias("confidence")
    )


def _grams(name: Column) -> Column:
    """Triples of a name, the k-th repetition of a triple told from the first."""
    numbered = "transform(g, (t, i) -> concat(t, size(filter(slice(g, 1, i + 1), h -> h = t))))"
    return sql_on(
        name, "n",
        let_sql(
            f"transform(sequence(1, greatest(length(n) - {_Q - 1}, 1)), i -> substring(n, i, {_Q}))", "g",
            f"CASE WHEN size(array_distinct(g)) = size(g) THEN transform(g, t -> concat(t, '1')) ELSE {numbered} END",
        ),
    )


def similar_names(names: DataFrame, block: str | None = None) -> DataFrame:
    """(a, b, confidence) for distinct names a < b that match by containment or edit distance.

    ``names`` has a column ``name`` (legal words off) and, if given, a ``block``
    column both names must share.  Names are compared only where they share one of
    their rarest triples.  With triples ordered by rarity, two names within edit
    distance d share a triple among their first 3d+1, and a name contained in
    another shares one within the first ones that the other has in excess, so no
    matching pair is missed; frequent triples are looked at only in names that
    consist of nothing else.
    """
    blocks = [block] if block else []
    distinct = names.where("name <> ''").select(*blocks, "name").distinct()
    grams = distinct.select(*blocks, "name", F.explode(_grams(F.col("name"))).alias("gram"))
    weight = grams.groupBy("gram").agg(F.count("*").alias("df"))
    # the longest partner allowed by the distance bound sets the number of edits
    edits = F.floor(F.length("name") * (_MAX_DISTANCE_SHARE / (1 - _MAX_DISTANCE_SHARE)) + 1e-9)
    extra = F.floor(F.length("name") * _MAX_EXTRA_SHARE + 1e-9)
    need = F.greatest(_Q * edits, extra) + 1
    # the few triples of one name, rarest first
    ordered = grams.join(weight, "gram").groupBy(*blocks, "name").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("_g"))
    prefix = ordered.select(
        *blocks, "name", F.transform(F.slice("_g", F.lit(1), need.cast("int")), lambda g: g["gram"]).alias("rare")
    )
    left = prefix.select(*blocks, F.col("name").alias("a"), F.col("rare").alias("rare_a"), F.explode("rare").alias("gram"))
    right = prefix.select(*blocks, F.col("name").alias("b"), F.col("rare").alias("rare_b"), F.explode("rare").alias("gram"))
    sizes = "least(length(a), length(b)) > greatest(length(a), length(b)) * %s" % (1 - _MAX_EXTRA_SHARE)
    # a pair that shares several triples is looked at for the rarest one only
    once = "array_intersect(rare_a, rare_b)[0] = gram"
    alike = (
        "(contains(a, b) OR contains(b, a) OR "
        f"levenshtein(a, b, cast(floor(greatest(length(a), length(b)) * {_MAX_DISTANCE_SHARE}) AS int)) >= 0)"
    )
    pairs = left.join(right, [*blocks, "gram"]).where(F.expr(f"a < b AND {sizes} AND {alike} AND {once}"))
    # exploded, so that the score is worked out for the pairs that are left and not pushed down into the join
    score = F.explode(F.filter(F.array(same_bare_name(F.col("a"), F.col("b"))), lambda m: m["is_match"]))
    return pairs.select(*blocks, "a", "b", score.alias("_s")).select(*blocks, "a", "b", F.col("_s.confidence").alias("confidence"))


def duplicate_pairs(companies: DataFrame) -> DataFrame:
    """(src, dst, reason, confidence) for id, name_en, website_url, linkedin_url, city.

    Same domain .95; same profile address .9; similar name (match above .7) in the
    same city, match * .85; same name elsewhere, .95 * .7.
    """
    keyed = checkpointed(
        companies.select(
            "id",
            urls.domain(F.col("website_url")).alias("domain"),
            urls.canonical_url(F.when(F.col("linkedin_url") != "", F.col("linkedin_url"))).alias("linkedin"),
            tx.bare_name(F.col("name_en")).alias("name"),
            F.when(has_value(F.col("city")), F.lower("city")).alias("city"),
        )
    )
    # every exact rule in one table of (rule, key, id): one grouping, one join
    rules = F.array(
        F.struct(F.lit(0.95).alias("confidence"), F.concat(F.lit("Same domain: "), F.col("domain")).alias("key")),
        F.struct(F.lit(0.9).alias("confidence"), F.concat(F.lit("Same LinkedIn URL: "), F.col("linkedin")).alias("key")),
        F.struct(
            F.lit(0.95 * 0.85).alias("confidence"),
            F.when(F.col("name") != "", F.concat(F.lit("Similar name (95%) + same city: "), "name", F.lit(", "), "city")).alias("key"),
        ),
        F.struct(
            F.lit(0.95 * 0.7).alias("confidence"),
            F.when(F.col("name") != "", F.concat(F.lit("Very similar name (95%): "), "name")).alias("key"),
        ),
    )
    in_city = keyed.where("name <> '' and city is not null").groupBy("name", "city").agg(F.min("id").alias("first"))
    rows = keyed.select("id", F.explode(rules).alias("_r")).select("id", "_r.key", "_r.confidence").where("key is not null")
    firsts = checkpointed(rows.groupBy("confidence", "key").agg(F.min("id").alias("src")))
    exact = rows.join(firsts, ["confidence", "key"]).where("id <> src").select(
        "src", F.col("id").alias("dst"), F.col("key").alias("reason"), "confidence"
    )
    percent = F.format_string("%.0f", F.col("confidence") * 100)
    near = similar_names(in_city.select("name", "city"), "city").where("confidence > 0.7")
    similar = (
        near.join(in_city.select("city", F.col("name").alias("a"), F.col("first").alias("_a")), ["city", "a"])
        .join(in_city.select("city", F.col("name").alias("b"), F.col("first").alias("_b")), ["city", "b"])
        .select(
            F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"),
            F.concat(F.lit("Similar name ("), percent, F.lit("%) + same city: "), "city").alias("reason"),
            (F.col("confidence") * 0.85).alias("confidence"),
        )
    )
    every = exact.unionByName(similar)
    # a pair found by several rules keeps its strongest one
    best = every.groupBy("src", "dst").agg(F.max(F.struct("confidence", "reason")).alias("_m"))
    return best.select("src", "dst", "_m.reason", "_m.confidence")


# --- groups ------------------------------------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of an edge table (src, dst); the component is its smallest id.

    Alternates large-star and small-star steps: the first ties every larger
    neighbour to a row's smallest neighbour, the second does so for smaller ones.
    Each step is a grouped minimum and a join, edges only ever shrink towards one
    star per component, and every round is cut off in the checkpoint folder.  A step
    runs in as many tasks as its edges need, not one per shuffle partition: rounds
    over a few edges would else be thousands of empty tasks and files.
    """
    e = checkpointed(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    )
    seen = _fingerprint(e)
    for _ in range(max_rounds):
        tasks = _tasks(seen[0])
        e = checkpointed(_small_star(_large_star(e.coalesce(tasks), tasks), tasks))
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    e = e.coalesce(_tasks(seen[0]))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _tasks(edges: int) -> int:
    return max(1, -(-edges // EDGES_PER_TASK))


def _large_star(e: DataFrame, tasks: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first: both sides of the join are then plain shuffles, of which Spark splits a hub's rows
    lowest = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")).coalesce(tasks))
    larger = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return larger.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(e: DataFrame, tasks: int) -> DataFrame:
    lowest = checkpointed(e.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
    ties = e.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return ties.unionByName(lowest.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)


def _fingerprint(e: DataFrame) -> tuple:
    # two numbers, whatever the size of the table
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(id, component, size, reason, confidence): members of each group with the group's strongest pair."""
    pairs = checkpointed(pairs)
    members = components(pairs)
    best = (
        pairs.join(members.select(F.col("id").alias("src"), "component"), "src")
        .groupBy("component").agg(F.max(F.struct("confidence", "reason")).alias("_m"))
    )
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    return members.join(sizes.join(best, "component"), "component").select(
        "id", "component", "size", "_m.reason", "_m.confidence"
    )


# --- choosing one of several ---------------------------------------------------------------------------


def most_complete(df: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key: with a website, then e-mail, then phone, then the higher score, then the earlier."""
    have = lambda c: has_value(F.col(c)).cast("int").desc()
    ranking = [have("website_url"), have("email"), have("phone"), F.coalesce("confidence_score", F.lit(0.0)).desc(), F.col(order)]
    return top_per_key(df.where(F.col(key) != ""), [key], ranking)


def most_complete_by_name(df: DataFrame, order: str, source_suffix: str | None = None) -> DataFrame:
    """First by name key (website for nameless ones), then once more by the key without blanks and dashes."""
    name = tx.unicode_name_key(F.coalesce(F.when(F.col("name_en") != "", F.col("name_en")), F.col("name_ar")), source_suffix)
    site = F.lower(trim_blanks(F.coalesce("website_url", F.lit(""))))
    keyed = df.withColumn("_name", name).withColumn(
        "_key", F.when(F.col("_name") != "", F.col("_name")).when(site != "", F.concat(F.lit("|||"), site))
    )
    best = most_complete(keyed, "_key", order)
    strict = best.withColumn("_strict", F.regexp_replace("_key", r"[\s.-]+", ""))
    return most_complete(strict, "_strict", order).drop("_name", "_key", "_strict")


def filled_from_twins(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Empty fields of a record take the value of its best twin under the same key."""
    filled = lambda c: F.when(has_value(F.col(c)), F.col(order))
    twins = df.where(F.col(key) != "").groupBy(key).agg(*[F.min_by(c, filled(c)).alias(f"_t_{c}") for c in fields])
    out = df.join(twins, key, "left")
    return out.withColumns({c: F.when(has_value(F.col(c)), F.col(c)).otherwise(F.col(f"_t_{c}")) for c in fields}).drop(
        *[f"_t_{c}" for c in fields]
    )


def first_by_name_and_site(df: DataFrame, order: str) -> DataFrame:
    """The first record of each (lower-case name, lower-case website)."""
    low = lambda c: F.lower(trim_blanks(F.coalesce(c, F.lit(""))))
    return top_per_key(df, [low("name_en"), low("website_url")], [order])


def duplicates_by_short_name(df: DataFrame, order: str) -> DataFrame:
    """Every record but the first of its shortened name: the delete list."""
    keyed = df.withColumn("_key", tx.short_name_key(F.col("name_en")))
    firsts = keyed.groupBy("_key").agg(F.min(order).alias("_first"))
    return keyed.join(firsts, "_key").where(F.col(order) != F.col("_first")).drop("_key", "_first")


def last_per_match_key(df: DataFrame, order: str) -> DataFrame:
    """The last row of every match key, as an import keeps it."""
    keyed = df.withColumn("_key", tx.match_key(F.col("name_en")))
    return top_per_key(keyed, ["_key"], [F.col(order).desc()]).drop("_key")
