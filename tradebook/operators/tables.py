"""Table changes as joins: upserts, partial updates, deletes, lookups, key rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.functions.semantics import blank_to_null, first_truthy, let, trim_blanks
from tradebook.operators.keys import numbered, top_per_key
from tradebook.session import checkpointed

# --- reading ----------------------------------------------------------------------------------------


def condition(column: str, op: str, value) -> Column:
    """One filter of a (field, op, value) list."""
    c = F.col(column)
    if op == "array-contains":
        wanted = value if isinstance(value, list) else [value]
        return F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), c)) == 0
    if op == "array-contains-any":
        return F.arrays_overlap(c, F.array(*[F.lit(x) for x in value]))
    simple = {
        "==": lambda: c == value, "!=": lambda: c != value, ">": lambda: c > value, ">=": lambda: c >= value,
        "<": lambda: c < value, "<=": lambda: c <= value, "in": lambda: c.isin(*value), "not-in": lambda: ~c.isin(*value),
        "like": lambda: c.like(value), "is-blank": lambda: c.isNull() | (c == ""),
        "contains": lambda: c.ilike(f"%{_escape_like(value)}%"),
    }
    return simple[op]()


def _escape_like(value: str) -> str:
    return value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def select_rows(
    df: DataFrame, filters: Sequence[tuple] = (), order_by: str | None = None, descending: bool = False,
    limit: int | None = None, offset: int = 0, tie: str | None = None,
) -> DataFrame:
    """Filters, order, offset and limit, as one plan Spark can push into the scan."""
    for f in filters:
        df = df.where(condition(*f))
    if order_by:
        first = F.col(order_by).desc_nulls_first() if descending else F.col(order_by).asc_nulls_last()
        df = df.orderBy(first, *([tie] if tie else []))
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit else df


def sort_for_export(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Locale order for texts, value order for numbers; other types keep their order."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StringType):
        key = F.collate(F.col(column), "UNICODE")
    elif isinstance(dtype, T.NumericType):
        key = F.col(column)
    else:
        return df
    return df.orderBy(key.desc() if descending else key.asc())


# --- changing -----------------------------------------------------------------------------------------


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``updates`` replace those of ``target`` with the same key; the rest is kept."""
    kept = target.join(updates.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True).select(*target.columns)


def partial_update(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only columns supplied in ``changes`` and not null there are written."""
    columns = [c for c in changes.columns if c not in keys and c in target.columns]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = target.join(new, list(keys), "left")
    return out.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns]
    )


def upsert_keep_old(target: DataFrame, updates: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Upsert in which the columns ``keep`` hold their old value when the new one is empty."""
    fields = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.lit(1).alias("_t"), *[F.col(c).alias(f"_old_{c}") for c in fields])
    u = updates.select(*keys, F.lit(1).alias("_u"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = t.join(u, list(keys), "full_outer")
    def pick(c: str) -> Column:
        new = blank_to_null(F.col(f"_new_{c}")) if c in keep else F.col(f"_new_{c}")
        merged = F.coalesce(new, F.col(f"_old_{c}")) if c in keep else new
        return F.when(F.col("_u").isNull(), F.col(f"_old_{c}")).otherwise(merged).alias(c)

    return both.select(*keys, *[pick(c) for c in fields]).select(*target.columns)


def insert_absent(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the target lacks are added, others ignored; one row per key."""
    fresh = rows.join(target.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))
    return target.unionByName(fresh, allowMissingColumns=True)


def delete_rows(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(doomed.select(*keys), list(keys), "left_anti")


def with_generated_key(rows: DataFrame, parts: Sequence[str], name: str = "id") -> DataFrame:
    """Deterministic key from the row's own values, so that a rerun gives the same one."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("∅")) for p in parts])
    return rows.withColumn(name, F.sha2(text, 256))


def repair_unique(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows (id, name_en, slug) made storable: a known name takes the stored row's id, a used slug gets the id.

    A slug clash with another row strips the slug's numeric tail and appends the id.
    """
    key = lambda c: F.lower(trim_blanks(F.col(c)))
    # both minima are written, so that the join of a hot name or slug can be split
    by_name = checkpointed(stored.groupBy(key("name_en").alias("_key")).agg(F.min("id").alias("_stored_id")).where("_key <> ''"))
    named = (
        incoming.withColumn("_key", key("name_en")).join(by_name, "_key", "left")
        .withColumn("id", F.coalesce("_stored_id", "id")).drop("_key", "_stored_id")
    )
    owners = stored.select("slug", F.col("id").alias("_owner")).unionByName(named.select("slug", F.col("id").alias("_owner")))
    # every slug belongs to its stored holder, else to the first incoming one
    owner = checkpointed(
        owners.where("slug <> ''").groupBy("slug").agg(F.min("_owner").alias("_any"))
        .join(stored.groupBy("slug").agg(F.min("id").alias("_held")), "slug", "left")
        .select("slug", F.coalesce("_held", "_any").alias("_owner"))
    )
    out = named.join(owner, "slug", "left")
    own_slug = F.concat(F.regexp_replace("slug", r"-\d+$", ""), F.lit("-"), F.col("id").cast("string"))
    clash = F.col("_owner").isNotNull() & (F.col("_owner") != F.col("id"))
    return out.withColumn("slug", F.when(clash, own_slug).otherwise(F.col("slug"))).select(*incoming.columns)


# --- matching new records against stored ones -----------------------------------------------------------


def _keyed(df: DataFrame, payload: Sequence[str], fallback_source: Column | None = None) -> DataFrame:
    """(payload, _name, kind, key) rows of the non-empty keys; narrow, so that the join shuffles keys only."""
    source = F.col("source_url") if fallback_source is None else first_truthy(F.col("source_url"), fallback_source)
    name = tx.match_key(first_truthy(F.col("name_en"), F.col("name_ar")))
    rows = df.select(
        *payload,
        name.alias("_name"),
        F.explode(
            F.array(
                F.struct(F.lit("w").alias("kind"), urls.comparable_url(F.col("website_url")).alias("key")),
                F.struct(F.lit("s").alias("kind"), urls.comparable_url(source).alias("key")),
                F.struct(F.lit("n").alias("kind"), name.alias("key")),
            )
        ).alias("_k"),
    )
    return rows.select(*payload, "_name", "_k.kind", "_k.key").where("key <> ''")


def identity_rows(df: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(payload, kind, key): the keys by which a record is matched, website, source and name; empty keys are left out."""
    return _keyed(df, payload).drop("_name")


def identity_key(fallback_source: Column | None = None) -> Column:
    """Key under which records of one batch count as the same: website, else name and source, else source."""
    source = F.col("source_url") if fallback_source is None else first_truthy(F.col("source_url"), fallback_source)
    keys = F.struct(
        urls.comparable_url(F.col("website_url")).alias("website"),
        urls.comparable_url(source).alias("source"),
        tx.match_key(first_truthy(F.col("name_en"), F.col("name_ar"))).alias("name"),
    )
    return let(
        keys,
        lambda k: F.when(k["website"] != "", F.concat(F.lit("website:"), k["website"]))
        .when(k["name"] != "", F.concat(F.lit("name:"), k["name"], F.lit("|source:"), k["source"]))
        .when(k["source"] != "", F.concat(F.lit("source:"), k["source"])),
    )


def first_per_identity(df: DataFrame, order: str, fallback_source: Column | None = None) -> DataFrame:
    """In-batch deduplication, with the key kept as ``identity``; rows without any key are dropped.

    The key is exploded out of an array of at most one element, so the filter on
    it does not work it out a second time.
    """
    keyed = df.withColumn("identity", F.explode(F.array_compact(F.array(identity_key(fallback_source)))))
    return top_per_key(keyed, ["identity"], [order])


def match_existing(new: DataFrame, stored: DataFrame, order: str, fallback_source: Column | None = None) -> DataFrame:
    """(id, existing_id, rule) of the new records that are stored already.

    Order of the rules: same website; same source and name; same name; same source
    when the record has no name.  Per key the last stored row (by ``order``) counts.
    Both sides are cut to (kind, key, id) before the one join; the stored side is
    written, so that a key which many new records share can be split.  The join is
    asked to be a shuffled one: Spark sizes exploded keys too low and would send
    those of all records to the driver.
    """
    s = checkpointed(
        _keyed(stored, list(dict.fromkeys(["id", order]))).groupBy("kind", "key").agg(F.max_by(F.struct("id", "_name"), order).alias("hit"))
    )
    n = _keyed(new, ["id"], fallback_source)
    prio = (
        F.when(F.col("kind") == "w", 1)
        .when((F.col("kind") == "s") & (F.col("_name") != "") & (F.col("hit._name") == F.col("_name")), 2)
        .when(F.col("kind") == "n", 3)
        .when((F.col("kind") == "s") & (F.col("_name") == ""), 4)
    )
    hits = n.join(s.hint("merge"), ["kind", "key"]).withColumn("rule", prio).where("rule is not null")
    return hits.groupBy("id").agg(F.min_by("hit.id", "rule").alias("existing_id"), F.min("rule").alias("rule"))


def seen_marks(new: DataFrame, stored: DataFrame, matches: DataFrame, as_of: Column) -> DataFrame:
    """Adds existing_id, first_seen_at (kept), last_seen_at (renewed) and the action label."""
    first = stored.select(F.col("id").alias("existing_id"), F.col("first_seen_at").alias("_first"))
    out = new.join(matches.select("id", "existing_id"), "id", "left").join(first, "existing_id", "left")
    return out.withColumns(
        {
            "first_seen_at": F.coalesce("_first", as_of),
            "last_seen_at": as_of,
            "action": F.when(F.col("existing_id").isNull(), "created").otherwise("updated"),
        }
    ).drop("_first")


def sync_plan(rows: DataFrame, stored: DataFrame, name: str = "name_en") -> DataFrame:
    """(action, n): how many rows would update and how many insert, last row per match key."""
    keyed = rows.withColumn("_key", tx.match_key(F.col(name))).select("_key").where("_key <> ''").distinct()
    known = stored.select(tx.match_key(F.col(name)).alias("_key"), F.lit(1).alias("_hit")).distinct()
    return (
        keyed.join(known, "_key", "left")
        .groupBy(F.when(F.col("_hit") == 1, "update").otherwise("insert").alias("action"))
        .agg(F.count("*").alias("n"))
    )


# --- key rewrites --------------------------------------------------------------------------------------------


def remap(df: DataFrame, column: str, id_map: DataFrame) -> DataFrame:
    """A foreign key rewritten through (old_id, new_id); unknown values stay."""
    out = df.join(id_map.select(F.col("old_id").alias(column), F.col("new_id").alias("_new")), column, "left")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def remap_items(df: DataFrame, key: str, column: str, id_map: DataFrame) -> DataFrame:
    """Array elements rewritten through the map, as (key, pos, item) rows in their old order."""
    rows = df.select(key, F.posexplode(column).alias("pos", "_item"))
    out = rows.join(id_map.select(F.col("old_id").alias("_item"), F.col("new_id").alias("_new")), "_item", "left")
    return out.select(key, "pos", F.coalesce("_new", "_item").alias("item"))


def renumber(df: DataFrame, order: Sequence, first: int, name: str) -> DataFrame:
    """Consecutive numbers from ``first`` in the given total order."""
    return numbered(df, order, (), "_rn").withColumn(name, F.col("_rn") + (first - 1)).drop("_rn")


def continue_ids(df: DataFrame, id_col: str, order: Sequence) -> DataFrame:
    """Rows without an id get the numbers after the largest one in use."""
    top = df.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    fresh = numbered(df.where(F.col(id_col).isNull()), order, (), "_rn")
    # one row of one number
    given = fresh.crossJoin(F.broadcast(top)).withColumn(id_col, F.col("_top") + F.col("_rn")).select(*df.columns)
    return df.where(F.col(id_col).isNotNull()).unionByName(given)


def reserve_ids(rows: DataFrame, taken: DataFrame, order: Sequence, name: str = "id", floor: int = 100_000) -> DataFrame:
    """Ids for new rows after the largest numeric id in use."""
    top = taken.agg(F.greatest(F.coalesce(F.max(F.col("id").try_cast("long")), F.lit(floor)), F.lit(floor)).alias("_top"))
    out = numbered(rows, order, (), "_rn").crossJoin(F.broadcast(top))
    return out.withColumn(name, F.col("_top") + F.col("_rn")).drop("_rn", "_top")


def keep_or_reserve(rows: DataFrame, taken: DataFrame, proposed: str, order: Sequence[str], floor: int = 100_000) -> DataFrame:
    """A free proposed id is kept by its first proposer; all other rows get the ids after the largest in use."""
    used = taken.select(F.col("id").try_cast("long").alias("_p")).where("_p is not null").distinct()
    wanted = rows.withColumn("_p", F.col(proposed).try_cast("long"))
    free = wanted.where("_p is not null").join(used, "_p", "left_anti")
    winners = top_per_key(free, ["_p"], list(order))
    rest = wanted.join(winners.select(*order), list(order), "left_anti")
    top = used.unionByName(winners.select("_p")).agg(F.greatest(F.coalesce(F.max("_p"), F.lit(floor)), F.lit(floor)).alias("_top"))
    given = numbered(rest, order, (), "_rn").crossJoin(F.broadcast(top)).withColumn("new_id", F.col("_top") + F.col("_rn"))
    return winners.withColumn("new_id", F.col("_p")).select(*rows.columns, "new_id").unionByName(
        given.select(*rows.columns, "new_id")
    )


def restore_ids(backup: DataFrame, stored: DataFrame) -> DataFrame:
    """(old_id, new_id) for backup rows: the stored id of the same name, else the same id, else their own."""
    by_name = stored.where("name_en <> ''").groupBy(F.lower("name_en").alias("_key")).agg(F.min("id").alias("_named"))
    by_id = stored.select(F.col("id").alias("_same")).distinct()
    out = backup.withColumn("_key", F.lower("name_en")).join(by_name, "_key", "left")
    out = out.join(by_id, F.col("id") == F.col("_same"), "left")
    return out.select(F.col("id").alias("old_id"), F.coalesce("_named", "_same", "id").alias("new_id"))


def names_or_default(rows: DataFrame, dimension: DataFrame, key: str, name: str, default: Column) -> DataFrame:
    """Name of a referenced row, else the default."""
    d = dimension.select(F.col("id").alias(key), F.col(name).alias("_name"))
    return rows.join(d, key, "left").withColumn(name, F.coalesce("_name", default)).drop("_name")


# --- contacts --------------------------------------------------------------------------------------------------


def contacts_of(df: DataFrame, source_url: Column | None = None) -> DataFrame:
    """Up to four contact rows per company, those without any address left out."""
    def entry(kind: str, email: str, phone: str | None = None, whatsapp: str | None = None) -> Column:
        pick = lambda c: F.col(c) if c else F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("contact_type"), pick(email).alias("email"), pick(phone).alias("phone"), pick(whatsapp).alias("whatsapp")
        )

    entries = F.array(
        entry("general", "email", "phone", "whatsapp"), entry("general", "contact_email"),
        entry("sales", "sales_email"), entry("procurement", "procurement_email"),
    )
    rows = df.select(F.col("id").alias("company_id"), F.explode(entries).alias("_e")).select("company_id", "_e.*")
    return rows.where(F.coalesce(*[blank_to_null(F.col(c)) for c in ("email", "phone", "whatsapp")]).isNotNull()).withColumns(
        {"source_url": source_url if source_url is not None else F.lit(None).cast("string"), "verified": F.lit(False)}
    )


def contacts_missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted contact rows that are not stored; null and '' count as the same."""
    keys = ["contact_type", "email", "phone", "whatsapp"]
    norm = lambda df: df.withColumns({f"_{k}": F.coalesce(k, F.lit("")) for k in keys})
    on = ["company_id", *[f"_{k}" for k in keys]]
    return norm(wanted).join(norm(stored).select(*on), on, "left_anti").select(*wanted.columns)
