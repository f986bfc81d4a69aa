"""Prefix trie of conversations: ROLLUP over positional columns of turns, a block of columns at a time.

A rebuilt conversation is laid out in rows of ``COLUMNS`` turns: column ``t1`` holds the first turn of the row, and so on.
``GROUP BY block, prior node, ROLLUP (t1, ..., t8)`` then aggregates all prefixes that end in the row together, and
``grouping_id`` tells how many columns a result row stands for.  A longer conversation goes on in a further block of
columns, keyed by the node that the block before ended in.

A node is known by its depth and two numbers of 60 bits, each the sum (modulo 2^60) over its turns of a number drawn from
SHA-256 of the turn's place, role and text.  As the key of a block is a running sum, all blocks are grouped in one job,
however long the longest conversation is, and one conversation that holds a third of all turns is spread over tasks.

Figures of whole subtrees need no walk through the tree, since a conversation is a member of every node on its path:

* a childless node counts once, for its smallest member, so ``n_leaves`` sums a flag over members;
* the smallest member of a node is the smallest member of all deeper nodes of its path, so each conversation owns an end of
  its path, and the bytes of all nodes of a subtree are sums of what its members own;
* ``n_convs`` times bytes, summed over a subtree, is what its members' turns hold from the node on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.llm.common import stored
from tradebook.operators.keys import numbered

COLUMNS = 8  # turns of a row; as many as a head may have
HEADS = 9  # a head has crc32 of the id modulo this many turns
FAMILY = 5  # conversations c - c % 5 lend the head
_RING = 1 << 60
_IDS_A_CHUNK = 4096
_SLOTS = [f"t{k}" for k in range(1, COLUMNS + 1)]
_TURN = "struct<a:long,b:long,size:long>"
_NODE = ["depth", "ka", "kb"]


def _draw(text: Column, name: str) -> list[Column]:
    """Two numbers of 60 bits from SHA-256 of a text."""
    sha = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(sha, at, 15), 16, 10).cast("long").alias(f"{name}{c}") for at, c in ((1, "a"), (16, "b"))]


def _ring(column: Column) -> Column:
    return F.pmod(column, F.lit(_RING))


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def _numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, a, b, size): turns in order, their digest and the bytes of their texts; no texts from here on."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the length of the role before it: no two turns give one string
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *_draw(named, ""),
        F.octet_length(text).cast("long").alias("size"),
    )
    return numbered(rows, ["turn", "a", "b", "size"], ["conv_id"], "i").drop("turn")


def _rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, len, pos, a, b, size): rebuilt conversations; one without turns has a row whose ``pos`` is null."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    few = turns.where(F.col("i") <= COLUMNS).groupBy("conv_id")  # at most COLUMNS rows of each
    heads = few.agg(F.array_sort(F.collect_list(F.struct("i", "a", "b", "size"))).alias("head")).withColumnRenamed("conv_id", "base")
    asked = counts.withColumns({"h": head_turns(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    lent = F.slice(F.coalesce("head", F.array().cast("array<struct<i:long,a:long,b:long,size:long>>")), F.lit(1), F.col("h"))
    per = asked.join(heads, "base", "left").withColumn("head", lent).withColumn("k", F.size("head"))
    per = per.withColumn("len", (F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long"))
    per = stored(per.select("conv_id", "h", "k", "len", "head"), "trie-heads")
    head = per.select("conv_id", "len", F.explode("head").alias("t")).select(
        "conv_id", "len", F.col("t.i").alias("pos"), "t.a", "t.b", "t.size"
    )
    own = turns.where(F.col("i") > head_turns(F.col("conv_id"))).join(per.drop("head"), "conv_id").select(
        "conv_id", "len", (F.col("i") - F.col("h") + F.col("k")).alias("pos"), "a", "b", "size"
    )
    none = per.where("len = 0").selectExpr("conv_id", "len", "cast(null as long) pos", "0L a", "0L b", "0L size")
    placed = F.concat_ws(" ", F.col("pos").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"))
    return head.unionByName(own).unionByName(none).select("conv_id", "len", "pos", *_draw(placed, ""), "size")


def blocks(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, len, pa, pb, pbytes, t1 ... t8): rows of turns, and key and bytes of the prior block's node."""
    rebuilt = _rebuilt(_numbered_turns(conversations)).withColumns(
        {"block": F.coalesce(F.expr(f"(pos - 1) div {COLUMNS}"), F.lit(0).cast("long")), "slot": (F.col("pos") - 1) % COLUMNS}
    )
    cells = [F.max(F.when(F.col("slot") == k, F.struct("a", "b", "size"))).alias(name) for k, name in enumerate(_SLOTS)]
    rows = stored(rebuilt.groupBy("conv_id", "block").agg(F.max("len").alias("len"), *cells), "trie-rows")
    one = rows.where(F.col("len") <= COLUMNS).selectExpr("conv_id", "block", "len", "0L pa", "0L pb", "0L pbytes", *_SLOTS)
    more = rows.where(F.col("len") > COLUMNS)
    sums = {f"s{f}": _in_row(f).cast("decimal(20,0)") for f in ("a", "b", "size")}
    ran = numbered(more.select("conv_id", "block", *_SLOTS), ["block"], ["conv_id"], "_i", sums)
    before = {f: F.col(f"s{f}") - _in_row(f) for f in ("a", "b", "size")}
    on = ran.select("conv_id", "block", (before["a"] % _RING).cast("long").alias("pa"), (before["b"] % _RING).cast("long").alias("pb"), before["size"].cast("long").alias("pbytes"))
    long = more.join(on, ["conv_id", "block"]).select(*one.columns)
    return one.unionByName(long)


def _in_row(field: str, upto: int = COLUMNS) -> Column:
    """Sum of a field over the turns of a row; eight numbers of 60 bits fit a long."""
    total = F.lit(0).cast("long")
    for name in _SLOTS[:upto]:
        total = total + F.coalesce(F.col(name)[field], F.lit(0).cast("long"))
    return total


def _rolled(rows: DataFrame, figures: str) -> DataFrame:
    """A row per node: depth, key, the parent's key, bytes of its last text and of those before, and the figures of its members."""
    fixed = ["block", "pa", "pb", "pbytes"]
    columns = ", ".join(_SLOTS)
    grouped = rows.sparkSession.sql(
        f"SELECT {', '.join(fixed)}, {columns}, grouping_id() AS g, {figures} FROM {{rows}} GROUP BY {', '.join(fixed)}, ROLLUP ({columns})", rows=rows
    )
    level = F.lit(COLUMNS) - F.bit_count("g")
    last = F.element_at(F.array(*_SLOTS), F.when(F.col("d") > 0, F.col("d")))
    nodes = grouped.withColumn("d", level.cast("int")).withColumn("last", last)
    # a null column is a conversation that ended before it; the key alone is a node of the prior block, but for the root
    nodes = nodes.where("last is not null or (d = 0 and block = 0)")
    last_of = {f: F.coalesce(F.col("last")[f], F.lit(0).cast("long")) for f in ("a", "b", "size")}
    key = {f: _ring(_ring(_in_row(f)) + F.col(f"p{f}")) for f in ("a", "b")}
    return nodes.select(
        (F.col("block") * COLUMNS + F.col("d")).alias("depth"), key["a"].alias("ka"), key["b"].alias("kb"),
        _ring(key["a"] - last_of["a"]).alias("up_a"), _ring(key["b"] - last_of["b"]).alias("up_b"),
        last_of["size"].alias("size"), (F.col("pbytes") + _in_row("size") - last_of["size"]).alias("before"),
        *[c for c in grouped.columns if c not in (*fixed, *_SLOTS, "g")],
    )


def _ends_sha256(ends: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256) of the nodes where conversations end.

    The ids are sorted over all tasks and joined by up to 4096, also those of one node; SHA-256 then takes the pieces of a
    node one after the other, a piece at a time in memory.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def made() -> pa.RecordBatch:
            row = (*node, ids[0], ",".join(map(str, ids)))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], [*_NODE, "first", "ids"])

        for b in batches:
            for *at, c in zip(*(b.column(n).to_pylist() for n in (*_NODE, "conv_id")), strict=True):
                if node is not None and (at != node or len(ids) == _IDS_A_CHUNK):
                    yield made()
                    ids = []
                node = at
                ids.append(c)
        if ids:
            yield made()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def made(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*_NODE, "ends_sha256"])

        for b in batches:
            rows = []
            for *at, ids in zip(*(b.column(n).to_pylist() for n in (*_NODE, "ids")), strict=True):
                if at == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = at, hashlib.sha256()
                sha.update(ids.encode())
            if rows:
                yield made(rows)
        if node is not None:
            yield made([(*node, sha.hexdigest())])

    by = [*_NODE, "conv_id"]
    sorted_ids = ends.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    chunks = sorted_ids.mapInArrow(pieces, "depth long, ka long, kb long, first long, ids string")
    return chunks.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digests, "depth long, ka long, kb long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row per distinct sequence of first turns of the rebuilt conversations, the root included.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` the parent's ``conv_id`` (root:
    null), ``n_convs`` its members, ``n_children`` its children, ``n_leaves`` the childless nodes of its subtree,
    ``saved_tokens`` the sum over its subtree of (members - 1) times the bytes of a node's last text, ``ends_sha256`` the
    digest of the ids that end here.  ``conversations`` has conv_id, turn, role and text; other columns are ignored.

    Rows without conv_id belong to no conversation.  Null turns come first; rows of one turn are in the order of a digest
    of role and text, so repeated rows are turns of their own and reruns agree.  No rows give no node, not even a root.
    """
    rows = stored(blocks(conversations), "trie-blocks")
    nodes = stored(_rolled(rows, "min(conv_id) AS conv_id, count(*) AS n_convs"), "trie-nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("ka"), F.col("up_b").alias("kb")]
    children = stored(nodes.where("depth > 0").select(*up).groupBy(*_NODE).agg(F.count("*").alias("n_children")), "trie-children")

    ends = stored(
        rows.where(F.col("block") == F.greatest(F.lit(0), F.expr(f"(len - 1) div {COLUMNS}"))).select(
            "conv_id", F.col("len").alias("depth"), *[_ring(_ring(_in_row(f)) + F.col(f"p{f}")).alias(f"k{f}") for f in ("a", "b")],
            (F.col("pbytes") + _in_row("size")).alias("total"),
        ),
        "trie-ends",
    )
    owned = nodes.groupBy("conv_id").agg(F.sum("size").alias("owned"))
    # the smallest member of a childless node ends there, so no conversation is named twice
    leaves = nodes.join(children, _NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    facts = ends.select("conv_id", "total").join(owned, "conv_id", "left").join(leaves, "conv_id", "left").na.fill(0)
    facts = stored(facts, "trie-facts")  # so that a conversation of many rows can be split in the join

    figures = """min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(total) AS totals, sum(owned) AS owneds,
      min_by(total, conv_id) AS own_total, min_by(owned, conv_id) AS own_owned"""
    summed = stored(_rolled(rows.drop("len").join(facts, "conv_id"), figures), "trie-figures")
    # members' bytes from the node on, less those of every node of the subtree once
    saved = (F.col("totals") - F.col("n_convs") * F.col("before")) - (F.col("owneds") - F.col("own_owned") + F.col("own_total") - F.col("before"))
    parents = nodes.select(F.col("depth").alias("p_depth"), F.col("ka").alias("p_a"), F.col("kb").alias("p_b"), F.col("conv_id").alias("parent_conv_id"))
    at_parent = (F.col("depth") == F.col("p_depth") + 1) & (F.col("up_a") == F.col("p_a")) & (F.col("up_b") == F.col("p_b"))
    sha = stored(_ends_sha256(ends), "trie-digests")
    whole = summed.join(children, _NODE, "left").join(sha, _NODE, "left").join(parents, at_parent, "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
