"""The operators as named queries over the driver's tables, each beside its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.llm import (
    bloom_lm, crf_extract, fm_quality, golay_dedup, line_quality, pattern_grammar, prefix_trie, qgram_decontam, source_mix, token_binary, token_counts,
    warc_normal, whitening,
)
from tradebook.llm.common import table

QUERIES: dict = {}
TWINS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return keep


WORDS_SQL = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
BARE_SQL = "regexp_replace({t}, '[\\x20\\x09-\\x0D]', '', 'g')"


def _marks(t: str, marks: str) -> str:
    return f"(length({t}) - length(translate({t}, '{marks}', '')))"


_LINE_WORDS = f"len({WORDS_SQL.format(t='l')})"
_SEP, _SYM = _marks("l", line_quality.SEPARATORS), _marks("l", line_quality.SYMBOLS)
_BANGS = "(length(l) - length(replace(l, '!!', '!')))"
LINE_FAILS_SQL = f"""(({_SEP} >= 3 AND {_SEP} * 6 >= {_LINE_WORDS}) OR ({_SYM} >= 3 AND {_SYM} * 3 >= {_LINE_WORDS})
  OR ({_BANGS} >= 3 AND {_BANGS} * 3 >= {_LINE_WORDS})
  OR ({_LINE_WORDS} <= {line_quality.BOILERPLATE_WORDS} AND regexp_matches(l, '{line_quality.BOILERPLATE}'))
  OR regexp_matches(l, '{line_quality.CODE_END}'))"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL.format(t='text')} AS w, string_split(coalesce(text, ''), chr(10)) AS ls
  FROM documents),
starts AS (SELECT doc_id, w, unnest(range(len(w) - 4)) AS p FROM d WHERE len(w) >= 5),
wins AS (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS win FROM starts),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(ls) AS l FROM d),
kept_lines AS (SELECT DISTINCT doc_id, l FROM lines WHERE NOT {LINE_FAILS_SQL}),
kc AS (SELECT doc_id, sum(length({BARE_SQL.format(t='l')})) AS kept_chars FROM kept_lines GROUP BY doc_id),
c AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length({BARE_SQL.format(t='t')})::BIGINT AS word_chars,
    {_marks('t', line_quality.SYMBOLS)}::BIGINT AS n_symbols,
    (len(list_filter(ls, lambda l: {BARE_SQL.format(t='l')} <> '')) -
      len(list_distinct(list_filter(ls, lambda l: {BARE_SQL.format(t='l')} <> ''))))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0)::BIGINT AS kept_chars
  FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN kc USING (doc_id))
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (word_chars - kept_chars > 0.5 * word_chars) AS kept FROM c"""


@query("op9_line_quality", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL.format(t='text')})::BIGINT AS size, {BARE_SQL.format(t="coalesce(text, '')")} AS b,
    (('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / CASE WHEN length(b) = 0 THEN 1.0::DOUBLE
    ELSE greatest(length(regexp_replace(b, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE / length(b)::DOUBLE, 0.05::DOUBLE) END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
sw AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 + 1 AS w FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, w, source) AS rk FROM sw),
run AS (SELECT *, sum(3 * source_size) OVER o - 3 * source_size AS held, sum(w) OVER o - w AS gone, sum(source_size) OVER () AS total,
    sum(w) OVER () AS free FROM r WINDOW o AS (ORDER BY rk)),
lv AS (SELECT (total - held)::DOUBLE / (free - gone)::DOUBLE AS lev FROM run
  WHERE (total - held)::DOUBLE / (free - gone)::DOUBLE * w <= 3 * source_size ORDER BY rk LIMIT 1),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, lev * w) AS target,
    CASE WHEN source_size > 0 THEN floor(least((3 * source_size)::DOUBLE, lev * w) / source_size)::BIGINT ELSE 0 END AS epochs
  FROM sw, lv),
j AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS running
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN size > 0 THEN epochs + (running - size / 2.0::DOUBLE <= rest)::BIGINT ELSE 0 END AS copies,
  epochs * size + greatest(0, least(size, floor(rest)::BIGINT - (running - size)))::BIGINT AS taken FROM j"""


@query("op5_source_mix", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f"""


@query("op7_warc_normal", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_normal.archive(spark, table(spark, sf_dir, "pages"))


@query("op2_golay_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_dedup.near_groups(table(spark, sf_dir, "documents"))


@query("op8_crf_extract")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return crf_extract.extract(pages, crf_extract.fitted(pages))


@query("op10_fm_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fm_quality.score(docs, fm_quality.fitted(docs, table(spark, sf_dir, "labels")))


@query("op3_pattern_grammar")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pattern_grammar.score(docs, pattern_grammar.fitted(docs, table(spark, sf_dir, "labels")))


@query("op4_qgram_decontam")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_token_binary")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.round_trip(spark, table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


# crc32 of the decimal id, a bit at a time: each byte is met by eight shifts, the first of which takes it in
_CRC_SQL = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, x: xor(xor(s, x) >> 1, (xor(s, x) & 1) * 3988292384)))"""

OP11_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {_CRC_SQL} % 9 AS h FROM t GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
u AS (SELECT k.conv_id, i AS pos, r, x FROM k JOIN t ON t.conv_id = k.base AND i <= h
  UNION ALL SELECT k.conv_id, i - h + k AS pos, r, x FROM k JOIN t ON t.conv_id = k.conv_id AND i > h),
m AS (SELECT conv_id, pos AS depth, octet_length(encode(x)) AS size,
    sha256(string_agg(sha256(length(r)::VARCHAR || ':' || r || x), ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS node,
    coalesce(sha256(string_agg(sha256(length(r)::VARCHAR || ':' || r || x), ',') OVER (PARTITION BY conv_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS up FROM u
  UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
e AS (SELECT conv_id, max_by(node, depth) AS node FROM m GROUP BY conv_id),
s AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM e GROUP BY node),
n AS (SELECT node, any_value(up) AS up, depth, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM m GROUP BY node, depth),
ch AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (node)),
below AS (SELECT DISTINCT a.node AS top, d.node FROM m a JOIN m d ON a.conv_id = d.conv_id AND a.depth <= d.depth),
g AS (SELECT top AS node, count_if(n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM below JOIN f USING (node) GROUP BY top)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  g.n_leaves::BIGINT AS n_leaves, g.saved::BIGINT AS saved_tokens, coalesce(s.ends_sha256, sha256('')) AS ends_sha256
FROM f JOIN g USING (node) LEFT JOIN s USING (node) LEFT JOIN f p ON p.node = f.up"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_bloom_lm")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.scored(table(spark, sf_dir, "documents"))
