"""Token counts that follow edits: a segment tree of counts per document, re-encoded only where an edit touched it.

The leaves are runs of the text that end behind white space, so the pre-tokens of
a leaf don't reach into the next one and the count of a text is the sum of its
leaves.  A node is the sum of its two children.  An edit re-encodes the leaves it
touches; if the new text of the last one no longer ends behind white space, the
leaf after it is its context and is taken in, and so on.  Then the sums above the
changed leaves are updated; a changed number of leaves rebuilds the nodes from
the kept leaf counts, which needs no encoding.

Kept as a table: a row per document with the lengths of its leaves and the nodes
of its tree.  Edits come as rows of (doc_id, start, end, replacement) and are
gathered per document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.llm import tokenise

LEAF_CHARS = 256  # a leaf ends at the first white space after so many characters
_BORDER = re.compile(r"[ \t-\r]")
Count = Callable[[list[str]], list[int]]
STATE = "doc_id long, leaves array<int>, nodes array<long>"
EDITS = "array<struct<start:int,end:int,replacement:string>>"


def leaves_of(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _BORDER.search(text, at + leaf_chars - 1)
        end = m.end() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


def tree(counts: list[int]) -> list[int]:
    """Nodes of a segment tree: leaf i of n at place n + i, the sum of 2k and 2k + 1 at k, the whole at 1."""
    n = len(counts)
    nodes = [0] * n + counts
    for k in range(n - 1, 0, -1):
        nodes[k] = nodes[2 * k] + nodes[2 * k + 1]
    return nodes


def total(nodes: list[int]) -> int:
    return nodes[1] if len(nodes) > 1 else 0


def build(text: str | None, count: Count, leaf_chars: int = LEAF_CHARS) -> tuple[list[int], list[int]]:
    """(lengths of leaves, nodes) of a text."""
    parts = leaves_of(text or "", leaf_chars)
    return [len(p) for p in parts], tree(count(parts))


def update(
    text: str, lengths: list[int], nodes: list[int], edits: list[tuple[int, int, str]], count: Count, leaf_chars: int = LEAF_CHARS
) -> tuple[str, list[int], list[int], int]:
    """(new text, lengths, nodes, leaves re-encoded) after edits.

    Edits replace [start, end) of the old text; they are sorted here, must not overlap, and places beyond the text are
    its end.  Several insertions at one place go in by the order given.
    """
    edits = sorted(((min(max(s, 0), len(text)), min(max(e, s, 0), len(text)), r) for s, e, r in edits), key=lambda x: x[:2])
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:], strict=False)):
        raise ValueError("edits overlap")
    if not edits:
        return text, lengths, nodes, 0
    n = len(lengths)
    begins = [0]
    for x in lengths:
        begins.append(begins[-1] + x)
    counts = nodes[n:]
    out_text, out_lengths, out_counts = [], [], []
    fresh: list[tuple[int, str]] = []  # place among the new leaves, text
    same_shape: dict[int, int] | None = {}  # old leaf -> place in fresh
    leaf = k = 0

    def keep(upto: int) -> None:
        nonlocal leaf
        if upto > leaf:
            out_text.append(text[begins[leaf] : begins[upto]])
            out_lengths.extend(lengths[leaf:upto])
            out_counts.extend(counts[leaf:upto])
            leaf = upto

    at_leaf = 0
    while k < len(edits):
        while at_leaf < n - 1 and begins[at_leaf + 1] <= edits[k][0]:
            at_leaf += 1
        keep(max(at_leaf, leaf))
        # the region: leaves from here on until no edit reaches further and it ends behind white space
        first, at, pieces, last = leaf, begins[leaf] if n else 0, [], leaf
        while True:
            stop = begins[min(last + 1, n)]
            while k < len(edits) and (edits[k][0] < stop or last >= n - 1):
                s, e, r = edits[k]
                pieces += [text[at:s], r]
                at, k = e, k + 1
                while last < n - 1 and begins[last + 1] < at:
                    last += 1
                stop = begins[min(last + 1, n)]
            pieces.append(text[at:stop])
            at = stop
            ended = next((p[-1] for p in reversed(pieces) if p), " ")
            if last >= n - 1 or _BORDER.match(ended):
                break
            last += 1
        region = "".join(pieces)
        # a leaf may grow to twice the usual before it is cut
        parts = [region] if last == first and 0 < len(region) <= 2 * leaf_chars else leaves_of(region, leaf_chars)
        if last == first and len(parts) == 1 and same_shape is not None:
            same_shape[first] = len(fresh)
        else:
            same_shape = None
        for p in parts:
            fresh.append((len(out_lengths), p))
            out_text.append(p)
            out_lengths.append(len(p))
            out_counts.append(0)
        leaf = min(last + 1, n)
        at_leaf = min(leaf, max(n - 1, 0))
    keep(n)
    for (place, _), c in zip(fresh, count([p for _, p in fresh]), strict=True):
        out_counts[place] = c
    if same_shape is not None and len(out_lengths) == n:
        nodes = list(nodes)
        for place, _ in fresh:  # the way up from each changed leaf
            i, change = n + place, out_counts[place] - nodes[n + place]
            while i:
                nodes[i] += change
                i //= 2
        if n == 1:
            nodes[0] = 0
    else:
        nodes = tree(out_counts)
    return "".join(out_text), out_lengths, nodes, len(fresh)


def _counter(vocabulary: str) -> Count:
    words = tokenise.words(vocabulary)
    return lambda parts: [len(x) // 4 for x in words.encode(parts)]


def build_state(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, leaves, nodes), a row per row of ``docs``; null and empty texts have no leaves."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for b in batches:
            made = [build(t, count, leaf_chars) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int64()))],
                ["doc_id", "leaves", "nodes"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, STATE)


CHANGED = "doc_id long, text string, leaves array<int>, nodes array<long>, tokens_before long, tokens_after long, n_leaves long, n_reencoded long"


def apply_edits(rows: DataFrame, vocabulary: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Rows of (doc_id, text, leaves, nodes, edits) after their edits: new text and state, counts before and after.

    A null or empty array of edits leaves a row as it is; a null replacement deletes.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 4)
        names = [c.split()[0] for c in CHANGED.split(", ")]
        for b in batches:
            out = []
            for d, t, lengths, nodes, edits in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "leaves", "nodes", "edits")), strict=True):
                asked = [(e["start"], e["end"], e["replacement"] or "") for e in edits or []]
                new, ln, nd, n = update(t or "", lengths, nodes, asked, count, leaf_chars)
                out.append((d, new, ln, nd, total(nodes), total(nd), len(ln), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.select("doc_id", "text", "leaves", "nodes", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(work, CHANGED)


def with_edits(docs: DataFrame, state: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents, their state and their edits in one row each, for ``apply_edits``.

    ``docs`` (doc_id, text) and ``state`` have one row per id; ``edits`` is (doc_id, start, end, replacement).  The edits of
    a document are one array: they belong to one text and are bounded by it.
    """
    gathered = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "replacement")).alias("edits"))
    return docs.select("doc_id", "text").join(state, "doc_id").join(gathered, "doc_id", "left")


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def mail_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that put ``[mail]`` for every e-mail address and delete the last line of a text of several lines.

    Addresses are looked for around each ``@``, so a text is passed once.
    """
    lines_end = text.rfind("\n") + 1
    head = lines_end or len(text)
    edits, done, at = [], 0, text.find("@")
    while 0 <= at < head:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1, head) if begin < at else None
        if domain:
            edits.append((begin, domain.end(), "[mail]"))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return edits + [(lines_end, len(text), "")] if 0 < lines_end < len(text) else edits


COUNTED = "doc_id long, tokens_before long, tokens_after long, n_leaves long, n_reencoded long"


def counted(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", edits: Column | None = None) -> DataFrame:
    """(doc_id, tokens_before, tokens_after, n_leaves, n_reencoded): counts of whole texts before and after edits.

    ``edits`` is a Column of the array that ``apply_edits`` takes (default: what ``mail_edits`` finds).  A text meets its
    tree and its edits in one pass, without a join.  Null and empty texts count 0.  Repeated rows give repeated rows, a null
    id stays null.
    """
    path = vocabulary or tokenise.word_bpe_path()
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        *([] if edits is None else [edits.cast(EDITS).alias("edits")]),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in batches:
            rows = []
            asked = [None] * b.num_rows if edits is None else b.column(2).to_pylist()
            for t, given in zip(b.column(1).to_pylist(), asked, strict=True):
                wanted = mail_edits(t) if edits is None else [(e["start"], e["end"], e["replacement"] or "") for e in given or []]
                lengths, nodes = build(t, count)
                _, after, changed, n = update(t, lengths, nodes, wanted, count)
                rows.append((total(nodes), total(changed), len(after), n))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [c.split()[0] for c in COUNTED.split(", ")])

    return narrow.mapInArrow(work, COUNTED)
