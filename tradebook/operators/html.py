"""Pages as trees: one row per page with its text and its elements.

A page is parsed once, inside its own row; everything after that is SQL over the
element array of the row, so no extractor needs a shuffle.  Elements carry their
place in document order (``seq``) and the place of their last descendant
(``last``): b lies inside a when a.seq < b.seq <= a.last.  The text of an element
is a slice of the page's text, kept as ``start`` and ``len``, so nested elements
do not repeat it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradebook.session import spread

# the parser travels with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)
# opening tag -> (tags it closes, tags it does not reach beyond)
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}

NODE = (
    "struct<seq:int,last:int,parent:int,depth:int,tag:string,id:string,classes:array<string>,"
    "attrs:map<string,string>,start:int,len:int>"
)
_ARROW_NODE = pa.struct(
    [
        ("seq", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
        ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())),
        ("start", pa.int32()), ("len", pa.int32()),
    ]
)
_PAGES_PER_BATCH = 64


class _Tree(HTMLParser):
    """Collects text and elements of one page; open elements are closed where HTML implies it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.texts: list[str] = []
        self.length = 0
        self.open: list[dict] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for lines and columns

    def _close(self, upto: int) -> None:
        for node in self.open[upto:]:
            node["last"] = len(self.nodes) - 1
            node["len"] = self.length - node["start"]
        del self.open[upto:]

    def _close_implied(self, closes: set[str], stops: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in stops:
                return
            if self.open[i]["tag"] in closes:
                self._close(i)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._close_implied({"p"}, {"table", "td", "button"})
        if tag in _IMPLIED:
            self._close_implied(*_IMPLIED[tag])
        own = {k: v or "" for k, v in reversed(attrs)}
        node = {
            "seq": len(self.nodes), "last": len(self.nodes), "parent": self.open[-1]["seq"] if self.open else -1,
            "depth": len(self.open), "tag": tag, "id": own.get("id"), "classes": own.get("class", "").split(),
            "attrs": list(own.items()), "start": self.length, "len": 0,
        }
        self.nodes.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                self._close(i)
                return

    def handle_data(self, data: str) -> None:
        self.texts.append(data)
        self.length += len(data)

    def done(self) -> tuple[str, list[dict]]:
        self.close()
        self._close(0)
        return "".join(self.texts), self.nodes


def _parse(html: str | None) -> tuple[str, list[dict]]:
    tree = _Tree()
    tree.feed(html or "")
    return tree.done()


def parse_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(page_id, url, html, ...) -> the kept columns, ``text`` and ``nodes``."""
    cols = list(keep)
    src = spread(pages.select(*cols, "html"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*cols).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _PAGES_PER_BATCH):
                part = batch.slice(at, _PAGES_PER_BATCH)
                parsed = [_parse(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in cols],
                        pa.array([t for t, _ in parsed], pa.string()),
                        pa.array([n for _, n in parsed], pa.list_(_ARROW_NODE)),
                    ],
                    names=[*cols, "text", "nodes"],
                )

    return src.mapInArrow(run, ", ".join([*kept, "text string", f"nodes array<{NODE}>"]))


def elements(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per element with its text: the tree as a flat table."""
    rows = parsed.select(key, "text", F.explode("nodes").alias("n"))
    return rows.select(key, "n.*", F.expr(text_of("n")).alias("element_text")).drop("start", "len")


# --- SQL text over (text, nodes) of a row ----------------------------------------------------------


def all_of(cond: str, n: str = "n") -> str:
    """Elements that satisfy a condition on ``n``."""
    return f"filter(nodes, {n} -> {cond})"


def first_of(cond: str, n: str = "n") -> str:
    """The first such element, or null."""
    return f"get({all_of(cond, n)}, 0)"


def text_of(node: str) -> str:
    return f"substring(text, {node}.start + 1, {node}.len)"


def line_of(node: str) -> str:
    """Text of an element on one line."""
    return rf"trim(regexp_replace({text_of(node)}, r'[\s\u00a0]+', ' '))"


def inside(node: str, ancestor: str) -> str:
    return f"{node}.seq > {ancestor}.seq AND {node}.seq <= {ancestor}.last"


def within(ancestor: str) -> str:
    """Descendants of an element: a slice, as elements stand in document order."""
    return f"slice(nodes, {ancestor}.seq + 2, {ancestor}.last - {ancestor}.seq)"


def all_under(cond: str, cond_on_a: str, n: str = "n") -> str:
    """Elements with a condition that have an ancestor ``a`` with another; the ancestors are looked up once."""
    return (
        f"transform(array(filter(nodes, a -> {cond_on_a})), boxes -> "
        f"filter(nodes, {n} -> ({cond}) AND exists(boxes, a -> {inside(n, 'a')})))[0]"
    )


def under(cond_on_a: str, node: str = "n") -> str:
    """An ancestor ``a`` with the condition exists."""
    return f"exists(nodes, a -> ({cond_on_a}) AND {inside(node, 'a')})"


def has_class(node: str, *names: str) -> str:
    """The element has one of the classes."""
    return "(" + " OR ".join(f"array_contains({node}.classes, '{c}')" for c in names) + ")"


def class_part(node: str, *parts: str) -> str:
    """The class attribute contains one of the pieces."""
    return "(" + " OR ".join(f"contains(coalesce({node}.attrs['class'], ''), '{p}')" for p in parts) + ")"


def is_tag(node: str, *tags: str) -> str:
    return f"{node}.tag IN (" + ", ".join(f"'{t}'" for t in tags) + ")"


def attr(node: str, name: str) -> str:
    return f"{node}.attrs['{name}']"


def meta(name: str, by: str = "name") -> str:
    """Trimmed content of the first meta element of that name."""
    node = first_of(f"n.tag = 'meta' AND {attr('n', by)} = '{name}'")
    return f"trim({node}.attrs['content'])"


def body_text() -> str:
    """Text of the body, or of the whole page when it has none."""
    return f"transform(array({first_of(chr(110) + '.tag = ' + chr(39) + 'body' + chr(39))}), b -> coalesce({text_of('b')}, text))[0]"


def visible_text(tags: list[str]) -> Column:
    """Body text without the subtrees of the given tags, on one line; the whole text, however long.

    Removed subtrees are the outermost ones; what is kept are the gaps between them.
    """
    outer = all_of(f"{is_tag('n', *tags)} AND NOT " + under(is_tag("a", *tags)))
    cuts = f"transform({outer}, c -> named_struct('s', c.start, 'e', c.start + c.len))"
    pieces = f"""transform(sequence(0, size(cuts)), i -> substring(text,
        if(i = 0, b.start, get(cuts, i - 1).e) + 1,
        greatest(if(i = size(cuts), b.start + b.len, get(cuts, i).s) - if(i = 0, b.start, get(cuts, i - 1).e), 0)))"""
    body = first_of("n.tag = 'body'")
    whole = "named_struct('start', 0, 'len', length(text))"
    node = f"transform(array({body}), q -> if(q IS NULL, {whole}, named_struct('start', q.start, 'len', q.len)))[0]"
    inner = f"filter({cuts}, c -> c.s >= b.start AND c.e <= b.start + b.len)"
    sql = (
        f"transform(array({node}), b -> transform(array({inner}), cuts -> "
        rf"trim(regexp_replace(array_join({pieces}, ' '), r'[\s\u00a0]+', ' ')))[0])[0]"
    )
    return F.expr(sql)
