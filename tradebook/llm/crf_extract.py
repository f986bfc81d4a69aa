"""Main text of pages by a linear-chain conditional random field over their leaf blocks.

Two labels, text and furniture.  A block's score is a sum over features of its
ancestors (names, words of class, id and role) and of the shape of its text; a
transition score ties neighbours.  Trained by gradient ascent on the
log-likelihood (forward and backward sums), decoded by Viterbi.

The labelled pages are of two kinds: layouts made here, of many site styles,
whose blocks are labelled as they are written; and a bounded sample of the given
pages whose own markup is outspoken (an article or main element).
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradebook.llm.common import bounded_sample
from tradebook.llm.page_blocks import Block, blocks, text_features

MADE_PAGES = 700
SAMPLED_PAGES = 200
FURNITURE_ABOVE = frozenset("in=nav in=aside in=footer in=form in=header in=button in=dialog hidden".split())

Labelled = tuple[list[Block], list[int]]


# --- the model -----------------------------------------------------------------------------------------


@dataclass
class Model:
    weights: dict[str, float]  # log-odds of text against furniture
    move: tuple[tuple[float, float], tuple[float, float]]  # [from][to]
    first: tuple[float, float]

    def emission(self, b: Block) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in b.above) + sum(get(f, 0.0) for f in text_features(b)) + get("bias", 0.0)

    def decode(self, page: Sequence[Block]) -> list[int]:
        """The likeliest labels of a page's blocks; ties go to text."""
        if not page:
            return []
        back: list[tuple[int, int]] = []
        s0, s1 = self.first[0], self.first[1] + self.emission(page[0])
        (m00, m01), (m10, m11) = self.move
        for b in page[1:]:
            a, c, d, e = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((0 if a > c else 1, 0 if d > e else 1))
            s0, s1 = max(a, c), max(d, e) + self.emission(b)
        label = 0 if s0 > s1 else 1
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def train(pages: Sequence[Labelled], rounds: int = 120, rate: float = 0.1, decay: float = 2e-4) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows, cols, at = [], [], 0
    lengths = np.array([len(b) for b, _ in pages])
    for page, _ in pages:
        for b in page:
            for f in (*b.above, *text_features(b), "bias"):
                rows.append(at)
                cols.append(names.setdefault(f, len(names)))
            at += 1
    rows, cols = np.array(rows), np.array(cols)
    n, longest = len(pages), int(lengths.max())
    step = np.concatenate([np.arange(k) for k in lengths])
    page_of = np.repeat(np.arange(n), lengths)
    gold = np.zeros((n, longest), np.int64)
    gold[page_of, step] = np.concatenate([y for _, y in pages])
    real = np.arange(longest)[None] < lengths[:, None]
    params = np.zeros(len(names) + 6)
    grown, squared = np.zeros_like(params), np.zeros_like(params)
    for i in range(1, rounds + 1):
        w, move, first = params[:-6], params[-6:-2].reshape(2, 2), params[-2:]
        e = np.zeros((n, longest, 2))
        e[page_of, step, 1] = np.bincount(rows, w[cols], at)
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = first + e[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(real[:, t, None], np.logaddexp.reduce(fwd[:, t - 1, :, None] + move, 1) + e[:, t], fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = np.logaddexp.reduce(move + (e[:, t + 1] + bwd[:, t + 1])[:, None], 2)
            bwd[:, t] = np.where(real[:, t + 1, None], ahead, 0)
        total = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        seen = np.exp(fwd + bwd - total[:, None, None])
        grad = np.zeros_like(params)
        off = (gold - seen[:, :, 1])[page_of, step]
        grad[:-6] = np.bincount(cols, off[rows], len(names))
        pair = np.exp(fwd[:, :-1, :, None] + move + (e + bwd)[:, 1:, None] - total[:, None, None, None]) * real[:, 1:, None, None]
        told = np.zeros((2, 2))
        np.add.at(told, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
        grad[-6:-2] = (told - pair.sum((0, 1))).ravel()
        grad[-2:] = np.bincount(gold[:, 0], minlength=2) - seen[:, 0].sum(0)
        grad = grad / n - decay * params
        grown, squared = 0.9 * grown + 0.1 * grad, 0.999 * squared + 0.001 * grad**2
        params += rate * (grown / (1 - 0.9**i)) / (np.sqrt(squared / (1 - 0.999**i)) + 1e-8)
    m = params[-6:-2].reshape(2, 2)
    return Model(
        {f: float(params[k]) for f, k in names.items()},
        tuple(tuple(map(float, r)) for r in m), tuple(map(float, params[-2:])),
    )


# --- labelled pages --------------------------------------------------------------------------------------

# fixed values: names by which sites call the parts of a page
CALLED = {
    "menu": "nav menu navbar navigation topnav breadcrumb breadcrumbs menubar links tabs toc".split(),
    "header": "header masthead top banner logo site title branding".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "sidebar": "sidebar side aside widget related rail recommended popular trending tags".split(),
    "notice": "notice cookie cookies consent alert message popup modal newsletter subscribe gdpr warning overlay disclaimer".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense".split(),
    "comments": "comments comment reply replies discussion respond responses disqus thread reader".split(),
    "share": "share social sharing follow buttons".split(),
    "text": "content article post entry main body story text page single hentry".split(),
}
_SYLLABLES = "ba be ka lo mi na or pe ra si ta un ve wo en an th er in re on".split()


def _words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]


def _prose(r: random.Random, sentences: int) -> str:
    return " ".join(" ".join(_words(r, r.choice((2, 5, 9, 14, 25)))).capitalize() + r.choice("....!?") for _ in range(sentences))


def made_page(r: random.Random) -> Labelled:
    """A page of a random layout with the labels of its blocks.

    Marks beside the words of a block say its label and are taken off again: \\u2060 for text.
    """
    mark = "⁠"
    semantic, named = r.random() < 0.6, r.random() < 0.85

    def part(kind: str, element: str, inner: str) -> str:
        element = element if semantic and r.random() < 0.9 else r.choice(("div", "div", "section"))
        word = r.choice(CALLED[kind])
        say = f' {r.choice(("class", "id", "class"))}="{word}{r.choice(("", "-" + r.choice(_words(r, 1))))}"' if named or element == "div" and r.random() < 0.7 else ""
        return f"<{element}{say}>{inner}</{element}>"

    def few(n: int) -> str:
        return " ".join(_words(r, n)).capitalize() + r.choice(("", "", "."))

    def menu() -> str:
        items = [f'<a href="/{w}">{w}</a>' for w in _words(r, r.randint(3, 9))]
        return part("menu", "nav", "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if r.random() < 0.7 else " | ".join(items))

    def advert() -> str:
        return part("ad", "div", r.choice(("<p>{}</p>", "{}", '<a href="/x">{}</a>')).format(few(r.randint(2, 15))))

    def sidebar() -> str:
        items = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in _words(r, r.randint(2, 6)))
        return part("sidebar", "aside", r.choice((f"<h3>{few(2)}</h3><ul>{items}</ul>", f"<p>{_prose(r, r.randint(1, 3))}</p>", f"<h4>{few(1)}</h4><p>{few(8)}</p>")))

    def notice() -> str:
        return part("notice", "div", r.choice(("<p>{}</p>", "{}", "<p>{}</p><button>ok</button>")).format(_prose(r, r.randint(1, 2))))

    def form() -> str:
        return f'<form action="/s"><label>{few(1)}</label><input name="q"><button>{few(1)}</button>{r.choice(("", "<p>" + few(5) + "</p>"))}</form>'

    def comments() -> str:
        one = lambda: r.choice(("<p>{}</p>", "<b>{}</b><p>{}</p>", "<li>{}</li>")).replace("{}", _prose(r, r.randint(1, 3)), 1).format(_prose(r, 1))
        inner = f"<h3>{few(1)}</h3>" + "".join(part("comments", r.choice(("div", "article")), one()) for _ in range(r.randint(1, 4)))
        return part("comments", "section", inner)

    def article() -> str:
        body = []
        if r.random() < 0.8:
            body.append(f"<h1>{mark}{few(r.randint(2, 12))}</h1>")
        for _ in range(r.choice((1, 2, 3, 5, 9, 14))):
            kind, text = r.random(), mark + _prose(r, r.choice((1, 1, 2, 4, 7)))
            if kind < 0.08:
                body.append(f"<h2>{mark}{few(r.randint(1, 6))}</h2>")
            elif kind < 0.14:
                body.append("<ul>" + "".join(f"<li>{mark}{few(r.randint(1, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.18:
                body.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.21:
                body.append("<table><tr>" + "".join(f"<td>{mark}{few(2)}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.25:
                body.append(f"<pre>{mark}{few(8)}</pre>")
            elif kind < 0.5:
                body.append(f"<p>{mark}{few(r.randint(1, 9))}</p>")
            elif kind < 0.6:
                body.append(f"<p><b>{text}</b> <a href='/z'>{few(2)}</a> {few(4)}<br><p>{mark}{_prose(r, 1)}</p>")
            else:
                body.append(f"<p>{text}</p>" if r.random() < 0.9 else f"<div>{text}</div>")
            if r.random() < 0.06:
                body.append(r.choice((advert, notice, sidebar, form))())
        if r.random() < 0.2:
            body.append(part("share", "div", few(2)))
        if r.random() < 0.25:
            body.append(comments())
        inner = "".join(body)
        if semantic and r.random() < 0.85:
            return f"<article>{inner}</article>" if r.random() < 0.8 else f"<main>{inner}</main>"
        word = r.choice(CALLED["text"])
        return f'<div class="{word}{r.choice(("", "-" + word))}">{inner}</div>' if named or r.random() < 0.5 else f"<div>{inner}</div>"

    before = [r.choice((menu, menu, advert, notice, form, lambda: part("header", "header", f"<p>{few(2)}</p>"))) for _ in range(r.randint(1, 4))]
    after = [r.choice((sidebar, advert, comments, menu, notice)) for _ in range(r.randint(0, 3))]
    foot = part("footer", "footer", r.choice(("&copy; {}", "<p>&copy; {}</p>", "<p>{}</p>", "{}")).format(few(r.randint(2, 20))))
    html = "<html><body>" + "".join(f() for f in before) + article() + "".join(f() for f in after) + foot
    page = blocks(html)
    return [b._replace(text=b.text.replace(mark, "") or "x") for b in page], [int(mark in b.text) for b in page]


def outspoken(html: str | None) -> Labelled | None:
    """Labels from a page's own markup, if it has exactly an article or a main element around its text."""
    page = blocks(html)
    inside = [not FURNITURE_ABOVE.intersection(b.above) and ("in=article" in b.above or "in=main" in b.above) for b in page]
    if not any(inside) or any("has=comment" in b.above or "has=comments" in b.above for b in page):
        return None
    return page, [int(x) for x in inside]


def fitted(pages: DataFrame, page_id: str = "page_id", html: str = "html", sampled: int = SAMPLED_PAGES, made: int = MADE_PAGES) -> Model:
    """A model from ``made`` pages of random layouts and at most ``sampled`` outspoken ones of the given table."""
    r = random.Random(7)
    labelled = [made_page(r) for _ in range(made)]
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    ids = bounded_sample(narrow.select("page_id").where("page_id is not null").distinct(), "page_id", sampled)
    # at most ``sampled`` ids: the broadcast is bounded
    rows = narrow.join(F.broadcast(ids), "page_id").where(F.length("html") < 200_000).orderBy("page_id").limit(2 * sampled)
    labelled += [x for row in rows.collect() if (x := outspoken(row["html"])) is not None]
    return train(labelled)


# --- extraction ------------------------------------------------------------------------------------------


def main_text(html: str | None, model: Model) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, label in zip(page, model.decode(page), strict=True) if label)


def extract(pages: DataFrame, model: Model, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, blocks in order joined by line ends.

    Null and empty html, and pages without a text block, give an empty text.  Repeated rows give repeated rows; ids and
    URLs are passed through, null or not.  A page is worked on alone, so memory is that of one batch of pages.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(h, model) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    narrow = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")
    )
    return narrow.mapInArrow(work, "page_id long, url string, text string, n_chars long")
