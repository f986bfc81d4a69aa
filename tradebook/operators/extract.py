"""Company records out of listing and profile pages.

A strategy is SQL text over one page's elements that gives an array of records;
a family of sites is an ordered list of strategies, of which the first with
records wins.  A new kind of site is a new rule, not a new job: all strategies
run inside the page's row and the one explode at the end is the only fan-out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradebook.functions import fixed_values as fv
from tradebook.functions import text as tx
from tradebook.functions import urls
from tradebook.functions.semantics import let_sql, once
from tradebook.operators import html as h
from tradebook.operators.fields import json_ld_texts
from tradebook.session import checkpointed

_NOTHING = "cast(NULL AS string)"
_RECORD_TYPE = (
    "struct<rank:int,name:string,link:string,phone:string,email:string,description:string,city:string,registry:string,"
    "categories:array<string>,score:double>"
)
_NONE = f"cast(array() AS array<{_RECORD_TYPE}>)"
_MAIL = tx.MAIL_IN_TEXT


def _record(rank: str, confidence: float, **parts: str) -> str:
    """named_struct text with all record fields; parts not given are null."""
    cols = ["name", "link", "phone", "email", "description", "city", "registry"]
    body = ", ".join(f"'{c}', {parts.get(c, _NOTHING)}" for c in cols)
    cats = parts.get("categories", "cast(array() AS array<string>)")
    return f"named_struct('rank', cast({rank} AS int), {body}, 'categories', {cats}, 'score', {confidence}D)"


def _words(values: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in values)


def _first_in(card: str, cond: str) -> str:
    """First element inside ``card`` with the condition on m."""
    return f"get(filter({h.within(card)}, m -> ({cond})), 0)"


def _line_in(card: str, cond: str) -> str:
    """Its text on one line; null when it is not there or empty."""
    return f"transform(array({_first_in(card, cond)}), o -> nullif({h.line_of('o')}, ''))[0]"


def _best(records: str, good: str) -> str:
    """Records that pass, of the first selector that has any."""
    return let_sql(
        f"filter({records}, r -> {good})", "rs",
        "filter(rs, r -> r.rank = array_min(transform(rs, q -> q.rank)))",
    )


def _phone_in(text: str) -> str:
    """First phone-like run of a text, if it holds 7 to 15 digits; international form first."""
    def tried(pattern: str) -> str:
        hit = f"trim(regexp_extract({text}, r'{pattern}', 1))"
        return rf"CASE WHEN regexp_replace({hit}, r'[\s\-()]', '') RLIKE r'^(\+\d{{6,14}}|\d{{7,15}})$' THEN {hit} END"

    return f"coalesce({tried(r'(\+[\d\s\-()]{7,20})')}, {tried(r'([\d\s\-()]{7,15})')})"


def _mail_in(text: str) -> str:
    found = f"regexp_extract_all({text}, r'({_MAIL})', 1)"
    return f"get(filter({found}, e -> NOT contains(e, 'placeholder') AND NOT contains(e, 'example.com')), 0)"


# --- cards ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CardRule:
    """How a grid of cards is read.  Conditions are SQL on the card ``n`` or on an element ``m`` inside it."""

    selectors: list[str]
    names: list[str]
    score: float
    link: str = "m.tag = 'a' AND m.attrs['href'] IS NOT NULL"
    description: str | None = None
    city: str | None = None
    categories: str | None = None
    registry: str | None = None
    contacts_in_text: bool = False
    first_line_as_name: bool = False
    skip: list[str] = field(default_factory=list)


def cards(rule: CardRule) -> str:
    cond = " OR ".join(f"({s})" for s in rule.selectors)
    rank = "CASE " + " ".join(f"WHEN {s} THEN {i}" for i, s in enumerate(rule.selectors)) + " END"
    rank = rank.replace("n.", "k.").replace("exists(nodes, k.", "exists(nodes, n.")
    names = [_line_in("k", c) for c in rule.names]
    if rule.first_line_as_name:
        names.append(f"get(filter(transform(split({h.text_of('k')}, '\\n'), x -> trim(x)), x -> length(x) > 2), 0)")
    parts = {
        "name": f"coalesce({', '.join(names)})",
        "link": f"{_first_in('k', rule.link)}.attrs['href']",
        "phone": _phone_in(h.text_of("k")) if rule.contacts_in_text else (
            f"coalesce(nullif(substring({_first_in('k', 'm.tag = ' + chr(39) + 'a' + chr(39) + ' AND startswith(m.attrs[' + chr(39) + 'href' + chr(39) + '], ' + chr(39) + 'tel:' + chr(39) + ')')}.attrs['href'], 5), ''),"
            f" {_line_in('k', h.has_class('m', 'phone', 'tel', 'contact-phone', 'telephone'))})"
        ),
        "email": _mail_in(h.text_of("k")) if rule.contacts_in_text else (
            f"nullif(substring({_first_in('k', 'm.tag = ' + chr(39) + 'a' + chr(39) + ' AND startswith(m.attrs[' + chr(39) + 'href' + chr(39) + '], ' + chr(39) + 'mailto:' + chr(39) + ')')}.attrs['href'], 8), '')"
        ),
    }
    for key in ("description", "city"):
        if getattr(rule, key):
            parts[key] = _line_in("k", getattr(rule, key))
    if rule.categories:
        parts["categories"] = (
            f"array_distinct(filter(transform(filter({h.within('k')}, m -> ({rule.categories})), o -> {h.line_of('o')}), "
            "x -> length(x) > 1 AND length(x) < 50))"
        )
    if rule.registry:
        parts["registry"] = rf"nullif(regexp_replace({_line_in('k', rule.registry)}, r'[^0-9]', ''), '')"
    made = f"transform({h.all_of(cond)}, k -> {_record(rank, rule.score, **parts)})"
    good = "length(r.name) BETWEEN 2 AND 200"
    if rule.skip:
        good += f" AND lower(r.name) NOT IN ({_words(rule.skip)})"
    return _best(made, good)


_HEADS = "m.tag IN ('h1', 'h2', 'h3', 'h4')"
GENERIC_CARDS = CardRule(
    selectors=[h.has_class("n", c) for c in fv.CARD_CLASSES] + [h.class_part("n", p) for p in fv.CARD_CLASS_PARTS],
    names=[f"{_HEADS} OR {h.has_class('m', 'name', 'title', 'company-name', 'business-name')} OR {h.class_part('m', 'name')}"],
    score=0.5, contacts_in_text=True, first_line_as_name=True, skip=fv.CARD_SKIP_WORDS,
)
B2B_CARDS = CardRule(
    selectors=[h.has_class("n", c) for c in fv.B2B_CARD_CLASSES]
    + [f"({h.class_part('n', 'company')} OR {h.class_part('n', 'supplier')}) AND {h.class_part('n', 'card')}"],
    names=["m.tag = 'h2'", "m.tag = 'h3'", "m.tag = 'h4'", h.has_class("m", "company-name"), h.has_class("m", "supplier-name"), h.has_class("m", "title")],
    score=0.6,
    description=h.has_class("m", "description", "company-desc", "supplier-desc", "summary", "excerpt", "text-muted"),
    city=h.has_class("m", "location", "city", "address", "country", "region"),
    categories=h.has_class("m", "category", "tag", "industry", "sector", "label"),
)
DIRECTORY_CARDS = CardRule(
    selectors=[h.has_class("n", c) for c in fv.DIRECTORY_CARD_CLASSES]
    + [f"({h.class_part('n', 'company')} OR {h.class_part('n', 'business')}) AND {h.class_part('n', 'card')}"],
    names=["m.tag = 'h3'", "m.tag = 'h2'", "m.tag = 'h4'", h.has_class("m", "company-name"), h.has_class("m", "business-name"), h.has_class("m", "title")],
    score=0.55,
    description=h.has_class("m", "description", "company-desc", "business-desc", "summary", "excerpt", "desc"),
    city=h.has_class("m", "location", "city", "address", "country", "region"),
    categories=h.has_class("m", "category", "tag", "industry", "sector", "label"),
)
LABELLED_CARDS = CardRule(
    selectors=[h.has_class("n", *fv.LABELLED_CARD_CLASSES)],
    names=[f"{h.has_class('m', 'card-pro__value', 'company-name', 'member-name')} OR {_HEADS}"],
    score=0.85,
    link="m.tag = 'a' AND m.attrs['href'] RLIKE 'Details|factory|member'",
    description=h.has_class("m", "card-pro__activity", "description", "company-desc") + " OR m.tag = 'h5'",
    registry=h.has_class("m", "cr-number"),
)
PORTAL_CARDS = CardRule(
    selectors=[h.has_class("n", c) for c in fv.PORTAL_CARD_CLASSES] + [h.class_part("n", p) for p in fv.PORTAL_CARD_PARTS],
    names=[f"m.tag = 'a' AND {h.under(h.class_part('a', 'title', 'Title') + ' OR ' + h.is_tag('a', 'h1', 'h2', 'h3', 'h4'), 'm')}", "m.tag = 'a'", _HEADS],
    score=0.75,
)


def labelled_cards() -> str:
    """Cards whose paragraphs say 'label: value': name after a name label, digits after a registry label."""
    cond = h.has_class("n", *fv.LABELLED_CARD_CLASSES)
    lines = f"transform(filter({h.within('k')}, m -> m.tag = 'p'), o -> {h.line_of('o')})"
    named = f"get(filter({lines}, x -> x RLIKE '{'|'.join(fv.LABEL_WORDS)}' AND contains(x, ':')), 0)"
    numbered = f"get(filter({lines}, x -> x RLIKE '{'|'.join(fv.REGISTRY_WORDS)}'), 0)"
    name = f"coalesce({_line_in('k', LABELLED_CARDS.names[0])}, nullif(trim(get(split({named}, ':'), 1)), ''))"
    registry = rf"nullif(regexp_replace(element_at(split({numbered}, r'[:\-–]'), -1), r'[^0-9]', ''), '')"
    link = f"{_first_in('k', LABELLED_CARDS.link)}.attrs['href']"
    tel = f"nullif(substring({_first_in('k', '''m.tag = 'a' AND startswith(m.attrs['href'], 'tel:')''')}.attrs['href'], 5), '')"
    mail = f"nullif(substring({_first_in('k', '''m.tag = 'a' AND startswith(m.attrs['href'], 'mailto:')''')}.attrs['href'], 8), '')"
    made = _record("0", 0.85, name=name, registry=registry, link=link, phone=tel, email=mail,
                   description=_line_in("k", LABELLED_CARDS.description))
    return _best(f"transform({h.all_of(cond)}, k -> {made})", "length(r.name) >= 2")


# --- tables and lists ---------------------------------------------------------------------------------------


def tables() -> str:
    """Rows of tables with at least two rows: first cell is the name, its link the address."""
    good_table = (
        f"t.tag = 'table' AND size(filter({h.within('t')}, x -> x.tag = 'tr')) >= 2 "
        f"AND NOT lower({h.text_of('t')}) RLIKE 'navigation|footer'"
    )
    rows = f"flatten(transform(filter(nodes, t -> {good_table}), t -> filter({h.within('t')}, k -> k.tag = 'tr')))"
    cell = _first_in("k", "m.tag IN ('td', 'th')")
    link = f"transform(array({cell}), c -> get(filter({h.within('c')}, l -> l.tag = 'a' AND l.attrs['href'] IS NOT NULL), 0))[0]"
    own = f"transform(array({cell}), o -> {h.line_of('o')})[0]"
    linked = f"transform(array({link}), o -> {h.line_of('o')})[0]"
    made = (
        f"transform(filter(transform({rows}, k -> named_struct('own', {own}, 'linked', {linked}, 'href', {link}.attrs['href'])), "
        f"x -> length(x.own) BETWEEN 2 AND 200 AND lower(x.own) NOT IN ({_words(fv.TABLE_SKIP_WORDS)})), "
        f"x -> {_record('0', 0.4, name='if(length(x.linked) > 1, x.linked, x.own)', link='x.href')})"
    )
    return made


def listview_tables() -> str:
    """List view of a portal: first cell name and link, the other cells joined as description."""
    table = f"t.tag = 'table' AND ({h.has_class('t', 'ms-listviewtable')} OR lower(coalesce(t.attrs['class'], '')) RLIKE 'listview' OR t.id = 'onetidDoclibViewTbl0')"
    rows = f"flatten(transform(filter(nodes, t -> {table}), t -> filter({h.within('t')}, k -> k.tag = 'tr')))"
    cells = f"filter({h.within('k')}, c -> c.tag = 'td')"
    texts = f"filter(transform({cells}, o -> {h.line_of('o')}), x -> x <> '')"
    link = f"transform(slice({cells}, 1, 1), c -> get(filter({h.within('c')}, l -> l.tag = 'a'), 0))"
    name = f"coalesce(nullif(transform({link}, o -> {h.line_of('o')})[0], ''), get({texts}, 0))"
    made = _record("0", 0.8, name=name, link=f"get({link}, 0).attrs['href']",
                   description=f"nullif(array_join(slice({texts}, 2, greatest(size({texts}) - 1, 0)), ' | '), '')")
    return f"filter(transform(filter({rows}, k -> size({cells}) > 0), k -> {made}), r -> length(r.name) >= 2)"


def registry_tables() -> str:
    """Tables of a registry: header words give the columns their roles, rows after the first are records."""
    table = (
        f"filter(nodes, t -> (t.tag = 'table' AND t.id IN ({_words(fv.REGISTRY_TABLE_IDS)})) OR {h.has_class('t', *fv.REGISTRY_TABLE_CLASSES)} OR t.id = 'search-results')"
    )
    rows = f"filter({h.within('t')}, x -> x.tag = 'tr')"
    heads = f"transform(filter({h.within('rows[0]')}, c -> c.tag IN ('th', 'td')), o -> lower({h.line_of('o')}))"
    # 0-based column of every role, -1 when no header names it
    roles = "named_struct(" + ", ".join(
        f"'{r}', cast(array_position(transform(heads, w -> w RLIKE '{'|'.join(words)}'), true) AS int) - 1" for r, words in fv.HEADER_ROLES
    ) + ")"
    cells = f"filter({h.within('k')}, c -> c.tag = 'td')"
    lines = f"transform(cells, o -> nullif({h.line_of('o')}, ''))"
    pick = lambda r: f"CASE WHEN roles.{r} >= 0 THEN get(vals, roles.{r}) END"
    link = f"transform(array(get(cells, greatest(roles.name, 0))), c -> get(filter({h.within('c')}, l -> l.tag = 'a'), 0).attrs['href'])[0]"
    made = _record(
        "0", 0.85, name="get(vals, greatest(roles.name, 0))", link=link, description=pick("activity"), city=pick("location"),
        registry=pick("registry"), categories=f"filter(array({pick('activity')}), x -> x IS NOT NULL)",
    )
    record = let_sql(cells, "cells", let_sql(lines, "vals", made))
    body = f"transform(filter(slice(rows, 2, greatest(size(rows) - 1, 0)), k -> size({cells}) >= 2), k -> {record})"
    per_table = let_sql(rows, "rows", f"CASE WHEN size(rows) >= 2 THEN {let_sql(heads, 'heads', let_sql(roles, 'roles', body))} END")
    return f"coalesce(filter(flatten(filter(transform(slice({table}, 1, 1), t -> {per_table}), x -> x IS NOT NULL)), r -> length(r.name) >= 2), {_NONE})"


def linked_lists() -> str:
    """Items of lists with three and more items, half of them linked."""
    items = f"filter({h.within('t')}, i -> i.tag = 'li')"
    linked = f"filter({items}, i -> exists({h.within('i')}, l -> l.tag = 'a' AND l.attrs['href'] IS NOT NULL))"
    good = f"t.tag IN ('ul', 'ol') AND size({items}) >= 3 AND size({linked}) >= size({items}) * 0.5"
    per = f"transform({items}, k -> {_record('0', 0.35, name=_line_in('k', '''m.tag = 'a' AND m.attrs['href'] IS NOT NULL'''), link=_first_in('k', '''m.tag = 'a' AND m.attrs['href'] IS NOT NULL''') + '''.attrs['href']''')})"
    made = f"flatten(transform(filter(nodes, t -> {good}), t -> {per}))"
    return f"filter({made}, r -> length(r.name) BETWEEN 2 AND 200 AND lower(r.name) NOT IN ({_words(fv.LIST_SKIP_WORDS)}))"


def definition_lists() -> str:
    """Terms of definition lists with two and more terms."""
    terms = f"filter({h.within('t')}, i -> i.tag = 'dt')"
    link = "m.tag = 'a' AND m.attrs['href'] IS NOT NULL"
    name = f"coalesce({_line_in('k', link)}, nullif({h.line_of('k')}, ''))"
    per = f"transform({terms}, k -> {_record('0', 0.3, name=name, link=_first_in('k', link) + '''.attrs['href']''')})"
    made = f"flatten(transform(filter(nodes, t -> t.tag = 'dl' AND size({terms}) >= 2), t -> {per}))"
    return f"filter({made}, r -> length(r.name) BETWEEN 2 AND 200)"


def zone_links() -> str:
    """Links of the main zone of a portal that are neither navigation nor headings."""
    zone = f"a.id IN ({_words(fv.PORTAL_ZONE_IDS)}) OR a.tag = 'main' OR a.attrs['role'] = 'main' OR {h.has_class('a', 'ms-rtestate-field')}"
    made = _record("0", 0.65, name=h.line_of("k"), link="k.attrs['href']")
    linked = f"flatten(transform(filter(nodes, a -> {zone}), a -> filter({h.within('a')}, k -> k.tag = 'a' AND k.attrs['href'] IS NOT NULL)))"
    rows = f"transform({linked}, k -> {made})"
    good = (
        f"length(r.name) BETWEEN 3 AND 120 AND lower(r.name) NOT IN ({_words(fv.NAVIGATION_WORDS)}) AND lower(r.name) NOT IN ({_words(fv.HEADING_WORDS)}) "
        "AND NOT lower(r.link) RLIKE r'^(javascript:|mailto:|tel:|#|_layouts/|_catalogs/)' "
        "AND (startswith(r.link, '/') OR r.link RLIKE 'modon.gov.sa|/Pages/|/Factory/|/Detail|FactoryId=|ID=')"
    )
    return let_sql(f"filter({rows}, r -> {good})", "rs", "filter(rs, (r, i) -> NOT exists(slice(rs, 1, i), q -> lower(q.name) = lower(r.name)))")


def value_cells() -> str:
    """Rows of a portal whose cells carry the value classes."""
    cells = f"filter({h.within('k')}, c -> c.tag = 'td' AND {h.has_class('c', 'ms-vb2', 'ms-vb')})"
    texts = f"transform({cells}, o -> {h.line_of('o')})"
    link = f"transform(slice({cells}, 1, 1), c -> get(filter({h.within('c')}, l -> l.tag = 'a'), 0))"
    made = _record("0", 0.7, name=f"coalesce(nullif(transform({link}, o -> {h.line_of('o')})[0], ''), get({texts}, 0))",
                   link=f"get({link}, 0).attrs['href']", description=f"nullif(trim(array_join(slice({texts}, 2, greatest(size({texts}) - 1, 0)), ' | ')), '')")
    return f"filter(transform(filter(nodes, k -> k.tag = 'tr' AND size({cells}) > 0), k -> {made}), r -> length(r.name) >= 2)"


def portal_headings() -> str:
    """Headings of a portal page that are no page headings, with the link inside or around."""
    made = _record("0", 0.55, name=h.line_of("k"), link=f"{_first_in('k', '''m.tag = 'a' ''')}.attrs['href']")
    rows = f"transform(filter(nodes, k -> k.tag IN ('h2', 'h3', 'h4')), k -> {made})"
    return f"filter({rows}, r -> length(r.name) BETWEEN 3 AND 200 AND lower(r.name) NOT IN ({_words(fv.HEADING_WORDS)}) AND lower(r.name) NOT IN ({_words(fv.NAVIGATION_WORDS)}))"


def organisations() -> str:
    """JSON-LD objects whose type names an organisation or business."""
    docs = f"filter(transform({json_ld_texts()}, x -> try_parse_json(x)), d -> d IS NOT NULL)"
    items = f"""flatten(transform({docs}, d -> coalesce(try_variant_get(d, '$', 'array<variant>'),
      try_variant_get(d, "$['@graph']", 'array<variant>'), array(d))))"""
    g = lambda p: f"try_variant_get(v, '$.{p}', 'string')"
    made = _record(
        "0", 0.85, name=f"coalesce(nullif({g('name')}, ''), nullif({g('legalName')}, ''), nullif({g('alternateName')}, ''))",
        link=f"nullif({g('url')}, '')", description=f"nullif({g('description')}, '')", phone=f"nullif({g('telephone')}, '')", email=f"nullif({g('email')}, '')",
    )
    typed = f"""filter({items}, v -> lower(try_variant_get(v, "$['@type']", 'string')) RLIKE 'organization|business')"""
    return f"filter(transform({typed}, v -> {made}), r -> r.name IS NOT NULL)"


# --- families and the one job ---------------------------------------------------------------------------------------

# in an order that keeps the order of every family below
STRATEGIES = {
    "registry_table": registry_tables,
    "directory_cards": lambda: cards(DIRECTORY_CARDS),
    "b2b_cards": lambda: cards(B2B_CARDS),
    "listview": listview_tables,
    "portal_cards": lambda: cards(PORTAL_CARDS),
    "zone_links": zone_links,
    "value_cells": value_cells,
    "headings": portal_headings,
    "json_ld": organisations,
    "labelled_cards": labelled_cards,
    "cards": lambda: cards(GENERIC_CARDS),
    "table": tables,
    "list": linked_lists,
    "definitions": definition_lists,
}
FAMILIES = {
    "generic": ["json_ld", "cards", "table", "list", "definitions"],
    "estate_portal": ["listview", "portal_cards", "zone_links", "value_cells", "headings"],
    "chamber": ["json_ld", "labelled_cards", "table"],
    "registry": ["registry_table", "json_ld"],
    "b2b_portal": ["b2b_cards", "list"],
    "directory": ["directory_cards", "json_ld"],
    "world_listing": ["directory_cards"],
    "mideast_listing": ["directory_cards"],
    "industry_guide": ["b2b_cards", "table"],
}


def site_family(url: Column) -> Column:
    """struct(family, score): the family of highest score for an address, the first one on ties, else generic."""
    def ladder(u: Column) -> Column:
        hits = []
        for name, words, more, with_more, without in fv.SITE_FAMILIES:
            has = u.rlike("|".join(w.replace(".", r"\.") for w in words))
            score = F.when(u.rlike("|".join(more)), with_more).otherwise(without) if more else F.lit(with_more)
            hits.append(F.struct(F.when(has, score).otherwise(0.0).alias("score"), F.lit(-len(hits)).alias("turn"), F.lit(name).alias("family")))
        hits.append(F.struct(F.lit(fv.GENERIC_SCORE).alias("score"), F.lit(-99).alias("turn"), F.lit("generic").alias("family")))
        best = F.array_max(F.array(*hits))
        return F.struct(best["family"].alias("family"), best["score"].alias("score"))

    from tradebook.functions.semantics import let

    return let(F.lower(urls.untracked_url(url)), ladder)


def _by_strategy(names: Sequence[str], wanted: dict[str, str] | None = None) -> str:
    """struct(strategy, records) of the first strategy with records; later ones are not worked out.

    ``wanted`` may give a condition under which a strategy is tried at all.
    """
    tries = []
    for n in names:
        found = let_sql(STRATEGIES[n](), "f", f"CASE WHEN size(f) > 0 THEN named_struct('strategy', '{n}', 'records', f) END")
        tries.append(f"CASE WHEN {wanted[n]} THEN {found} END" if wanted else found)
    return f"coalesce({', '.join(tries)}, named_struct('strategy', cast(NULL AS string), 'records', {_NONE}))"


def extract_records(parsed: DataFrame, strategies: Sequence[str] | None = None) -> DataFrame:
    """One row per extracted record: page_id, ordinal, family, strategy, the fields and their confidences.

    ``strategies`` overrides the choice by address.
    """
    if strategies:
        found = parsed.select("page_id", "url", F.lit("given").alias("family"), F.expr(_by_strategy(strategies)).alias("_f"))
    else:
        # every strategy stands once in the plan; the families that use it are its condition
        users = {n: [f for f, steps in FAMILIES.items() if n in steps] for n in STRATEGIES}
        wanted = {n: f"family IN ({_words(fs)})" for n, fs in users.items()}
        chosen = parsed.withColumn("family", site_family(F.col("url"))["family"])
        found = chosen.select("page_id", "url", "family", F.expr(_by_strategy(list(STRATEGIES), wanted)).alias("_f"))
    rows = found.select("page_id", "url", "family", "_f.strategy", F.posexplode("_f.records").alias("ordinal", "r"))
    have = lambda c, yes, no: F.when(c.isNotNull(), yes).otherwise(no)
    r = lambda n: F.col(f"r.{n}")
    arabic = tx.is_mostly_arabic(r("name"))
    name_conf = F.least(F.col("r.score") + 0.1, F.lit(0.95))
    return rows.select(
        "page_id", "ordinal", "family", "strategy",
        F.when(~arabic, tx.display_name(r("name"))).alias("name_en"), F.when(arabic, tx.display_name(r("name"))).alias("name_ar"),
        F.when(r("link").isNotNull(), urls.resolve(r("link"), F.col("url"))).alias("website_url"),
        r("phone").alias("phone"), r("email").alias("email"), r("description").alias("description_en"),
        F.coalesce(tx.city_in(r("city")), r("city")).alias("city"), r("registry").alias("cr_number"),
        r("categories").alias("categories"), F.col("url").alias("source_url"), r("score").alias("confidence_score"),
        F.create_map(
            F.lit("name_en"), F.round(name_conf, 2), F.lit("website_url"), have(r("link"), 0.5, 0.0), F.lit("phone"), have(r("phone"), 0.6, 0.0),
            F.lit("email"), have(r("email"), 0.6, 0.0), F.lit("description_en"), have(r("description"), 0.5, 0.0),
        ).alias("field_confidence"),
    )


_LISTING_COLUMNS = [
    "page_id", "ordinal", "strategy", "name_en", "name_ar", "website_url", "email", "phone", "full_address", "description_en",
    "source_url", "confidence_score",
]


def choose_listing(parsed: DataFrame) -> DataFrame:
    """Records of guide pages by the reading that found more: article sections, cards, or tables where no card is.

    Sections win with two or more of them on a page that looks like a guide (a
    'Website:' line and two small headings), or when they name at least as many
    sites as the cards or tables do.
    """
    sections = article_sections(parsed).withColumns({"ordinal": F.col("section_no"), "strategy": F.lit("article")})
    boxed = extract_records(parsed, ["b2b_cards", "table"]).withColumn("full_address", F.lit(None).cast("string"))
    rows = checkpointed(sections.select(*_LISTING_COLUMNS).unionByName(boxed.select(*_LISTING_COLUMNS)))
    site = F.coalesce(F.col("website_url") != "", F.lit(False))
    article = F.col("strategy") == "article"
    counts = rows.groupBy("page_id").agg(
        F.count_if(article).alias("_sections"), F.count_if(~article).alias("_boxes"),
        F.count_if(article & site).alias("_section_sites"), F.count_if(~article & site).alias("_box_sites"),
    )
    guide = parsed.select(
        "page_id",
        (F.expr(h.body_text()).rlike(r"(?i)\bwebsite\s*:") & (F.size(F.expr(h.all_of("n.tag IN ('h3', 'h4')"))) >= 2)).alias("_guide"),
    )
    by_article = (F.col("_boxes") == 0) | (
        (F.col("_sections") >= 2) & (F.coalesce("_guide", F.lit(False)) | (F.col("_section_sites") >= F.col("_box_sites")))
    )
    choice = counts.join(guide, "page_id").select("page_id", by_article.alias("_by_article"))
    return rows.join(choice, "page_id").where(F.col("_by_article") == article).select(*_LISTING_COLUMNS)


def pages_without_records(parsed: DataFrame, records: DataFrame) -> DataFrame:
    """Pages no rule could read: the input of the fallback requests."""
    return parsed.join(records.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "url", "text")


# --- marker lines --------------------------------------------------------------------------------------------------


def marker_records(
    parsed: DataFrame, start: str = fv.RECORD_START, name: str = fv.RECORD_NAME, activity: str = fv.RECORD_ACTIVITY, noise: str = fv.RECORD_NOISE
) -> DataFrame:
    """Records of a line-oriented listing: a marker line opens one, the lines up to the next marker fill it."""
    lines = f"filter(transform(filter(nodes, n -> n.tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'p', 'li', 'div')), o -> {h.line_of('o')}), x -> x <> '')"
    rows = parsed.select("page_id", "url", F.posexplode(F.expr(lines)).alias("pos", "line"))
    is_start = F.col("line").rlike(f"(?iu){start}")
    so_far = Window.partitionBy("page_id").orderBy("pos")  # the lines of one page
    numbered = rows.withColumn("record_no", F.sum(F.when(is_start, 1).otherwise(0)).over(so_far)).where("record_no > 0")
    named = F.col("line").contains(name) & ~is_start
    active = F.col("line").rlike(f"(?iu){activity}") & F.length("line").between(6, 120) & ~F.col("line").rlike(f"(?iu){noise}") & ~named & ~is_start
    value = F.trim(F.regexp_replace(F.regexp_extract("line", f"(?s){name}(.*)$", 1), r"^[:：\-\s]+", ""))
    out = numbered.groupBy("page_id", "record_no").agg(
        F.first("url").alias("url"),
        F.max_by(value, F.when(named & (value != ""), F.col("pos"))).alias("name_en"),
        F.min_by("line", F.when(active, F.col("pos"))).alias("description_en"),
        F.min_by(F.regexp_extract("line", r"(\d{6,})", 1), F.when(is_start, F.col("pos"))).alias("cr_number"),
    )
    return out.where(F.length("name_en") >= 2).select(
        "page_id", "record_no", "name_en", "description_en", F.when(F.col("cr_number") != "", F.col("cr_number")).alias("cr_number"),
        F.coalesce(
            F.when(F.col("cr_number") != "", F.concat(urls.origin(F.col("url")), F.lit("/Home/FactoryDetails/"), F.col("cr_number"))), "url"
        ).alias("source_url"),
        F.lit(0.72).alias("confidence_score"),
    )


# --- main content, sections and profiles -------------------------------------------------------------------------------


def main_root() -> str:
    """The element that holds the main content: the first selector with more than 80 characters, else the first there is, else body."""
    def cond(kind: str, value: str) -> str:
        return {"tag": f"n.tag = '{value}'", "role": f"n.attrs['role'] = '{value}'", "class": h.has_class("n", value), "id": f"n.id = '{value}'"}[kind]

    firsts = [h.first_of(cond(*s)) for s in fv.MAIN_CONTENT_SELECTORS]
    found = f"filter(array({', '.join(firsts)}), o -> o IS NOT NULL)"
    body = h.first_of("n.tag = 'body'")
    return let_sql(found, "roots", f"coalesce(get(filter(roots, o -> length({h.line_of('o')}) > 80), 0), get(roots, 0), {body})")


def main_content(parsed: DataFrame) -> DataFrame:
    """(page_id, root_tag, main_text): text of the main element without its side blocks."""
    blocks = f"filter({h.within('root')}, n -> ({h.is_tag('n', *fv.SIDE_TAGS)} OR {h.has_class('n', *fv.SIDE_CLASSES)} OR n.id = 'sidebar'))"
    outer = f"filter({blocks}, n -> NOT exists({blocks}, a -> {h.inside('n', 'a')}))"
    pieces = """transform(sequence(0, size(cuts)), i -> substring(text,
        if(i = 0, root.start, get(cuts, i - 1).start + get(cuts, i - 1).len) + 1,
        greatest(if(i = size(cuts), root.start + root.len, get(cuts, i).start) - if(i = 0, root.start, get(cuts, i - 1).start + get(cuts, i - 1).len), 0)))"""
    text = let_sql(main_root(), "root", f"named_struct('root_tag', root.tag, 'main_text', {let_sql(outer, 'cuts', f'''trim(regexp_replace(array_join({pieces}, ' '), '[\\\\s]+', ' '))''')})")
    return parsed.select("page_id", F.expr(text).alias("_m")).select("page_id", "_m.root_tag", "_m.main_text")


def with_main(parsed: DataFrame) -> DataFrame:
    """Adds ``root``, the main element, and ``main``, its elements without side blocks."""
    side = f"{h.is_tag('a', *fv.SIDE_TAGS)} OR {h.has_class('a', *fv.SIDE_CLASSES)} OR coalesce(a.id, '') = 'sidebar'"
    main = (
        f"transform(array(filter(nodes, a -> {side})), sides -> filter({h.within('root')}, "
        "n -> NOT exists(sides, a -> n.seq >= a.seq AND n.seq <= a.last)))[0]"
    )
    return parsed.withColumn("root", F.expr(main_root())).withColumn("main", F.expr(main))


def article_sections(parsed: DataFrame) -> DataFrame:
    """One record per heading section of the main content: heading to next heading, with labelled lines."""
    heads = f"filter(main, n -> n.tag IN ('h2', 'h3', 'h4') AND length({h.line_of('n')}) > 2)"
    make = f"""transform(heads, (k, i) -> named_struct('title', {h.line_of('k')},
        'from', k.start + k.len, 'upto', coalesce(get(heads, i + 1).start, root.start + root.len), 'seq', k.last, 'next', coalesce(get(heads, i + 1).seq, root.last + 1)))"""
    sections = let_sql(heads, "heads", make)
    lines = f"filter(transform(filter(main, n -> n.seq > s.seq AND n.seq < s.next AND n.tag IN ('p', 'li', 'div')), o -> {h.line_of('o')}), x -> x <> '')"
    parsed = with_main(parsed)
    rows = parsed.select(
        "page_id", "url",
        F.posexplode(
            F.expr(
                f"transform({sections}, s -> named_struct('title', s.title, 'lines', {lines}, "
                rf"'block', trim(regexp_replace(substring(text, s.from + 1, s.upto - s.from), r'\s+', ' '))))"
            )
        ).alias("section_no", "s"),
    )
    joined = F.array_join("s.lines", "\n")
    site = urls.website_candidate(F.coalesce(tx.labelled_line(joined, "Website"), F.regexp_extract("s.block", r"(?i)\bwebsite\b\s*[:\-]\s*(\S+)", 1)))
    name = tx.split_title(F.col("s.title"))
    out = rows.where(
        ~F.col("s.title").rlike(fv.SECTION_SKIP)
        & (F.length("s.block") > 0)
        & ((F.length("s.block") >= 20) | F.col("s.block").rlike(r"(?i)\b(website|email|phone|location)\b\s*:"))
    ).select(
        "page_id", "section_no", "url", name.alias("_n"),
        F.coalesce(site, urls.website_from_name(name["name_en"])).alias("website_url"),
        F.coalesce(
            F.when(tx.labelled_line(joined, "Email").rlike(tx.MAIL_SHAPE), tx.labelled_line(joined, "Email")),
            F.when(F.regexp_extract("s.block", rf"(?i)\bemail\b\s*[:\-]?\s*({tx.MAIL_IN_TEXT})", 1) != "", F.regexp_extract("s.block", rf"(?i)\bemail\b\s*[:\-]?\s*({tx.MAIL_IN_TEXT})", 1)),
        ).alias("email"),
        F.coalesce(tx.first_phone(tx.labelled_line(joined, "Phone")), tx.labelled_line(joined, "Phone")).alias("phone"),
        tx.labelled_line(joined, "Location").alias("full_address"),
        F.get(
            F.filter("s.lines", lambda x: x.rlike("[a-zA-Z]") & (F.length(x) > 40) & ~x.rlike("(?i)^(website|email|phone|location):")), F.lit(0)
        ).alias("description_en"),
    )
    contact = F.coalesce("website_url", "email", "phone").isNotNull()
    return out.select(
        "page_id", "section_no", F.col("_n.name_en").alias("name_en"), F.col("_n.name_ar").alias("name_ar"), "website_url", "email", "phone",
        "full_address", "description_en", F.col("url").alias("source_url"), F.when(contact, 0.72).otherwise(0.6).alias("confidence_score"),
    )


def profiles(parsed: DataFrame) -> DataFrame:
    """One record of a profile page: title, then labelled or marked contacts inside the main content.

    Pages whose own heading names another company than the title are left out.
    """
    def one_line(sql: str) -> Column:
        return F.expr(f"transform(array({sql}), o -> {h.line_of('o')})[0]")

    in_root = lambda cond: f"get(filter(main, n -> {cond}), 0)"
    base = once(with_main(parsed).select("page_id", "url", "text", "nodes", "main"),
        one_line(h.first_of("n.tag = 'h1'")).alias("_h1"), one_line(h.first_of("n.tag = 'title'")).alias("_doc"),
        F.expr(h.meta("og:title", "property")).alias("_og"),
        one_line(in_root("n.tag = 'h1'")).alias("_own"),
        F.expr(f"{in_root('''n.tag = 'a' AND startswith(n.attrs['href'], 'tel:')''')}.attrs['href']").alias("_tel"),
        one_line(in_root("n.attrs['itemprop'] = 'telephone'")).alias("_telprop"),
        F.expr(f"{in_root('''n.attrs['data-cfemail'] IS NOT NULL''')}.attrs['data-cfemail']").alias("_hex"),
        F.expr(f"{in_root('''n.tag = 'a' AND contains(n.attrs['href'], 'email-protection#')''')}.attrs['href']").alias("_prot"),
        F.expr(f"{in_root('''n.tag = 'a' AND startswith(n.attrs['href'], 'mailto:')''')}.attrs['href']").alias("_mail"),
        F.expr(f"{in_root('''n.tag = 'a' AND n.attrs['itemprop'] = 'url' AND startswith(n.attrs['href'], 'http') AND NOT n.attrs['href'] RLIKE 'ksa.directory|saudidir.com|maps.app.|google.com/maps|facebook.com|instagram.com|linkedin.com' ''')}.attrs['href']").alias("_site"),
        F.expr(h.meta("og:description", "property")).alias("_ogdesc"),
        F.expr(f"{in_root('''n.attrs['data-description'] IS NOT NULL''')}.attrs['data-description']").alias("_datadesc"),
        profile_logo().alias("logo_url"),
        one_line(in_root("n.tag = 'address' OR n.attrs['itemprop'] IN ('address', 'streetAddress') OR " + h.has_class("n", "address"))).alias("_address"),
    ).drop("text", "nodes", "main")
    vague = lambda c: (F.coalesce(c, F.lit("")) == "") | F.lower(c).isin(*fv.GENERIC_TITLES)
    title = F.coalesce(
        F.when(~vague(F.col("_og")), F.col("_og")), F.when(~vague(F.col("_doc")), F.col("_doc")), F.when(~vague(F.col("_h1")), F.col("_h1")),
        *[F.when(F.col(c) != "", F.col(c)) for c in ("_og", "_doc", "_h1")],
    )
    titled = once(base, tx.split_title(F.regexp_replace(title, r"(?i)\s*\|\s*saudi\s+industry\s+guide\s*$", "")).alias("_t"))
    other = ~vague(F.col("_own")) & F.col("_own").rlike("[A-Za-z]") & (tx.token_overlap(F.col("_own"), F.col("_t.name_en")) < 0.34)
    digits = lambda c: F.when(F.length(F.regexp_replace(c, r"\D", "")).between(7, 15), F.regexp_replace(c, r"\D", ""))
    mailto = F.regexp_extract("_mail", r"(?i)^mailto:([^?]+)", 1)
    return titled.where((F.length("_t.name_en") >= 2) & ~other).select(
        "page_id", F.col("_t.name_en").alias("name_en"), F.col("_t.name_ar").alias("name_ar"),
        F.coalesce(digits(F.col("_tel")), digits(F.col("_telprop"))).alias("phone"),
        F.coalesce(
            tx.decode_hex_mail(F.col("_hex")), tx.decode_hex_mail(F.substring_index("_prot", "#", -1)), F.when(mailto.rlike(tx.MAIL_SHAPE), mailto)
        ).alias("email"),
        F.coalesce("_site", urls.website_from_name(F.col("_t.name_en"))).alias("website_url"),
        F.coalesce(F.when(F.length("_ogdesc") > 20, F.col("_ogdesc")), F.when(F.length("_datadesc") > 15, F.col("_datadesc")), F.when(F.length("_og") > 5, F.col("_og"))).alias("description_en"),
        "logo_url",
        F.col("_address").alias("full_address"), F.col("url").alias("source_url"),
    )


# what may hold a profile's logo inside its logo box: (condition on the element, attribute), in order of trust
_LOGO_PLACES = [
    ("n.tag = 'img'", "src"), ("n.tag = 'img'", "data-src"),
    ("n.tag = 'source' AND contains(n.attrs['srcset'], '.svg')", "srcset"), ("n.tag = 'source'", "srcset"),
    ("n.tag = 'object'", "data"), ("n.tag = 'embed'", "src"),
    ("n.tag = 'use' AND NOT startswith(coalesce(n.attrs['href'], n.attrs['xlink:href']), '#')", "href"), ("n.tag = 'image'", "href"),
]


def profile_logo() -> Column:
    """Logo of a profile page: og:image, the listing's slider or marked image, then the places of a logo box."""
    og = F.expr(h.meta("og:image", "property"))
    slider = F.expr(
        "get(" + h.all_under("n.tag = 'img' AND (n.attrs['itemprop'] = 'image' OR startswith(n.attrs['src'], 'http'))", h.has_class("a", "product-slider")) + ", 0).attrs"
    )
    slide = F.coalesce(slider["src"], slider["data-src"])
    marked = F.expr(h.first_of("n.tag = 'img' AND n.attrs['itemprop'] = 'image'") + ".attrs['src']")
    inside_logo = h.has_class("a", "logo")
    found = []
    for cond, name in _LOGO_PLACES:
        value = f"coalesce(o.attrs['{name}'], o.attrs['xlink:{name}'])"
        if name == "srcset":
            value = f"regexp_extract(trim({value}), r'^([^\\s,]+)', 1)"
        place = f"get(transform({h.all_under(cond, inside_logo)}, o -> nullif(trim({value}), '')), 0)"
        found.append(F.expr(place))
    good = lambda c: F.when(c.rlike("^(?i:https?)://"), c)
    return F.coalesce(
        F.when(~og.rlike("(?i)/site/img/logo\\.svg"), good(og)), good(slide),
        *[F.when(c.isNotNull(), urls.resolve(c, F.col("url"))) for c in (marked, *found)],
    )


def best_address(candidates: DataFrame, key: str) -> DataFrame:
    """The likeliest address of several: digits, street words, city, length and commas count, brevity decides."""
    a = F.col("address")
    points = (
        a.rlike(r"\d").cast("int") + a.rlike(r"(?i)\b(road|rd|street|st|district|area|po box|p\.o\.|building|bldg)\b").cast("int")
        + tx.city_in(a).isNotNull().cast("int") + a.contains(",").cast("int") + F.length(a).between(10, 160).cast("int")
    )
    best = candidates.groupBy(key).agg(F.max_by("address", F.struct(points, -F.length(a))).alias("address"))
    return best


def api_listing(responses: DataFrame, profile_prefix: str) -> DataFrame:
    """Vendors of a JSON listing: the first of the three places that holds a ``data`` array."""
    doc = responses.withColumn("_d", F.try_parse_json("body"))
    items = F.coalesce(*[F.try_variant_get("_d", p, "array<variant>") for p in ("$.data.result.data", "$.result.data", "$.data")])
    rows = doc.select("page_id", "url", F.posexplode(items).alias("ordinal", "v"))
    g = lambda p: F.when(F.trim(F.try_variant_get("v", f"$.{p}", "string")) != "", F.trim(F.try_variant_get("v", f"$.{p}", "string")))
    out = rows.select(
        "page_id", "ordinal", tx.display_name(g("name")).alias("name_en"), g("details").alias("description_en"), g("address").alias("full_address"),
        g("image").alias("logo_url"), F.coalesce(F.concat(F.lit(profile_prefix), g("subdomain")), "url").alias("source_url"),
        F.lit(0.78).alias("confidence_score"),
    )
    return out.where(F.length("name_en") > 1)
