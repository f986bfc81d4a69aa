"""URL parsing, canonical form, resolution and path rules, as column expressions.

Everything is plain string work on the parts of one regular expression, so a
malformed address yields null instead of failing the task, and host names are
compared in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradebook.functions.fixed_values import (
    ASSET_ENDINGS,
    FIRST_PUBLIC_ID,
    PAGE_PATTERNS,
    PAGE_WORDS,
    PARKED_NAMES,
    SEED_TAG_WORDS,
    SOCIAL_PATTERNS,
    TRACKING_KEYS,
)
from tradebook.functions.semantics import BLANKS, blank_to_null, let, let_sql, sql_on

# Fixed patterns.  Group 1 of _VALID and _SITE is the host.
_PARTS = r"^(?i:(https?))://([^/?#\\]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
_HOST = r"""(?:[^/?#\\]*@)?([^\s/?#\\@:<>^|%\[\]`{}"]+)"""
_VALID = rf"^(?i:https?)://{_HOST}(?::\d*)?(?:[/?#]|$)"
_PORT = r"^(?i:https?)://[^/?#\\]*:(\d+)(?:[/?#]|$)"
_SITE = rf"^\s*(?:https?://)?{_HOST}(?::\d*)?(?:[/?#]|\s*$)"
_PATH = r"^\s*(?:https?://)?[^/?#\\]+([^?#]*)"
_SAFE_PATH = r"^[\x21\x23-\x3b\x3d\x40-\x5d\x5f\x61-\x7a\x7c\x7e]*$"
_TRACKED = "^(?i:" + "|".join(TRACKING_KEYS) + ")$"


# --- pieces of SQL text ---------------------------------------------------------------------


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, r'^[{BLANKS}]+|[{BLANKS}]+$', '')"


def _absolute(x: str) -> str:
    """Trimmed, with https:// in front when no http(s) scheme is there."""
    body = "CASE WHEN t = '' THEN NULL WHEN t RLIKE '^https?://' THEN t ELSE concat('https://', t) END"
    return let_sql(_trimmed(x), "t", body)


def _escaped(x: str) -> str:
    """Percent-encode what a URL path may not hold; the usual all-safe path is passed through."""
    one = f"CASE WHEN ch RLIKE r'{_SAFE_PATH}' THEN ch ELSE replace(url_encode(ch), '+', '%20') END"
    body = f"CASE WHEN e RLIKE r'{_SAFE_PATH}' THEN e ELSE array_join(transform(split(e, ''), ch -> {one}), '') END"
    return let_sql(x, "e", body)


def _folded(x: str) -> str:
    """Remove '.' and '..' segments of an absolute path; paths without them are passed through."""
    step = (
        "CASE WHEN seg = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN seg = '.' THEN acc "
        "ELSE concat(acc, array(seg)) END"
    )
    segments = "slice(split(f, '/'), 2, greatest(size(split(f, '/')) - 1, 0))"
    joined = f"concat('/', array_join(aggregate({segments}, cast(array() AS array<string>), (acc, seg) -> {step}), '/'))"
    closed = rf"CASE WHEN f RLIKE r'/\.{{1,2}}$' THEN regexp_replace(concat({joined}, '/'), '//$', '/') ELSE {joined} END"
    return let_sql(x, "f", rf"CASE WHEN f RLIKE r'/\.{{1,2}}(/|$)' THEN {closed} ELSE f END")


def _parsed(x: str) -> str:
    """struct(scheme, userinfo, host, port, path, query, fragment) of an absolute http(s) URL, or null.

    host is lower case; a port equal to the scheme's default is ''; path is at
    least '/'; query and fragment keep their leading mark.
    """
    raw = rf"""CASE WHEN u RLIKE r'{_VALID}' THEN named_struct(
      'scheme', lower(regexp_extract(u, r'{_PARTS}', 1)),
      'userinfo', regexp_extract(u, r'^[^/]*//([^/?#\\]*@)', 1),
      'host', lower(regexp_extract(u, r'{_VALID}', 1)),
      'port', regexp_extract(u, r'{_PORT}', 1),
      'path', regexp_extract(u, r'{_PARTS}', 3),
      'query', regexp_extract(u, r'{_PARTS}', 4),
      'fragment', regexp_extract(u, r'{_PARTS}', 5)) END"""
    tidy = f"""CASE WHEN w IS NOT NULL THEN named_struct(
      'scheme', w.scheme, 'userinfo', w.userinfo, 'host', w.host,
      'port', CASE WHEN w.port = if(w.scheme = 'http', '80', '443') THEN '' ELSE w.port END,
      'path', CASE WHEN w.path = '' THEN '/' ELSE {_escaped(_folded("w.path"))} END,
      'query', if(w.query = '?', '', w.query), 'fragment', w.fragment) END"""
    return let_sql(let_sql(x, "u", raw), "w", tidy)


def _decoded(x: str) -> str:
    return f"coalesce(try_url_decode({x}), {x})"


def _query(x: str, sort: bool) -> str:
    """Query with tracking keys out, values re-encoded form-style, keys sorted on demand."""
    key = _decoded("regexp_extract(kv, r'^([^=]*)', 1)")
    value = _decoded(r"regexp_extract(kv, r'^[^=]*=([\s\S]*)$', 1)")
    pairs = f"filter(split(substring({x}, 2), '&'), kv -> kv <> '' AND NOT {key} RLIKE r'{_TRACKED}')"
    rows = f"transform({pairs}, (kv, i) -> named_struct('k', lower({key}), 'i', i, 'key', {key}, 'value', {value}))"
    if sort:
        rows = f"array_sort({rows})"
    text = f"array_join(transform({rows}, kv -> concat(url_encode(kv.key), '=', url_encode(kv.value))), '&')"
    mark = let_sql(text, "q", "if(q = '', q, concat('?', q))")
    return f"CASE WHEN {x} = '' THEN '' ELSE {mark} END"


def _assembled(p: str, scheme: str, host: str, port: str, path: str, query: str) -> str:
    return (
        f"CASE WHEN {p} IS NOT NULL THEN concat({scheme}, '://', {p}.userinfo, {host}, "
        f"if({port} = '', '', concat(':', {port})), {path}, {query}, {p}.fragment) END"
    )


_NO_WWW = r"regexp_replace(p.host, r'^www\.', '')"
_NO_SLASH = "if(length(p.path) > 1, regexp_replace(p.path, '/$', ''), p.path)"
_CANONICAL = let_sql(
    _parsed(_absolute("v")), "p",
    _assembled("p", "'https'", _NO_WWW, "if(p.port = '443', '', p.port)", _NO_SLASH, _query("p.query", True)),
)
_NORMAL = let_sql(
    _parsed(_absolute("v")), "p",
    _assembled("p", "p.scheme", _NO_WWW, "p.port", _NO_SLASH, _query("p.query", False)),
)
_UNTRACKED = let_sql(
    _parsed(_absolute("v")), "p",
    _assembled("p", "p.scheme", "p.host", "p.port", "p.path", _query("p.query", False)),
)


# --- columns ----------------------------------------------------------------------------------


def parse(url: Column) -> Column:
    """struct(scheme, userinfo, host, port, path, query, fragment); a missing scheme is supplied; null when invalid."""
    return sql_on(url, "v", _parsed(_absolute("v")))


def canonical_url(url: Column) -> Column:
    """https, no leading www., no trailing slash, no tracking keys, sorted parameters; null when invalid.

    The fragment and a non-default port stay.  Tracking keys are compared in
    lower case on both sides, so mixed-case ones are dropped too.
    """
    return sql_on(url, "v", _CANONICAL)


def normal_url(url: Column) -> Column:
    """As ``canonical_url`` but keeps the protocol and the order of parameters."""
    return sql_on(url, "v", _NORMAL)


def untracked_url(url: Column) -> Column:
    """Only tracking keys are removed; an unparsable value is returned as is."""
    return sql_on(url, "v", f"coalesce({_UNTRACKED}, v)")


def same_url(a: Column, b: Column) -> Column:
    """Both are valid and share one canonical form."""
    return F.coalesce(canonical_url(a) == canonical_url(b), F.lit(False))


def comparable_url(url: Column) -> Column:
    """Canonical form, else the lower-cased text; '' for nothing."""
    return sql_on(url, "v", f"CASE WHEN v IS NULL OR v = '' THEN '' ELSE coalesce({_CANONICAL}, lower({_trimmed('v')})) END")


def domain(url: Column) -> Column:
    """Lower-case host without www.; the scheme may be missing.  One pattern, no parsing."""
    return blank_to_null(F.regexp_replace(F.lower(F.regexp_extract(url, _SITE, 1)), r"^www\.", ""))


def host(url: Column) -> Column:
    """Lower-case host of an absolute URL, www. kept; null otherwise."""
    return blank_to_null(F.lower(F.regexp_extract(url, r"^\s*" + _VALID[1:], 1)))


def path(url: Column) -> Column:
    """Path of a URL, at least '/'; null for nothing."""
    p = F.regexp_extract(url, _PATH, 1)
    return F.when(p == "", "/").otherwise(p)


def origin(url: Column) -> Column:
    """scheme://host[:port] of an absolute URL."""
    return blank_to_null(F.lower(F.regexp_extract(url, r"^\s*((?i:https?)://[^\s/?#\\@]+)", 1)))


def is_valid_url(url: Column) -> Column:
    """Names a host once a missing scheme is supplied."""
    return F.coalesce(url.rlike(_SITE), F.lit(False))


def is_absolute_url(url: Column) -> Column:
    """An http(s) URL with a host as it stands."""
    return F.coalesce(url.rlike(_VALID), F.lit(False))


_ROOT = "concat(l.b.scheme, '://', l.b.userinfo, l.b.host, if(l.b.port = '', '', concat(':', l.b.port)))"
_OWN = let_sql(_parsed("y.r"), "o", _assembled("o", "o.scheme", "o.host", "o.port", "o.path", "o.query"))
_REL_PATH, _REL_TAIL = r"regexp_extract(l.r, r'^([^?#]*)', 1)", r"regexp_extract(l.r, r'^[^?#]*([\s\S]*)$', 1)"
_FOLDER = "regexp_replace(l.b.path, r'[^/]*$', '')"
# a link without a scheme of its own; only here the base is taken apart
_RELATIVE = let_sql(
    f"named_struct('r', y.r, 'b', {_parsed('y.base')}, 'raw', y.raw)", "l",
    f"""CASE WHEN l.b IS NULL THEN l.raw
      WHEN l.r = '' THEN concat({_ROOT}, l.b.path, l.b.query)
      WHEN startswith(l.r, '//') THEN concat(l.b.scheme, ':', l.r)
      WHEN startswith(l.r, '/') THEN concat({_ROOT}, {_escaped(_folded(_REL_PATH))}, {_REL_TAIL})
      WHEN startswith(l.r, '?') THEN concat({_ROOT}, l.b.path, l.r)
      WHEN startswith(l.r, '#') THEN concat({_ROOT}, l.b.path, l.b.query, l.r)
      ELSE concat({_ROOT}, {_escaped(_folded(f"concat({_FOLDER}, {_REL_PATH})"))}, {_REL_TAIL}) END""",
)
_LINK = let_sql(
    f"named_struct('r', {_trimmed('x.r')}, 'base', x.base, 'raw', x.r)", "y",
    f"""coalesce(CASE WHEN y.r RLIKE '^(?i:https?)://' THEN {_OWN}
      WHEN y.r RLIKE '^[A-Za-z][A-Za-z0-9+.-]*:' THEN y.r
      ELSE {_RELATIVE} END, y.raw)""",
)
_RESOLVED = f"CASE WHEN x.r IS NOT NULL THEN {_LINK} END"


def resolve(relative: Column, base: Column) -> Column:
    """Absolute form of a link found on ``base``; an unresolvable link is returned as is."""
    return sql_on(F.struct(relative.alias("r"), base.alias("base")), "x", _RESOLVED)


def website_from_name(name: Column) -> Column:
    """https origin when a company name is itself a bare host name."""
    n = F.trim(F.regexp_replace(name, r"\s+", " "))
    h = F.lower(
        F.regexp_replace(
            F.regexp_extract(F.regexp_replace(n, r"^(?i)https?://", ""), r"^([^\s/]*)", 1), r"^(?i)www\.", ""
        )
    )
    shaped = h.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$") & h.rlike(
        r"\.(com|net|org|io|sa|co|me|biz|info)\b"
    )
    return F.when((F.length(n) >= 4) & shaped, F.concat(F.lit("https://"), h))


def first_url_like(text: Column) -> Column:
    """First URL-looking piece of a free text; mail domains and XML namespaces do not count."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    full = blank_to_null(F.regexp_extract(t, r"(?i)(https?://[^\s\"'<>]+)", 1))
    www = blank_to_null(F.regexp_extract(t, r"(?i)\b(www\.[a-z0-9.-]+\.[a-z]{2,})\b", 1))
    bare = blank_to_null(F.regexp_extract(t, r"(?i)\b([a-z0-9.-]+\.(com|net|org|io|sa|co|me|biz|info))\b", 1))
    found = F.when(t.contains("@"), full).otherwise(F.coalesce(full, www, bare))
    return F.when(~found.rlike(r"(?i)w3\.org/2000/svg|^w3\.org$|^www\.w3\.org$"), found)


def website_candidate(text: Column) -> Column:
    """Website from a messy cell: label and trailing junk off, scheme added to a bare host."""
    v = F.trim(F.regexp_replace(text, r"\s+", " "))
    v = F.trim(F.regexp_replace(v, r"[)\].,;]+$", ""))
    v = F.trim(F.regexp_replace(v, r"(?i)(email|phone|location).*", ""))
    v = F.trim(F.regexp_replace(v, r"(?i)^website\s*[:\-]?\s*", ""))
    bare = F.regexp_replace(v, r"(?i)^www\.", "")
    bare_host = F.regexp_extract(bare, r"^([^/\s]*)", 1)
    shaped = bare_host.rlike(r"(?i)^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$")
    return F.when(v.rlike("(?i)^https?://"), v).when(shaped, F.concat(F.lit("https://"), bare))


def logo_guess(website: Column, prefix: str) -> Column:
    """Logo address built from the site's domain; the service prefix is the caller's."""
    return F.concat(F.lit(prefix), domain(website))


def classify_page(p: Column) -> Column:
    """struct(page_type, confidence) by the first of the ordered patterns; takes a lower-case path column.

    No pattern ends in a slash, so the path need not be stripped of one.  Hand in
    a column of an earlier projection, then the path is worked out once.
    """

    def verdict(kind: str, conf: float) -> Column:
        return F.struct(F.lit(kind).alias("page_type"), F.lit(conf).alias("confidence"))

    out = F.when(p.isNull(), verdict("other", 0.1)).when(
        p.isin("/", "/index.html", "/home", "/en", "/ar"), verdict("homepage", 0.95)
    )
    for word, kind, priority in PAGE_PATTERNS:
        out = out.when(p.contains(word), verdict(kind, min(0.95, 0.5 + priority / 20)))
    return out.otherwise(verdict("other", 0.3))


def classify_page_by_words(url: Column, base: Column) -> Column:
    """Second rule set: words anywhere in what follows the base address."""

    def verdict(kind: str, conf: float) -> Column:
        return F.struct(F.lit(kind).alias("page_type"), F.lit(conf).alias("confidence"))

    def ladder(rest: Column) -> Column:
        out = F.when(rest.isin("", "/", "/home", "/index.html"), verdict("homepage", 1.0))
        for kind, words in PAGE_WORDS:
            out = out.when(rest.rlike("|".join(words)), verdict(kind, 0.85))
        return out.otherwise(verdict("other", 0.1))

    return let(F.replace(F.lower(url), F.lower(base), F.lit("")), ladder)


def rank_of(value: Column, order: list[tuple[str, int]], default: int) -> Column:
    """Number of a word in a small fixed list, as a CASE ladder."""
    out = None
    for name, n in order:
        out = F.when(value == name, n) if out is None else out.when(value == name, n)
    return out.otherwise(default)


def social_url(href: Column, platform: str) -> Column:
    """The platform's part of a link, with a scheme, or null."""
    pattern = dict(SOCIAL_PATTERNS)[platform]
    hit = F.regexp_extract(href, f"(?i)({pattern})", 1)
    return F.when(hit != "", F.when(hit.startswith("http"), hit).otherwise(F.concat(F.lit("https://"), hit)))


def is_asset(url: Column) -> Column:
    """True for an address that ends like a picture, document, style or script; null for a null."""
    return url.rlike(rf"(?i)\.(?:{'|'.join(ASSET_ENDINGS)})\z")


def is_parked_name(site: Column) -> Column:
    """True when the domain name itself speaks of a parked or offered domain."""
    return F.coalesce(F.lower(site).rlike("|".join(PARKED_NAMES)), F.lit(False))


def is_public_id(text: Column) -> Column:
    """True for a text of digits that is no smaller than the first public id, however long."""
    digits = F.regexp_replace(text, "^0+", "")
    large = (F.length(digits) > len(str(FIRST_PUBLIC_ID))) | (digits.try_cast("long") >= FIRST_PUBLIC_ID)
    return F.coalesce(text.rlike(r"^[0-9]+\z") & large, F.lit(False))


def seed_tags(site: Column) -> Column:
    """Distinct tags whose word occurs in the domain."""
    return F.array_distinct(
        F.array_compact(F.array(*[F.when(site.contains(w), F.lit(tag)) for w, tag in SEED_TAG_WORDS]))
    )
