"""URL columns.

Every function takes and returns a Column made of built-in expressions, so URL
work stays inside whole-stage code generation next to the scan.  The parts are
cut with one RFC 3986 pattern instead of ``parse_url``: the latter rejects urls
with spaces or braces that real pages contain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

# scheme, authority, path, query, fragment
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _col(u) -> Column:
    return F.col(u) if isinstance(u, str) else u


def _part(u, n: int) -> Column:
    return F.regexp_extract(F.coalesce(_col(u), F.lit("")), _URI, n)


def scheme(u) -> Column:
    return F.lower(_part(u, 1))


def netloc(u) -> Column:
    return _part(u, 2)


def path(u) -> Column:
    return _part(u, 3)


def query(u) -> Column:
    return _part(u, 4)


def hostname(u) -> Column:
    """Lower-cased host without user info and port."""
    h = F.regexp_replace(netloc(u), r"^.*@", "")
    return F.lower(F.regexp_replace(h, r":\d*$", ""))


def segments(u) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(u), "/"), lambda s: s != "")


def drop_fragment(u) -> Column:
    return F.split_part(_col(u), F.lit("#"), F.lit(1))


def rtrim_slash(u) -> Column:
    return F.regexp_replace(_col(u), r"/+$", "")


def _unquote(s: Column) -> Column:
    return F.coalesce(F.try_url_decode(s), F.replace(s, F.lit("+"), F.lit(" ")))


def _quote(s: Column) -> Column:
    # Java leaves '*' bare and escapes '~'; form encoding does the reverse.
    return F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def clean_query(q: Column, tracking: str | None) -> Column:
    """Decode, drop tracking keys, sort by (key, value), encode again."""
    pairs = F.transform(
        F.filter(F.split(q, "&"), lambda s: s != ""),
        lambda s: F.struct(
            _unquote(F.regexp_extract(s, r"(?s)^([^=]*)", 1)).alias("k"),
            _unquote(F.regexp_extract(s, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    if tracking:
        pairs = F.filter(pairs, lambda p: ~p["k"].rlike(tracking))
    return F.array_join(
        F.transform(F.array_sort(pairs), lambda p: F.concat(_quote(p["k"]), F.lit("="), _quote(p["v"]))),
        "&",
    )


def _join(sch: Column, net: Column, pth: Column, qry: Column) -> Column:
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(""),
        F.when(net != "", F.concat(F.lit("//"), net)).otherwise(""),
        F.when((net != "") & (pth != "") & ~pth.startswith("/"), F.concat(F.lit("/"), pth)).otherwise(pth),
        F.when(qry != "", F.concat(F.lit("?"), qry)).otherwise(""),
    )


def normalize_url(u, strip: bool = True) -> Column:
    """Page identity in a link graph."""
    p = F.regexp_replace(path(u), r";[^/]*$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    p = F.when(F.length(p) > 1, rtrim_slash(p)).otherwise(p)
    q = clean_query(query(u), K.TRACKING_LINK if strip else None)
    return _join(scheme(u), F.lower(netloc(u)), p, q)


def norm_state_url(u) -> Column:
    """State identity: authority case is kept, an empty path stays empty."""
    return _join(scheme(u), netloc(u), rtrim_slash(path(u)), clean_query(query(u), K.TRACKING_STATE))


def nav_state_key(u) -> Column:
    return F.concat(F.lit("u::"), norm_state_url(u))


def norm_light(u) -> Column:
    """Trailing slashes go first and the fragment second, so ``x/#f`` keeps its slash."""
    return F.split_part(rtrim_slash(F.coalesce(_col(u), F.lit(""))), F.lit("#"), F.lit(1))


def host_key(u, subdomains: bool = False) -> Column:
    h = F.regexp_replace(hostname(u), r"^www\.", "")
    if not subdomains:
        return h
    labels = F.split(h, r"\.")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(h)


def same_host(a, b) -> Column:
    return host_key(a) == host_key(b)


def section_key(u) -> Column:
    q = query(u)
    first = F.coalesce(F.try_element_at(segments(u), F.lit(1)), F.lit("root"))
    return F.concat(first, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def section_of(u) -> Column:
    return F.coalesce(F.try_element_at(segments(u), F.lit(1)), F.lit("home"))


def _last_two(u) -> Column:
    s = segments(u)
    tail = F.when(F.size(s) <= 2, s).otherwise(F.slice(s, -2, 2))
    return F.concat(F.lit("/"), F.array_join(tail, "/"))


def url_path(u) -> Column:
    """Last two path segments; null where the value is not an absolute url."""
    return F.when((scheme(u) != "") & (netloc(u) != ""), _last_two(u))


def short_label(u, title) -> Column:
    t = F.regexp_replace(F.coalesce(_col(title), F.lit("")), r"^⚠ ", "")
    return F.when(F.coalesce(_col(u), F.lit("")) != "", _last_two(u)).otherwise(F.substring(t, 1, 24))


def is_direct_download(u) -> Column:
    low = F.lower(F.coalesce(_col(u), F.lit("")))
    # ".jpg" and friends end the path; the pattern is one alternation over the fixed list.
    ends = r"\.(" + "|".join(K.DOWNLOAD_EXTENSIONS) + r")$"
    p = F.regexp_replace(path(low), r";[^/]*$", "")
    return low.startswith("blob:") | low.startswith("data:") | p.rlike(ends)


def is_crawlable(href, base_host, subdomains: bool = False) -> Column:
    h = F.coalesce(_col(href), F.lit(""))
    return (
        (h != "")
        & ~h.rlike(K.SKIP_HREF)
        & h.rlike(r"(?i)^https?://")
        & (host_key(h, subdomains) == _col(base_host))
    )


def url_changed(after, before) -> Column:
    return rtrim_slash(F.coalesce(_col(after), F.lit(""))) != rtrim_slash(F.coalesce(_col(before), F.lit("")))


def resolve(base, href) -> Column:
    """Absolute form of an href found on page ``base``."""
    b, h = _col(base), F.trim(_col(href))
    root = F.concat(scheme(b), F.lit("://"), netloc(b))
    base_path = path(b)
    folder = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*$", "")
    tail = F.regexp_extract(h, r"(?s)^[^?#]*(.*)$", 1)
    rel = F.regexp_extract(h, r"(?s)^([^?#]*)", 1)
    merged = F.when(rel.startswith("/"), rel).otherwise(F.concat(folder, rel))
    # remove dot segments: walk the segments, '..' drops the one before
    segs = F.split(F.regexp_replace(merged, r"^/", ""), "/")
    walked = F.aggregate(
        F.filter(segs, lambda s: s != "."),
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(
            s == "..",
            F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    ends_dot = merged.rlike(r"(^|/)\.\.?$")
    clean = F.concat(
        F.lit("/"),
        F.array_join(walked, "/"),
        F.when(ends_dot & (F.size(walked) > 0), F.lit("/")).otherwise(""),
    )
    # the walk is interpreted, so it runs only where a dot segment exists
    abs_path = F.when(merged.rlike(r"(^|/)\.\.?(/|$)"), clean).otherwise(merged)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(b), F.lit(":"), h))
        .when(h == "", drop_fragment(b))
        .when(h.startswith("#"), F.concat(drop_fragment(b), h))
        .when(h.startswith("?"), F.concat(root, base_path, h))
        .otherwise(F.concat(root, abs_path, tail))
    )
