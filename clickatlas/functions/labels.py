"""Label, goal and text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import urls


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _or_empty(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def collapse(c) -> Column:
    """Trim and squeeze white space."""
    return F.trim(F.regexp_replace(_or_empty(c), r"[\s\x{00A0}]+", " "))


def word_pattern(words) -> str:
    return r"(?iuU)\b(" + "|".join(words) + r")\b"


CREATE_PATTERN = word_pattern(K.CREATE_VERBS)
GOAL_VERB_PATTERN = word_pattern(K.GOAL_VERBS)


def is_create_label(c) -> Column:
    return _or_empty(c).rlike(CREATE_PATTERN)


def classify_label(c) -> Column:
    """The label families, as one struct of flags."""
    t = _or_empty(c)
    return F.struct(
        t.rlike(K.DESTRUCTIVE).alias("destructive"),
        t.rlike(K.WRITE).alias("write"),
        t.rlike(K.DOWNLOAD_LABEL).alias("download"),
        t.rlike(K.SKIP_NAV).alias("skip_nav"),
        t.rlike(CREATE_PATTERN).alias("trigger"),
    )


def words(c) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(_or_empty(c)), F.lit(r"(?U)(\w+)"), F.lit(1))


def goal_nouns(c) -> Column:
    stop = list(K.GOAL_STOPWORDS)
    return F.filter(words(c), lambda w: ~w.isin(stop) & (F.length(w) > 2))


def noun_forms(noun: Column) -> Column:
    """The word forms a goal noun accepts in a label."""
    return F.array(noun, F.concat(noun, F.lit("s")), F.concat(noun, F.lit("es")))


def _literal_pattern(w: Column) -> Column:
    # tokens hold word characters only, so no escaping is needed
    return w


def goal_needle(nouns: Column) -> Column:
    """Pattern text that finds a goal verb within 30 characters of a goal noun."""
    verbs = "|".join(K.GOAL_VERBS)
    alt = F.concat(F.lit(r"\b(?:"), F.array_join(F.transform(nouns, _literal_pattern), "|"), F.lit(r")(?:es|s)?\b"))
    return F.when(
        F.size(nouns) > 0,
        F.concat(
            F.lit(r"(?iuU)(?:" + verbs + r")\b.{0,30}"), alt, F.lit("|"), alt,
            F.lit(r".{0,30}\b(?:" + verbs + r")"),
        ),
    ).otherwise(F.lit(GOAL_VERB_PATTERN))


def stale_nouns(c) -> Column:
    """Goal words used to mark stale triggers; a different list from goal_nouns."""
    toks = F.filter(F.split(F.lower(_or_empty(c)), r"\s+"), lambda w: w != "")
    return F.filter(toks, lambda w: ~w.isin(list(K.STALE_STOPWORDS)))


def stem_tokens(c) -> Column:
    toks = F.regexp_extract_all(_or_empty(c), F.lit(r"([A-Za-z0-9]+)"), F.lit(1))
    kept = F.filter(
        F.transform(toks, lambda w: F.lower(w)),
        lambda w: (F.length(w) > 2) & ~w.isin(list(K.SUGGEST_STOPWORDS)),
    )
    return F.array_distinct(
        F.transform(
            kept,
            lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w),
        )
    )


def form_field_count(form) -> Column:
    f = _col(form)
    return F.coalesce(f["fieldCount"], F.greatest(F.size(f["fields"]), F.lit(0)), F.lit(0))


def form_confidence(kind, form) -> Column:
    return F.when(
        (F.lower(_or_empty(kind)) == "download") | (form_field_count(form) > 0), F.lit("high")
    ).otherwise(F.lit("low"))


def item_text(t, cells) -> Column:
    return F.trim(F.concat_ws(" ", F.array(_or_empty(t)), _col(cells)))


def label_of(url, title, node_id) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(_col(url), blank), F.nullif(_col(title), blank), _col(node_id))


def slug(c, default: str = "file") -> Column:
    s = F.regexp_replace(F.lower(_or_empty(c)), r"[^\p{L}\p{N}]", "-")
    s = F.regexp_replace(F.regexp_replace(s, r"^-+|-+$", ""), r"-{2,}", "-")
    s = F.substring(s, 1, 40)
    return F.when(s == "", F.lit(default)).otherwise(s)


def suggest_filename(href, accept, label) -> Column:
    base = F.regexp_extract(urls.path(_or_empty(href)), r"([^/]*)$", 1)
    first = F.trim(F.split_part(_or_empty(accept), F.lit(","), F.lit(1)))
    ext = (
        F.when(first.startswith("."), first)
        .when(
            first.contains("/") & ~first.endswith("*"),
            F.concat(F.lit("."), F.regexp_extract(first, r"([^/]*)$", 1)),
        )
        .otherwise("")
    )
    return F.when((base != "") & base.contains("."), base).otherwise(F.concat(slug(label, "download"), ext))


def field_placeholder(field) -> Column:
    """Value to put into a form field: first option, else value, else a named blank."""
    f = _col(field)
    lab = F.lower(F.trim(F.coalesce(F.nullif(f["label"], F.lit("")), F.lit("value"))))
    named = F.replace(slug(lab, "value"), F.lit("-"), F.lit(" "))
    return F.coalesce(
        F.try_element_at(f["options"], F.lit(1)),
        F.nullif(f["value"], F.lit("")),
        F.concat(F.lit("<"), named, F.lit(">")),
    )


def is_truthy(c) -> Column:
    return ~F.lower(F.trim(_or_empty(c))).isin(list(K.FALSY_WORDS))


def id_num(c) -> Column:
    """Trailing digits of a state id, 0 without any."""
    return F.coalesce(F.nullif(F.regexp_extract(_or_empty(c), r"(\d+)$", 1), F.lit("")).cast("bigint"), F.lit(0))


def valid_host(c) -> Column:
    t = _or_empty(c)
    return t.rlike(r"^[A-Za-z0-9._-]+$") & ~t.rlike(r"^\.+$")


def valid_scope(c) -> Column:
    t = F.trim(F.when(_or_empty(c) == "", F.lit("default")).otherwise(_or_empty(c)))
    return t.rlike(r"^[A-Za-z0-9._-]+$") & ~t.rlike(r"^\.+$")


def derive_title(c) -> Column:
    return F.nullif(F.substring(collapse(c), 1, K.TITLE_CHARS), F.lit(""))


def truncate(c, n: int = K.WIRE_TEXT_CHARS) -> Column:
    t = _col(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(K.TRUNCATION_MARK))).otherwise(t)


def tier(kind, single_url: bool = False) -> Column:
    """Order in which children of one depth are explored."""
    k = _col(kind)
    return (
        F.when(k.isin("link", "tab"), 1)
        .when(k == "row", 2)
        .when(k == "menu", 3)
        .when(k.isin("external", "iframe"), 4 if single_url else 1)
        .otherwise(1)
    )


def mint_node_id(parent, kind: str, selector, label) -> Column:
    """Id of a skipped, upload or download node under its page."""
    key = F.concat(_or_empty(selector), _or_empty(label))
    return F.concat(_col(parent), F.lit("##" + kind + ":"), F.substring(F.sha1(key.cast("binary")), 1, 6))


def page_state_sig(url, hrefs, action_keys) -> Column:
    """Short hash of a page: its url, its hrefs and its 'selector>text' keys."""
    basis = F.concat(
        urls.normalize_url(url), F.lit("|"),
        F.array_join(F.array_sort(_col(hrefs)), "|"), F.lit("||"),
        F.array_join(F.array_sort(_col(action_keys)), "|"),
    )
    return F.substring(F.sha1(basis.cast("binary")), 1, 10)


def shell_state_sig(url, controls, view=None) -> Column:
    """Identity of an app-shell view: its nav and create labels, not its data."""
    c = _col(controls)
    kept = F.filter(
        c, lambda x: ~F.coalesce(x["bulk"], F.lit(False)) & (F.coalesce(x["nav"], F.lit(False)) | is_create_label(x["text"]))
    )
    keys = F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.substring(_or_empty(x["text"]), 1, 30))))
    base = F.concat(urls.drop_fragment(_col(url)), F.lit("||"), F.substring(F.array_join(keys, "|"), 1, 2000))
    if view is None:
        return base
    v = _col(view)
    marks = F.substring(F.array_join(F.array_sort(F.array_distinct(v)), "|"), 1, 300)
    return F.when(
        F.coalesce(F.size(v), F.lit(0)) > 0, F.concat(base, F.lit("||view="), marks)
    ).otherwise(base)
