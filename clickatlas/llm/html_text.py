"""Main text of web pages by tag-path ratios.

A page is a tree of tag paths: elements with the same path of tags (with their
class and id words) share a node.  For each path the text length, the punctuation
and the text inside links are added up; inline elements count with the block they
stand in.  The ratio of a path is its text length a line, raised by its punctuation
and lowered by its links.  Ratios are smoothed along the tree (less within an
article, where a short heading belongs to its paragraphs; never to link lists),
fused with what tags and names say, and paths above a threshold are content, on
every page.

What tags and names say: navigation, footers, buttons and the like hold no
content.  Forms and elements of a boilerplate name have their score lowered, unless
they hold the page's article or long, punctuated prose without links.  Text outside
articles counts by the share of the page's text that lies there.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A path is content if its fused ratio is at least this share of the largest one.
SHARE = 0.1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|<(?=[a-zA-Z/!?])[^<]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
#: A named path keeps this share of its score.
NAMED = 0.002
#: A line this long is prose, not a label or a notice's button.
LONG = 100
#: What a path takes of its parent's ratio and gives to it, outside and inside an article.
SMOOTH, SMOOTH_RICH = 0.5, 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select xmp noembed noframes".split())
# those that run to the end of the page without an end tag, and those that may be closed by a slash
_TO_END = frozenset("script style textarea title".split())
_SLASHED = frozenset("svg math".split())
_VALUE = re.compile(r"=\s*[^\s\"'=]+\Z")
# Fixed lists of HTML: elements that begin a line of their own, and which open elements a start tag ends.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# Elements that hold no main text, elements that seldom do, and class, id and role tokens that say so.
BOILERPLATE = frozenset("nav footer aside button dialog menu head label input search".split())
_SELDOM = frozenset("form fieldset".split())
_FIRM = (
    "ad ads advert adverts advertisement advertisements breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer gdpr masthead modal nav navbar "
    "navigation newsletter newsletters notice notices pager pagination popup promo promoted sidebar sidebars skip sponsored sponsors toolbar widget widgets"
)
# words that also name the sections of a text
_PLAIN = "advertising banner discussion login menu promotion related search share sharing signup social sponsor subscribe"
_THREAD = "comment comments disqus replies reply respond"
_FILL = "area bar block bottom box button buttons column container content form hero icons inner item items left link links list main panel post posts right section site text title top wrap wrapper"
# a token is a name if it is made of these words only: sidebar-left, commentlist; not no-sidebar, commentary, related-work
_ANY = "|".join(sorted({*_FIRM.split(), *_PLAIN.split(), *_THREAD.split(), *_FILL.split()}, key=lambda w: (-len(w), w)))
_TOKEN_NAME = re.compile(rf"(?:(?:{_ANY})[-_\d]*)+")
_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an id there is an anchor, a class there describes the page
_UNNAMED = _HEADS | {"html", "body", "main"}
_INNER = frozenset("ul ol dl table tbody thead tfoot tr".split())
_LISTED = frozenset("li dt dd tbody thead tfoot tr td th".split())
PLAIN, FIRM, THREAD = 1, 2, 3
_KINDS = [(THREAD, re.compile("|".join(sorted(_THREAD.split(), key=len, reverse=True)))), (FIRM, re.compile("|".join(sorted(_FIRM.split(), key=len, reverse=True)))), (PLAIN, re.compile("|".join(_PLAIN.split())))]
ARTICLE = frozenset(("article", "main"))


@functools.lru_cache(1 << 14)
def _kind(token: str) -> int:
    """What a class, id or role token says: PLAIN, FIRM or THREAD; 0 if it is no boilerplate name."""
    if not _TOKEN_NAME.fullmatch(token):
        return 0
    return next((kind for kind, words in _KINDS if words.search(token)), 0)


class Path:
    """A tag path with the sums over its text; ``group`` is the path of the block it stands in."""

    __slots__ = ("all", "chars", "children", "content", "group", "label", "linked", "long", "lowered", "named", "nodes", "parent", "poor", "punctuation", "rich", "runs", "score", "sums", "tag")

    def __init__(self, parent, label: str, tag: str, poor: bool, rich: bool, named: int):
        self.parent, self.label, self.tag, self.poor, self.rich, self.named = parent, label, tag, poor, rich, named
        self.group = self if parent is None or tag in BLOCK or named or poor != parent.poor or rich != parent.rich else parent.group
        self.children: dict = {}
        self.nodes = self.chars = self.punctuation = self.linked = self.long = self.runs = 0
        self.score, self.content, self.lowered = 0.0, False, False
        self.sums = self.all = (0, 0, 0, 0)

    def child(self, tag: str, names: str) -> Path:
        label = f"{tag}.{names}" if names else tag
        got = self.children.get(label)
        if got is None:
            tokens = names.split()
            rich = self.rich or tag in ARTICLE or "main" in tokens and "role" in tokens
            whole = tag in ("html", "body")
            poor = self.poor or not whole and (tag in BOILERPLATE or "hidden" in tokens or tag == "header" and not self.rich)
            opens = rich and not self.rich and tag not in ARTICLE
            named = 0 if tag in _UNNAMED or opens else max(map(_kind, tokens), default=0) or (FIRM if tag in _SELDOM else 0)
            got = self.children[label] = Path(self, label, tag, poor, rich, named)
        return got

    def spelled(self) -> str:
        parts, at = [], self
        while at.parent is not None:
            parts.append(at.label)
            at = at.parent
        return "/".join(reversed(parts))


def _names(attributes: str) -> str:
    """Words of class and id, the role, and whether the element is hidden."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return ""
    out, rest = [], attributes
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            out.append(value)
        elif key == "role":
            out.append(f"role {value}")
        elif key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            out.append("hidden")
        rest = rest.replace(m[0], "")
    if "hidden" in rest.lower().split():
        out.append("hidden")
    return " ".join(sorted(set(" ".join(out).split())))


def _closed(tag: str, attributes: str) -> bool:
    """Whether a start tag of svg or math is the whole element; the slash of an unquoted value is not."""
    return tag in _SLASHED and attributes.endswith("/") and not _VALUE.search(attributes)


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where the elements of a tag end, by the end of their start tags; those without an end tag are left out."""
    out, opened = {}, []
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", page, re.I):
        if not m[1]:
            if not _closed(tag, m[2]):
                opened.append(m.end())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def parse(page: str) -> tuple[list[Path], list[tuple[Path, int, str]]]:
    """Paths of a page, and its text in order as (path, block number, decoded text)."""
    root = Path(None, "", "", False, False, 0)
    stack: list[tuple[str, Path]] = [("", root)]
    paths, texts, block, links, at, n = [root], [], 0, 0, 0, len(page)
    ends: dict[str, dict[int, int]] = {}

    def text(a: int, z: int) -> None:
        raw = page[a:z]
        if not raw or raw.isspace():
            # white space still parts words
            if raw:
                texts.append((stack[-1][1], block, " "))
            return
        got = html.unescape(raw) if "&" in raw else raw
        path = stack[-1][1]
        size = len(got.strip())
        path.nodes += 1
        path.chars += size
        path.punctuation += len(_PUNCTUATION.findall(got))
        path.linked += size if links else 0
        texts.append((path, block, got))

    def pop(to: int) -> None:
        nonlocal links
        for tag, _ in stack[to:]:
            links -= tag == "a"
        del stack[to:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if where:
                pop(where)
            block += tag in BLOCK
            continue
        block += tag in BLOCK
        if tag in RAW:
            if tag in _TO_END:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            elif not _closed(tag, m[3]):
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                # without an end tag only the start tag is skipped
                at = ends[tag].get(at, at)
            continue
        if tag in VOID:
            continue
        if tag in _ENDS_P:
            where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in ("td", "th", "button", "table")), 0)
            if where and stack[where][0] == "p":
                pop(where)
        if tag in _ENDS:
            where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in _ENDS[tag] or stack[i][0] in _STOPS[tag]), 0)
            if where and stack[where][0] in _ENDS[tag]:
                pop(where)
        if m[3].endswith("/") and tag not in BLOCK and tag != "a":
            continue
        parent = stack[-1][1]
        size = len(parent.children)
        path = parent.child(tag, _names(m[3]))
        if len(parent.children) > size:
            paths.append(path)
        stack.append((tag, path))
        links += tag == "a"
    sizes: dict[int, int] = {}
    for _, number, got in texts:
        sizes[number] = sizes.get(number, 0) + len(got.strip())
    seen = set()
    for path, number, got in texts:
        if not got.isspace():
            if sizes[number] >= LONG:
                path.long += len(got.strip())
            if (id(path.group), number) not in seen:
                seen.add((id(path.group), number))
                path.group.runs += 1
    return paths, texts


def _lower(paths: list[Path]) -> None:
    """Which paths a boilerplate name lowers; names of the page's article and of what holds it do not count."""
    best, exempt = 0.0, None
    for p in paths:
        above = p.parent
        p.lowered = bool(above and above.lowered)
        if p.named and not p.lowered:
            chars, punctuation, linked, long = p.all
            prose = 2 * long >= chars > 0 and 100 * punctuation >= chars and 5 * linked <= chars
            p.lowered = not (prose and (p.named == PLAIN or p.named == FIRM and p.rich and p.tag not in _SELDOM))
        if p.rich and not p.poor and above and not above.rich:
            weight = p.all[0] * (1 if p.tag == "article" else 10) * (0.2 if p.lowered else 1)
            if weight > best:
                best, exempt = weight, p
    at, again = exempt, False
    while at is not None:
        if at.named == THREAD:
            return
        again |= at.lowered and at.named > 0
        at.named, at = 0, at.parent
    if again:
        _lower(paths)


def judge(paths: list[Path], share: float = SHARE) -> None:
    """Smooth, fuse and threshold the ratios of the paths, which are listed parents first."""
    own_sums: dict[int, list[int]] = {}
    for p in paths:
        held = own_sums.setdefault(id(p.group), [0, 0, 0, 0])
        for i, x in enumerate((p.chars, p.punctuation, p.linked, p.long)):
            held[i] += x
        p.all = (p.chars, p.punctuation, p.linked, p.long)
    for p in reversed(paths):
        if p.parent is not None and (not p.poor or p.parent.poor):
            p.parent.all = tuple(x + y for x, y in zip(p.parent.all, p.all, strict=True))
    _lower(paths)
    groups = [p for p in paths if p.group is p]

    def kept(p: Path) -> float:
        """The share of a block's text that is not in links, for list items and cells of their whole list."""
        if p.rich and p.tag in _HEADS:
            return 1.0
        while p.tag in _LISTED and p.parent is not None and not p.parent.poor:
            p = p.parent
        return 1 - p.all[2] / p.all[0] if p.all[0] else 1.0

    for p in groups:
        p.sums = tuple(own_sums[id(p)])
        chars, punctuation, linked, _ = p.sums
        p.score = chars / p.runs * (1 + punctuation / p.runs) * (1 - linked / chars) if chars else 0.0
    # a path takes a part of what its children have, and then of its parent's, so a short heading beside long paragraphs keeps up
    for p in reversed(groups):
        up = p.parent.group if p.parent is not None else None
        if up is not None and not p.poor and p.lowered == up.lowered:
            up.score = max(up.score, p.score * (1 if up.tag in _INNER else SMOOTH_RICH if up.rich else SMOOTH))
    for p in groups:
        up = p.parent.group if p.parent is not None else None
        # whole parts of a page do not stand for each other
        if up is not None and not (up.tag in ("", "html", "body") and p.tag in ("div", "section")):
            p.score = max(p.score, up.score * kept(p) * (1 if p.tag in _INNER or p.tag in _LISTED else SMOOTH_RICH if up.rich else SMOOTH))
    inside = sum(p.sums[0] for p in groups if p.rich and not p.poor and not p.lowered)
    beside = sum(p.sums[0] for p in groups if not p.rich and not p.poor and not p.lowered)
    outside = (beside / (inside + beside)) ** 2 if inside else 1.0
    for p in groups:
        p.score *= (0.0 if p.poor else 1.0) * (NAMED if p.lowered else 1.0) * (1.0 if p.rich else outside)
    least = share * max((p.score for p in groups if p.sums[0]), default=0.0)
    for p in paths:
        p.score = p.group.score
        p.content = p.score >= least and p.score > 0


def main_text(page: str | None, share: float = SHARE) -> tuple[str, list[Path]]:
    """Main text of a page, blocks joined by line feeds, and the paths with their verdicts."""
    if not page:
        return "", []
    paths, texts = parse(page)
    judge(paths, share)
    lines, held, number = [], [], None
    for path, block, text in texts:
        if not path.content:
            continue
        if block != number:
            lines.append("".join(held))
            held, number = [], block
        held.append(text)
    lines.append("".join(held))
    clean = (" ".join(line.split()) for line in lines)
    return "\n".join(line for line in clean if line), paths


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``pages`` without html, with text and paths.

    ``paths`` has (path, nodes, chars, punctuation, linked, score, content) of each
    tag path that holds text.  Needs ``html``; columns named text or paths are
    replaced, others stay.  Null and empty pages have empty text and no paths; text
    without any tag is content.  Rows are independent of each other.
    """
    kind = pa.struct([("path", pa.string()), ("nodes", pa.int64()), ("chars", pa.int64()), ("punctuation", pa.int64()), ("linked", pa.int64()), ("score", pa.float64()), ("content", pa.bool_())])
    rows = pages.drop("text", "paths")
    others = [c for c in rows.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, all_paths = [], []
            for page in batch.column("html"):
                text, paths = main_text(page.as_py(), share)
                texts.append(text)
                all_paths.append([{"path": p.spelled(), "nodes": p.nodes, "chars": p.chars, "punctuation": p.punctuation, "linked": p.linked, "score": p.score, "content": p.content} for p in paths if p.chars])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string()), pa.array(all_paths, pa.list_(kind))], [*others, "text", "paths"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "html")
    return rows.mapInArrow(run, f"{fields}text string, paths array<struct<path:string,nodes:bigint,chars:bigint,punctuation:bigint,linked:bigint,score:double,content:boolean>>")


def page_texts(pages: DataFrame) -> DataFrame:
    """Contract columns of :func:`extract`."""
    got = extract(pages.select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
