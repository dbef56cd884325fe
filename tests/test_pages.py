import pytest
from pyspark.sql import functions as F

from clickatlas.operators import extract as X
from clickatlas.operators.dom import parse_document, parse_pages
from clickatlas.plans.linkgraph import build_link_graph

HTML = """<html><head><title>Shop</title><script>var a="<a href='/no'>no</a>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="b/c.pdf" download>File</a></ul></nav>
<button id="radix-:r1:">Create <b>Thing</b></button><button disabled>No</button><button role=tab aria-controls=x>Tab 1</button>
<table><tr><td>x1</td><td>y1</td><td><button>Row</button></td></tr><tr><td>x2</td><td>y2</td></tr></table>
<form id=f><h2>Sign in</h2><label for=u>User *</label><input id=u name=u><label>Pass <input type=password name=p></label>
<div><div><span>Color</span><select name=c><option>red<option>blue</select></div></div><input type=hidden name=h>
<input type="file" accept=".pdf" hidden><input type=checkbox aria-label="Agree" required><input placeholder="Search..."><button type=submit>Save</button></form>
<div class=cards><div>a</div><div>b</div><div>c</div><div>d</div><div>e</div><p>x</p></div>
<label>Up<input type=file accept=".png" hidden></label><a rel="nofollow next" href="?page=2">Next</a><iframe src="https://x.test/e"></iframe></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://h.test/p/q", HTML)], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def dom(pages):
    return parse_pages(pages)


def test_parser_repairs_markup():
    n = parse_document("<ul><li>a<li>b<p>c<div>d</div></ul><table><tr><td>1<td>2<tr><td>3</table><p hidden>h</p><br>z")
    tags = [(x["tag"], x["parent"], x["text"]) for x in n]
    assert tags == [("ul", -1, "a b c d"), ("li", 0, "a"), ("li", 0, "b c d"), ("p", 2, "c"), ("div", 2, "d"), ("table", -1, "1 2 3"), ("tr", 5, "1 2"),
                    ("td", 6, "1"), ("td", 6, "2"), ("tr", 5, "3"), ("td", 9, "3"), ("p", -1, ""), ("br", -1, "")]
    assert parse_document(None) == [] and parse_document("plain <") == []


def test_links_agree(pages, dom):
    native = [(r["href"], r["text"], r["download"]) for r in X.extract_links(pages).orderBy("link_seq").collect()]
    parsed = [(r["href"], r["text"], r["download"]) for r in X.extract_links_dom(dom).orderBy("link_seq").collect()]
    assert parsed == [("https://h.test/a", "Home", False), ("https://h.test/p/b/c.pdf", "File", True), ("https://h.test/p/q?page=2", "Next", False)]
    # the pattern reads markup only: text inside a script is a known difference
    assert [x for x in native if not x[0].endswith("/no")] == parsed


def test_controls(dom):
    got = [(r["text"], r["selector"], r["nav"]) for r in X.extract_controls(dom).orderBy("ctrl_seq").collect()]
    assert got == [("Home", "nav>ul>li:nth-of-type(1)>a", True), ("File", "nav>ul>li:nth-of-type(2)>a", True), ("Create Thing", "button:nth-of-type(1)", False),
                   ("Tab 1", "button:nth-of-type(3)", True), ("Save", "form>button", False), ("Next", "a", False)]
    assert X.extract_controls(dom, limit=2).count() == 2


def test_actions_and_uploads(dom):
    acts = X.extract_actions(dom)
    got = {r["text"]: (r["bulk"], r["upload"], r["selector"]) for r in acts.collect()}
    assert got["Row"][0] and not got["Save"][0] and got["Create Thing"][2] == "#radix-\\:r1\\:"
    up = {(r["text"], r["accept"]) for r in X.upload_affordances(dom, acts).where("upload").collect()}
    assert up == {("Upload file", ".pdf"), ("Up", ".png")}


def test_forms(dom):
    f = X.extract_forms(dom).first()["form"]
    got = [(x["label"], x["type"], x["required"]) for x in f["fields"]]
    assert got == [("User", "text", True), ("Pass", "password", False), ("User", "select", True), ("Agree", "checkbox", True)]
    assert f["title"] == "Sign in" and f["submitButtons"] == ["Save"] and f["submitSelector"] == "form>button" and f["fieldCount"] == 4
    assert f["fields"][2]["options"] == ["red", "blue"]
    b = X.form_bearing(dom).first()
    assert (b["fields"], b["has_password"], b["submit"], b["is_form_state"]) == (5, True, True, True)


def test_dialog_wins(spark):
    html = "<form><input name=a></form><div role=dialog><label>In <input name=b></label><div role=switch aria-label=On></div><button>OK</button></div>"
    f = X.extract_forms(parse_pages(spark.createDataFrame([(1, "https://h/", html)], "page_id long, url string, html string"))).first()["form"]
    assert f["isDialog"] and [(x["label"], x["type"]) for x in f["fields"]] == [("In", "text"), ("On", "toggle")]


def test_collections(dom):
    got = {}
    for r in X.extract_collections(dom).orderBy("coll_idx", "item_idx").collect():
        got.setdefault((r["coll_idx"], r["kind"], r["count"]), []).append((r["t"], r["cells"]))
    assert got[(1, "aria:list", 2)] == [("Home", []), ("File", [])]
    assert got[(2, "aria:table", 2)][0] == ("x1 y1 Row", ["x1", "y1", "Row"])
    assert [t for t, _ in got[(3, "repeated:div", 5)]] == list("abcde")


def test_paging(spark, dom):
    r = X.next_page_link(dom).first()
    assert (r["found"], r["exhausted"], r["text"]) == (True, False, "Next")
    cases = {
        "<nav><a id=n aria-disabled=true>Next</a></nav>": (True, True), "<a>Next</a><div class=pagination><a>1</a></div>": (False, True),
        "<li class='x disabled'><button aria-label='Siguiente'>s</button></li>": (True, True), "<button>›</button>": (True, False), "<p>Next</p>": (False, True),
    }
    df = spark.createDataFrame([(i, "https://h/", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    got = [(r["found"], r["exhausted"]) for r in X.next_page_link(parse_pages(df)).orderBy("page_id").collect()]
    assert got == list(cases.values())
    assert X.page_signature(dom).first()["sig"] == "https://h.test/p/q|4|Home§File§x1 y1 Row§x2 y2"
    assert [r["src"] for r in X.iframe_sources(dom).collect()] == ["https://x.test/e"]


def test_link_graph_last_write_wins(spark):
    pages = spark.createDataFrame(
        [(1, "https://h.test/a", "A"), (2, "https://h.test/b?utm_source=x", "B"), (3, "https://h.test/a/", "again")], "page_id long, url string, title string")
    html = spark.createDataFrame(
        [(1, "https://h.test/a", "<a href='/b'>to b</a><a href='/b#x'>to b</a><a href='/f.pdf'></a><a href='https://o.test/'>o</a>"),
         (2, "https://h.test/b?utm_source=x", "<a href='/a'>back</a><a href='/c'></a>"), (3, "https://h.test/a/", "<a href='/z'>z</a>")],
        "page_id long, url string, html string")
    nodes, edges = build_link_graph(pages, X.extract_links(html))
    n = {r["id"]: (r["type"], r["title"]) for r in nodes.collect()}
    assert n["https://h.test/a"] == ("page", "back") and n["https://h.test/b"] == ("page", "B") and n["https://h.test/c"] == ("page", "https://h.test/c")
    assert [v for k, v in n.items() if "##download" in k] == [("download", "⬇ Download")] and "https://h.test/z" not in n
    e = sorted((r["src"][-1], r["label"]) for r in edges.collect())
    assert e == [("a", "Download"), ("a", "to b"), ("b", "(link)"), ("b", "back")]
