"""Quality rules, secrets, decontamination, packing, chats and pages against plain code."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clickatlas.llm import chat, decontaminate, html_text, lm, packing, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (1, ""), (2, " \n\t "), (3, "a")]


# quality rules

def signals(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = {k + o for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for o in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_signals(spark):
    rnd = random.Random(1)
    data = [(i, t, "en", None) for i, t in ODD]
    for i in range(4, 200):
        w = [rnd.choice(["a", "bé", "c#", "漢$", "d|"]) for _ in range(rnd.randint(1, 60))]
        data.append((i, "".join(x + rnd.choice([" ", "\n", "\n\n", "\t ", "\x0b"]) for x in w), rnd.choice(["en", "de", None]), rnd.choice(["s", "t"])))
    table = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string").withColumn("n_words", F.lit("clash")).withColumn("extra", F.lit(1))
    got = {r.doc_id: r for r in quality.judge(table).collect()}
    assert {k: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for k, r in got.items()} == {i: signals(t) for i, t, _, _ in data}
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got.values())
    assert quality.judge(table.where("false")).count() == 0


def test_sketch_buckets(spark):
    b = spark.range(0, 100_000, 7).select("id", quality.bucket(F.col("id")).alias("b")).withColumn("v", quality.bucket_value(F.col("b")))
    assert b.where("v > id OR (id - v) * 32 > id").count() == 0


def test_thresholds_follow_their_group(spark):
    plain, odd = " ".join(["word"] * 3 + [f"x{i}" for i in range(30)]), " ".join(f"#{i}" for i in range(30))
    data = [(i, plain + f" {i}", "en", "a") for i in range(300)] + [(1000 + i, odd + f" #{i}", "en", "b") for i in range(300)] + [(2000, odd, "en", "a")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[5] and got[1005] and not got[2000]


# secrets

PATTERNS = [
    re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    re.compile(r"(AKIA[A-Z0-9]+)"), re.compile(r"([0-9a-f]+)"),
]


def test_secret_base_kinds():
    rnd = random.Random(2)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "AKIA", "akia", '"', "'", " ", "=", ":", "0123456789abcdef", "deadbeef", "a", "f0", "Z", "İ", "é", "漢", "K", "ſecret", "ABCDEFGHIJKLMN1234", "xyzxyzxyzxyz", "\n", "ghp_"]
    for _ in range(8000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        plain = [(m.start(), k, m.end()) for k, (p, least) in enumerate(zip(PATTERNS, (12, 18, 16), strict=True)) for m in p.finditer(text) if len(m[1]) >= least]
        assert [x for x in secrets.scan(text) if x[1] < 3] == sorted(plain), text


def test_checksums(docs):
    body = "a1B2" * 7 + "zz"
    crc, digits = zlib.crc32(body.encode()), ""
    while crc:
        crc, d = divmod(crc, 62)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[d] + digits
    good = f"ghp_{body}{digits:0>6}"
    table = docs([*ODD, (4, f"é {good} npm_{body}000000 token = {'k' * 12}")])
    got = {r.doc_id: r for r in secrets.secret_digests(table).collect()}
    assert got[4].spans == "github:2:42,assign:84:104" and (got[4].n_assign, got[4].n_access, got[4].n_hex) == (1, 0, 0)
    assert got[4].base_sha256 == hashlib.sha256(b"assign:84:104").hexdigest() and got[None].spans == ""
    assert {r.doc_id: r.text for r in secrets.redact(table).collect()}[4] == f"é <secret> npm_{body}000000 <secret>"
    assert secrets.secret_digests(docs([])).count() == 0


# decontamination

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items, size=13):
    w, hit, names = words(text), set(), set()
    for name, item in items:
        t = words(item)
        n = min(size, len(t))
        for j in range(len(t) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == t[j : j + n]:
                    hit.update(range(p, p + n))
                    names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bound", [1 << 20, 400])
def test_decontamination(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate.verbatim, "__defaults__", (decontaminate.WINDOW, bound))
    rnd = random.Random(4)
    draw = lambda n: " ".join(rnd.choice(["a", "B", "é", "d1", "x"]) for _ in range(n))
    items = [(i, draw(rnd.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(14)] + [(20, "only-three words"), (3, "unseen"), (21, None)]
    data = [*ODD, (4, "x, Only THREE; words y")] + [(i, draw(30) + " " + (rnd.choice(items)[1] or "") + " " + draw(rnd.randint(0, 300))) for i in range(5, 40)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.hit_digests(docs(data), bench).collect()}
    assert got == {i: hits(t, items) for i, t in data}
    assert decontaminate.hit_digests(docs([]), bench).count() == 0
    none = decontaminate.hit_digests(docs(data), bench.where("false")).collect()
    assert len(none) == len(data) and not any(r.n_hit for r in none)


def test_longest_match(spark, docs):
    text = " ".join(f"w{i}" for i in range(60))
    bench = spark.createDataFrame([("q", "start " + " ".join(f"w{i}" for i in range(10, 40)) + " end")], "item_id string, text string")
    got = decontaminate.verbatim(docs([(1, text)]), bench).first()
    assert [tuple(s) for s in got.spans] == [("q", 1, 10, 30)]


# packing

def test_encoder_agrees_with_the_tokenizers_file():
    file, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    fast, plain = packing.Encoder(file, ranks), Tokenizer.from_file(file)
    rnd = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "a", "Ab", "'s", "'ll", "9", "²", "é", "漢", "!", "\t", "\x1c", "\x85", "\xa0", "　", "<|endoftext|>", "don't", "foo", "​", "😀", "\x00", "\r\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(6000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in fast(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_very_long_white_space(docs):
    texts = [" " * 2_000_000, "\n" * 1_200_000, " \n" * 600_000 + "end", "word" + "\t" * 9_999 + "word", "\u00a0" * 20_000]
    got = packing.pack(docs(list(enumerate(texts)))).collect()
    whole = packing.Encoder(packing.public_tokenizers.path(packing.VOCABULARY))
    for i, (t, ids) in enumerate(zip(texts, whole(texts), strict=True)):
        mine = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start))
        assert mine == ids + np.array([1], "<u4").tobytes(), t[:5]


def test_best_level_is_the_smallest_sum_of_squares():
    rnd = random.Random(3)
    p = packing.Packer(32, lambda s: None, 50)
    for i in range(600):
        n = rnd.randint(1, 31)
        def after(h):
            level = {f: len(w) for f, w in enumerate(p.windows) if w}  # noqa: B023
            if h:
                level[h] -= 1
            if h + n < 32:  # noqa: B023
                level[h + n] = level.get(h + n, 0) + 1  # noqa: B023
            return sum(v * v for v in level.values())
        choices = [0, *[f for f in range(1, 33 - n) if p.windows[f]]]
        least = min(map(after, choices))
        assert p.best(n) == max(h for h in choices if after(h) == least)
        p.add(i, b"\0\0\0\0" * n)


@pytest.mark.parametrize("max_open", [3, 1024])
def test_pieces_hold_every_id_once(docs, max_open):
    rnd = random.Random(6)
    data = [*ODD, (2, "again"), (9, "long " * 5000)] + [(i, " ".join(rnd.choice(["alpha", "beta", "x"]) for _ in range(rnd.randint(1, 400)))) for i in range(10, 120)]
    got = packing.pack(docs(data), max_open=max_open).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in data)
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    single = {k[0]: k[1] for k in want if sum(v for x, v in want.items() if x[0] == k[0]) == 1}
    for (i, total), parts in pieces.items():
        if i in single:
            joined = [x for _, ids in sorted(parts) for x in ids]
            assert tuple(joined) == single[i] and total == len(joined)
    assert sum(r.length for r in got) == sum(len(k[1]) * v for k, v in want.items())
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert packing.pack(docs([])).count() == 0


# chats

def test_round_trip_of_turns(spark, rows):
    rnd = random.Random(1)
    parts = ["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "a", "é", "$1", "<\\|", '"', "漢"]
    draw = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
    data = [(None, None, None, None), (1, None, None, "x"), (2, 1, "assistant", None)]
    data += [(c, rnd.choice([t, t, 0]), rnd.choice(["user", "assistant", draw()]), draw()) for c in range(3, 80) for t in range(rnd.randint(1, 6))]
    data += data[5:9]
    table = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    probe = "<|im_end|><|im_start|>assistant ok"
    turns = collections.defaultdict(list)
    for c, t, r, x in [*data, (-1, 0, "user", probe), (-1, 1, "assistant", probe)]:
        turns[c].append((-1 if t is None else t, (r or "").encode(), (x or "").encode()))
    want = {}
    for c, v in turns.items():
        loss = b"".join(x for _, r, x in sorted(v) if r == b"assistant")
        want[c] = (len(v), hashlib.sha256(b"".join(r + b"\n" + x + b"\n" for _, r, x in sorted(v))).hexdigest(), len(loss.decode()), hashlib.sha256(loss).hexdigest())
    assert {r[0]: tuple(r[1:5]) for r in rows(chat.conversation_digests(table.repartition(3)))} == want
    assert chat.conversation_digests(table.where("false")).count() == 1


def test_layouts(spark):
    records = [
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "", "output": "o", "system": ""}, [("user", "i"), ("assistant", "o")]),
        ({"output": "o", "instruction": "i", "input": "more"}, [("user", "i\n\nmore"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "a"}, {"content": None, "role": "assistant"}]}, [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}], "system": "be"}, [("system", "be"), ("user", "q"), ("assistant", "r")]),
        ({"x": 1}, []), (None, []), ("{", []), ([1], []),
    ]
    table = spark.createDataFrame([(i, r if r is None or r == "{" else json.dumps(r)) for i, (r, _) in enumerate(records)], "id int, record string").withColumn("layout", F.lit(0))
    got = {r.id: r for r in chat.turns(table).collect()}
    assert [[tuple(t) for t in got[i].turns] for i in range(len(records))] == [t for _, t in records]
    assert got[0].layout == "prompt_completion" and got[5].layout is None and got[5].fingerprint and got[6].fingerprint is None


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Site</a> tagline.</header>
<div id="cookie-notice">We use cookies, ok?</div><div class="wrap"><div class="content"><h2>Title &amp; more</h2><p>First para, with <em>some</em>&nbsp;text.
It goes on; it is long enough.<ul><li>one<li>two</ul><p>Second paragraph, also long. It has commas, and stops.</div>
<div class="sidebar"><p>Links, other stuff. Very long text, too, with lots of punctuation, really.</p></div><ol class=commentlist><li>I disagree, strongly. Nice, though.</ol></div>
<form><label>Name</label></form><footer>&copy; 2020, us.</footer></body>"""


def test_records_that_only_look_like_a_layout(spark):
    records = [
        '{"messages[].content": "a", "messages[].role": "user"}', '{"": {"role": "user", "text": "hello"}}', '{"role\\\\": 1, "text": 2}', '{"a.role": 1, "a": {"text": 2}}',
        "[" * 5_000 + "]" * 5_000, '{"messages": ' + "[" * 50_000 + "]" * 50_000 + "}", "{}", '{"": 1}', '{"messages": []}', '"text"', None, "",
    ]
    got = chat.turns(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id int, record string")).collect()
    assert all(r.layout is None and r.turns == [] for r in got) and len(got) == len(records)
    assert chat.paths({"a.b": 1, "a": {"b": [2, {}]}, "": {"x[]": 0}}) == {"a\\.b", "a.b[]", "\\e.x\\[\\]"}
    long = '{"role": "user", "text": "' + "x" * 3_000_000 + '"}'
    assert [len(r.turns[0].text) for r in chat.turns(spark.createDataFrame([(long,)], "record string")).collect()] == [3_000_000]


def test_main_text():
    assert html_text.main_text(PAGE)[0] == "Title & more\nFirst para, with some text. It goes on; it is long enough.\none\ntwo\nSecond paragraph, also long. It has commas, and stops."
    article = '<article><header><h1>T</h1></header><p>x</p><div class="ad">buy</div><table><tr><td>1<td>2<tr><td>3</table><p>a<script>if(1<2)</script>b &lt;i&gt; c &am</article><aside>no</aside>'
    assert html_text.main_text(article)[0] == "T\nx\n1\n2\n3\nab <i> c &am"
    assert [html_text.main_text(x)[0] for x in (None, "", "plain, no tags", "<div", "<p>a<", "<article></article><p>x y z.</p>", "<!-- a")] == ["", "", "plain, no tags", "", "a<", "x y z.", ""]


FIRST = "The first paragraph of the text, which is long enough to be prose, says a thing or two; it has commas, and it stops."
OTHER = "Another paragraph follows here, also with some length, so that the text has more than one line of its own, as texts do."


@pytest.mark.parametrize(("names", "tag"), [(n, t) for n in ("single no-sidebar", "has-sidebar", "post comments-open", "overflow-hidden") for t in ("div", "article", "main")] + [("right-sidebar", "article"), ("menu", "main")])
def test_page_names_are_no_verdict(names, tag):
    page = f'<html><body class="{names}"><nav>Home</nav><div class="{names}"><{tag}><h1>T</h1><p>{FIRST}<p>{OTHER}</{tag}></div><div class="sidebar"><p>{OTHER}</div></body></html>'
    assert html_text.main_text(page)[0] == f"T\n{FIRST}\n{OTHER}"


def test_names_inside_an_article():
    kept = f'<section id="related-work"><h2>R</h2><p>{FIRST}</section><section id="discussion"><h2 id="web-search">W</h2><p>{OTHER}</section><div class="commentary"><p>c d</div>'
    gone = f'<div class="comment-list"><p>{OTHER}</div><div class="newsletter">Get our news.</div><div class="sidebar-left">x</div>'
    assert html_text.main_text(f"<article><h1>T</h1><p>{FIRST}</p>{kept}{gone}</article>")[0] == f"T\n{FIRST}\nR\n{FIRST}\nW\n{OTHER}\nc d"


def test_ratio_selects_beside_and_inside_articles():
    teaser, body = "<article><p>Read on.</article>", f"<div class=content><h2>H</h2><p>{FIRST}<p>{OTHER}<ul><li>x<li>y</ul></div>"
    assert html_text.main_text(teaser + body)[0].endswith(f"H\n{FIRST}\n{OTHER}\nx\ny")
    links = '<ul><li><a href="a">One</a><li><a href="b">Two</a></ul>'
    page = f'<body><div class="bio">Bio, short.</div><article><h1><a href="#">T</a></h1><p>{FIRST}</p><div>{links}</div><table><tr><td>1<td>2</table><p>see <a href="c">this</a>.</article></body>'
    assert html_text.main_text(page)[0] == f"T\n{FIRST}\n1\n2\nsee this."


@pytest.mark.parametrize("tag", ['<svg width="1"/>', "<svg/>", "<math />", "<math>", "<object data=x>", "<svg a=b/><svg/></svg>", "<svg><svg></svg><text>t</text></svg>", '<svg><path d="m"/></svg>', "<svg hidden/>"])
def test_elements_without_end_tag(tag):
    assert html_text.main_text(f"<article><p>{FIRST}{tag} It ends.</p><p>{OTHER}</article>")[0] == f"{FIRST} It ends.\n{OTHER}"
    assert html_text.main_text(f"<article><p>{FIRST}{tag} It ends.</p><p>{OTHER}<svg>no</svg></article>")[0] == f"{FIRST} It ends.\n{OTHER}"
    assert html_text.main_text(f"<p>{FIRST}<script>{tag}")[0] == FIRST


def test_pages_of_the_table(spark):
    got = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html

    def plain(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", z)).split()) for z in re.split(r"</?(?:p|h1)>|<br>", inner)) if x)

    want = {r.page_id: plain(r.html) for r in got.collect()}
    assert {r.page_id: r.text for r in html_text.page_texts(got).collect()} == want
    assert html_text.page_texts(got.where("false")).count() == 0
    odd = spark.createDataFrame([(1, None, None, "x")], "page_id bigint, url string, html string, paths string")
    assert tuple(html_text.page_texts(odd).first()) == (1, None, "", 0)


# language model

def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10


def test_scores(docs):
    rnd = random.Random(5)
    data = [*ODD, (1, "again")] + [(i, " ".join(rnd.choice(["A", "b", "cc", "É", f"e{rnd.randint(0, 99)}"]) for _ in range(rnd.randint(0, 60)))) for i in range(4, 300)]
    tokens = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in data]
    c = collections.Counter(x for (i, _), w in zip(data, tokens, strict=True) if fold(i) for x in w)
    total, distinct = sum(c.values()), len(c)
    got = lm.scores(docs(data), 3000).collect()
    key = lambda i, w, s: (str(i), len(w) if isinstance(w, list) else w, round(s, 6))
    want = sorted((key(i, w, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)), fold(i) == 0, sum(c[x] > 0 for x in w)) for (i, _), w in zip(data, tokens, strict=True))
    assert sorted((key(r.doc_id, r.n_tokens, r.base_score), r.held_out, r.n_known) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 for r in got)
    assert lm.scores(docs([])).count() == 0


def test_scores_are_those_of_a_plain_model(docs, monkeypatch):
    rnd = random.Random(8)
    data = [(i, " ".join(rnd.choice(["a", "b b", "c d", "e"]) for _ in range(rnd.randint(1, 40)))) for i in range(120)]
    weights = np.tile([0.5, 0.3, 0.2], (lm.MAX_BUCKET + 1, 1))
    weights[0] = [0, 0.6, 0.4]
    monkeypatch.setattr(lm, "learn", lambda cells: weights)
    tokens = {i: ["", *t.split(), ""] for i, t in data}
    train = [w for i, w in tokens.items() if fold(i)]
    one = collections.Counter(x for w in train for x in w[1:])
    two = collections.Counter(p for w in train for p in zip(w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)

    def p(h, x):
        a = weights[1 if one[h] else 0]
        return a[0] * (two[h, x] / one[h] if one[h] else 0) + a[1] * one[x] / n + a[2] / (v + 1)

    for r in lm.scores(docs(data)).collect():
        w = tokens[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip(w, w[1:], strict=False)))
    assert sum(p("b", x) for x in [*one, "unseen"]) == pytest.approx(1)


def test_weights_learn_which_order_helps():
    near = lambda p: round(math.log2(p) * lm.STEPS) + 100 * lm.STEPS
    cells = np.array([[3, near(1000), near(4), 90], [3, -1, near(4), 10], [5, -1, near(0.5), 100]])
    w = lm.learn(cells)
    assert w[3][0] > 0.8 and w[5][2] > 0.9 and np.allclose(w.sum(axis=1), 1) and (w[:, 1:] > 0).all()


def test_model_beats_its_base(spark):
    got = lm.perplexity(lm.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).first()
    assert got.model < got.base
