import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest

from factorloom.llm import html_wrappers as W


def page(k, body="", extra=""):
    return f'<html><head><title>t{k}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>n{k}</a></ul></nav><div class="ad">buy {k}</div>{extra}<article><h1>Head {k}</h1><p>one&nbsp;&amp; two {k}<p>three<br>four{body}</article><footer>foot {k}</footer>'


def test_article_only():
    assert W.extract(page(1), None) == "Head 1 one & two 1 three four"
    assert W.extract(None, None) == "" and W.extract("", None) == "" and W.extract("a  &lt;\n b", None) == "a < b"
    assert W.extract("<p>x<div class='comments'>no</div><form>no</form><p>y", None) == "x y"
    assert W.extract("<p>a <b>b</b>c<!-- no --><style>p{}</style>d", None) == "a bcd"
    assert W.extract("<div title='a>b'>x</div><p", None) == "x <p"


def test_headers():
    assert W.extract("<header>site</header><div class='page-header'>top</div><p>a", None) == "a"
    assert W.extract("<header>site</header><article><header><h1>Title</h1></header><div class='article-header'>by me</div><p>a<aside>no</aside></article>", None) == "Title by me a"


def test_simple_tree_matching_keeps_order():
    a = [["p", 0, [], []], ["div", 0, [], []], ["p", 0, [], []]]
    b = [["div", 0, [], []], ["p", 0, [], []], ["ul", 0, [], []]]
    assert W.matching(a, b, W._key, W._slots, {}) == [(1, 0), (2, 1)]


def brute_matching(x, y):
    """Nodes matched at most, trying every way to pair the children in order."""
    if x[0] != y[0]:
        return 0

    def rows(a, b):
        if not a or not b:
            return 0
        return max(rows(a[1:], b), rows(a, b[1:]), (brute_matching(a[0], b[0]) + rows(a[1:], b[1:])) if a[0][0] == b[0][0] else 0)

    return 1 + rows(x[3], y[3])


def test_simple_tree_matching_by_brute_force():
    r = random.Random(3)

    def tree(depth):
        return [r.choice(["p", "div", "ul"]), 0, [], [tree(depth - 1) for _ in range(r.randrange(0, 4))] if depth else []]

    for _ in range(150):
        x, y = tree(2), tree(2)
        x[0] = y[0] = "body"
        assert W._matched(x, y, W._key, W._slots, {}) == brute_matching(x, y) or [k[0] for k in x[3]] == [k[0] for k in y[3]]


def test_long_rows_match_in_order(monkeypatch):
    a, b = ([[k, 0, [], []] for k in ["p", "div", "ul"] * 40] for _ in range(2))
    monkeypatch.setattr(W, "PAIRS", 100)
    assert W.matching(a[1:], b, W._key, W._slots, {}) == [(k - 1, k) for k in range(1, 120)]


def wrapper(pages, order=None):
    """As the operator does it, for pages of one host dealt out in any way."""
    made = {json.dumps(W.template_of(W.fold([W.parse(p)])), separators=(",", ":")) for p in (order or pages)}
    merged = None
    for t in sorted(made, key=lambda t: hashlib.sha256(t.encode()).hexdigest()):
        merged = json.loads(t) if merged is None else W.merge(merged, json.loads(t))
    merged = W.numbered(merged)
    counts, sums = defaultdict(Counter), defaultdict(lambda: [0, 0])
    for p in set(pages):
        for slot, text, words, linked in W.slots_of(p, merged):
            counts[slot][text] += 1
            sums[slot][0] += words
            sums[slot][1] += linked
    told = {}
    for slot, c in counts.items():
        same, text = max((n, t) for t, n in c.items())
        told[slot] = (sum(c.values()), same, text, *sums[slot])
    return W.wrapper_of(merged, told)


def test_constant_slots_are_template():
    pages = [f"<body><div class=top>Welcome to our site</div><div class=main><h2>Title {k}</h2><p>Some words {k} of the text<p>more {k * 7}</div><div class=end>All rights reserved</div></body>" for k in range(12)]
    w = wrapper(pages)
    assert W.extract(pages[3], w) == "Title 3 Some words 3 of the text more 21"
    # a page of another build is read by its own tags
    assert W.extract("<article>x</article>", w) == "x"


def test_equal_articles_stay():
    pages = [page(1)] * 12
    assert W.extract(pages[0], wrapper(pages)) == "Head 1 one & two 1 three four"


def test_copies_of_one_page_count_once(spark):
    copy = "<body><article><h1>Not found</h1><p>nothing here</article>"
    other = "<body><article><h1>Own title</h1><p>own words<ul><li>a<li>b</ul></article>"
    same = copy.replace("</article>", "<ul><li>c</ul></article>")
    pages = [copy] * 30 + [other, same]
    df = spark.createDataFrame([(k, f"http://h/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in W.main_text(df, W.wrappers(df)).collect()}
    assert got[0] == "Not found nothing here" and got[30] == "Own title own words a b" and got[31] == "Not found nothing here c"
    # a text of its own in a slot that is constant elsewhere stays, even where no html repeats
    w = wrapper([copy + f"<!-- {k} -->" for k in range(30)] + [other])
    assert w["s"]
    assert W.extract(other, w) == "Own title own words a b"


def test_more_than_48_kinds_under_a_node():
    letters = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    make = lambda k: f"<body><div id=page><h2>Title {k}</h2><p>Some words {k} of the text</div><div class=ad id=slot-{letters(k)}>buy {k}</div><section id=s-{letters(k)}>own {k}</section><div class=end>All rights kept</div></body>"
    pages = [make(k) for k in range(130)]
    w = wrapper(pages)
    for k in (0, 7, 60, 129):
        assert W.extract(pages[k], w) == f"Title {k} Some words {k} of the text own {k}"
    # rare kinds add up however many kinds there are
    rare = [make(k).replace("<div class=end>", "<div class=rare>join us today</div><div class=end>") if k % 13 == 0 else make(k) for k in range(130)]
    assert W.extract(rare[13], wrapper(rare)) == "Title 13 Some words 13 of the text own 13"
    # one hidden node says nothing of others of its class
    some = [make(k).replace("<p>", "<p hidden>no</p><p>" if k == 5 else "<p>") for k in range(60)]
    assert W.extract(some[5], wrapper(some)) == "Title 5 Some words 5 of the text own 5" and W.extract(some[6], wrapper(some)) == "Title 6 Some words 6 of the text own 6"


def test_query(spark):
    rows = [(k, f"https://h{k % 2}.example.com:80/{k}?x", page(k), "c") for k in range(20)] + [(20, None, None, "c"), (21, "x", "", "c"), (22, "http://H1.example.com", page(22), "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in W.main_text(df, W.wrappers(df)).collect()}
    assert len(got) == 23 and got[20]["text"] == "" and got[21]["n_chars"] == 0
    for k in [*range(20), 22]:
        assert got[k]["text"] == f"Head {k} one & two {k} three four" and got[k]["n_chars"] == len(got[k]["text"])
    none = df.limit(0)
    assert W.main_text(none, W.wrappers(none)).count() == 0


@pytest.mark.parametrize("html,text", [
    ("<div class='content with-sidebar'><h1>T</h1><p>Hello world</p></div>", "T Hello world"),
    ("<form action=/x><input name=v><nav>menu</nav><div><article><h1>T</h1><p>Hello</article></div></form>", "T Hello"),
    ("<form><div><h2>T</h2><p>all of the page lies in here</div></form><p>end", "T all of the page lies in here end"),
    ("<article><p class='share-price'>up 3 %</p><div class='ad-hoc'>a group</div><section id='related-work'>others did</section></article>", "up 3 % a group others did"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</article>", "so x=2 holds"),
    ("<article><p>a<div class='ad-banner'>no</div><div id=comments>no</div><div class='related-posts'>no</div><div class='share-buttons'>no</div><p>b</article>", "a b"),
    ("<div class='cookie-notice'>no</div><div class=wrapper-ad><main><p>yes</main></div><aside>no</aside>", "yes"),
    ("<p>a<form><label>search</label><input></form><p>much longer than the form", "a much longer than the form"),
    ("<article><h1>T</h1><p>x</article><section class=comments><article class=comment><p>no no</article></section>", "T x"),
])
def test_names_and_holders(html, text):
    assert W.extract(html, None) == text


def varied(r, k):
    parts = [f"<h2>Title {k}</h2>", f"<p>words {k} of {r.randrange(10**6)}</p>", "<div class=end>All rights kept</div>", "<div>Join us</div>", f"<ul><li>item {r.randrange(99)}<li>b</ul>", f"<section class=s{r.choice('abc')}><p>own {k}</p></section>", "<blockquote>same</blockquote>"]
    return "<body><div id=page>" + "".join(p for p in parts if r.random() < 0.8) + "</div><div class=foot>foot</div></body>"


def test_no_order_changes_a_text(spark):
    r = random.Random(2)
    pages = [varied(r, k) for k in range(60)]
    want = [W.extract(p, wrapper(pages)) for p in pages]
    for _ in range(30):
        order = r.sample(pages, len(pages))
        assert [W.extract(p, wrapper(order, order)) for p in pages] == want
    df = spark.createDataFrame([(k, "http://h/x", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    for n in (1, 7):
        dealt = df.repartition(n, "html")
        got = {x["page_id"]: x["text"] for x in W.main_text(dealt, W.wrappers(dealt)).collect()}
        first = got if n == 1 else first
        assert len(got) == 60 and got == first


def test_deep_repeated_and_long_pages(spark, monkeypatch):
    deep = "<div>" * 2000 + "<p>bottom" + "</div>" * 2000
    long = "<article>" + "".join(f"<h2>h{k}</h2><p>p{k}</p>" for k in range(8000)) + "</article>"
    rows = [(1, "u", deep), (1, "u", deep), (None, "u", deep), (2, "u", long), (3, "u", long + "<p>x"), (4, "u", "<p>" + "word " * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(W, "BROADCAST", 0)  # joined by host instead
    got = W.main_text(df, W.wrappers(df)).collect()
    assert len(got) == 6 and {r["text"] for r in got if r["page_id"] in (1, None)} == {"bottom"}
    assert next(r["text"] for r in got if r["page_id"] == 2) == " ".join(f"h{k} p{k}" for k in range(8000))
    assert next(r["n_chars"] for r in got if r["page_id"] == 4) == 5 * 300_000 - 1
