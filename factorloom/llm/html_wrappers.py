"""Main text of web pages by wrapper induction.

Pages of one host are laid over each other by simple tree matching. A page's tree is first folded: neighbouring siblings
of one kind (tag, class and id words) become one slot. The distinct folded trees of a host are merged into its template in the
order of their digests, by ranges of digests and then by host, so the template depends on the set of trees alone, however
the pages are dealt out, and no task holds a host's pages. Every page is then laid over its host's template, and the pages that
have each text in each slot are counted, as sums over (host, slot, text). Copies of one page (equal html) count once a
host: they say nothing about what its pages share.

A template slot is *constant* if SAME of the pages that have it, and PAGES of them, have one text in it, and *varying*
otherwise. Only that text is left out: another text that a page has in a constant slot is the page's own. The wrapper of
a host is the slot that holds the article (article or main, else the innermost container with nearly all varying words)
and the slots inside it to leave out: constant ones, menus by their share of linked words, and those whose tag, role,
class or id says that they are navigation, notices, adverts, comments and the like. A class or id says so only as a whole:
each of its parts must be such a name or a word of layout ("ad-banner", but not "ad-hoc" or "share-price"), and what holds the
page's main element, or as a form most of its words, is no such thing. The wrapper is then matched to each page.

Defined results: a null or empty html has an empty text; pages without markup are one block of text; pages of hosts too
small for constants still have the tags' and classes' meaning; a page that the wrapper doesn't fit, or would leave empty,
is read by the meaning of its own tags; equal pages get equal texts; null urls share one host; page ids, null or not, are
passed on; no rows give no rows; other columns, whatever their names, are left out. Elements nested over DEEP levels become
siblings, as in browsers; rows of siblings of over PAIRS pairs are matched in order of first fit. Neither loses text.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, slices, trim, written

#: A slot is constant if so many pages have it and this share of them has the same text in it.
PAGES, SAME = 8, 0.9
#: A list or box is a menu if this share of its words is linked.
LINKED = 0.8
DEEP, PAIRS = 512, 4_000_000
#: Templates of up to so many bytes in all are broadcast, by a check of their size; else they are joined by host.
BROADCAST = 16 << 20
#: Slot texts that a task counts before it sends them on.
COUNTED = 200_000
sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * DEEP))

# The names of elements, roles and class words in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes template svg annotation annotation-xml select object".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul td th tr".split())
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
SIBLINGS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINERS = set("html body article main div section td table tbody tr center".split())
ARTICLE = {"article", "main"}
NEVER = set("head nav footer aside form button dialog menu".split()) | RAW
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NAMES = set(
    "nav navbar navigation menu menus submenu sidebar footer breadcrumb breadcrumbs ad ads adv advert adverts advertisement advertising promo promotion sponsor "
    "sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments respond disqus reply replies share sharing "
    "social related recommended widget pager pagination skip copyright".split()
)
#: Words that stand beside those names and leave them their meaning.
LAYOUT = set(
    "site page main global primary secondary top bottom left right upper lower inner outer content box block container wrap wrapper area section list item items group row column col bar link links text title button buttons icon icons panel "
    "holder slot unit zone region module post posts article articles form form-area header footer new small large big mini mobile desktop sticky fixed floating first last more also js".split()
)
#: These mark boilerplate only outside an article: inside one they hold its title.
OUTSIDE = set("header masthead topbar toolbar banner".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|([^>]*+)>)", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPLIT = re.compile(r"[\s_\-]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


def says_boilerplate(value: str, inside: bool) -> bool:
    """Whether a class or an id names boilerplate: one of NAMES in it, and nothing else but such names and words of layout."""
    parts = [p for p in (_DIGITS.sub("", x.lower()) for x in _SPLIT.split(value)) if p]
    bad = [p in NAMES or p in OUTSIDE and not inside for p in parts]
    return any(bad) and all(b or p in LAYOUT or p in OUTSIDE or len(p) == 1 for b, p in zip(bad, parts, strict=True))


class Node:
    __slots__ = ("tag", "names", "out", "items")

    def __init__(self, tag: str, attrs: str = "", inside: bool = False):
        self.tag, self.items = tag, []
        tokens, role, hidden = [], "", False
        if attrs and not attrs.isspace():
            for m in _ATTR.finditer(attrs):
                what, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
                if what == "role":
                    role = value.lower()
                elif what in ("class", "id"):
                    tokens += value.split()
                elif what == "hidden" or value.lower() == "true":
                    hidden = True
        named = tag in OUTSIDE and not inside or any(says_boilerplate(t, inside) for t in tokens)
        self.out = tag in NEVER or hidden or role in ROLES or named and tag not in ("html", "body", "article", "main")
        words = {_DIGITS.sub("", x.lower()) for t in tokens for x in _SPLIT.split(t)} - {""}
        self.names = ".".join([tag, *sorted(words)[:6]]) if words else tag

    @property
    def key(self) -> str:
        # nodes to leave out are a kind of their own, so that they never share a slot with others
        return self.names + ".!" if self.out else self.names


def spare_holders(root: Node) -> None:
    """A node that holds the page's main element, or a heading of the first order in an article, and a form that holds most of
    its words, are not left out."""
    order, stack = [], [(root, [])]
    while stack:
        n, above = stack.pop()
        order.append((n, above))
        if n.tag == "main" and not n.out:
            mains = True
        else:
            mains = n.tag == "h1" and any(x.tag == "article" for x in above)
        if mains:
            for x in above:
                if x.out and x.tag in ("form", "div", "section", "span", "table", "td", "tr", "tbody"):
                    x.out = False
        stack += [(x, [*above, n] if not isinstance(x, str) else above) for x in n.items if not isinstance(x, str)]
    if any(n.tag == "form" and n.out for n, _ in order):
        words: dict[int, int] = {}
        for n, _ in reversed(order):  # from the leaves up
            words[id(n)] = 0 if n.out and n.tag != "form" else sum(len(x.split()) if isinstance(x, str) else words[id(x)] for x in n.items)
        total = words[id(root)]
        for n, _ in order:
            if n.tag == "form" and 2 * words[id(n)] > total:
                n.out = False


def parse(html: str | None) -> Node:
    """The tree of a page, forgiving as browsers are about tags left open. Character references are decoded."""
    root = Node("html")
    stack = [root]
    text, at = html or "", 0
    decode = lambda s: entities.unescape(s) if "&" in s else s
    find = _TOKEN.search
    while m := find(text, at):
        if m.start() > at:
            stack[-1].items.append(decode(text[at : m.start()]))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        tag = name.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in ("html", "body") and len(stack) == 1:
            if tag == "html":
                continue
        elif tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in SCOPE:
            same, end = SIBLINGS.get(tag, {tag}), SCOPE[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same:
                    del stack[k:]
                    break
                if stack[k].tag in end:
                    break
        attrs = m.group(3) or m.group(4) or ""
        node = Node(tag, attrs, any(n.tag in ARTICLE for n in stack))
        stack[-1].items.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(text, at)
            at = close.end() if close else len(text)
        elif tag not in VOID and not (attrs.endswith("/") and tag not in CLOSES_P) and len(stack) < DEEP:
            stack.append(node)
    if at < len(text):
        stack[-1].items.append(decode(text[at:]))
    spare_holders(root)
    return root


# --- folded trees: [key, out, nodes, children], children of one kind in a row folded into one


def fold(nodes: list[Node]) -> list:
    children: list[list] = []
    for n in nodes:
        for x in n.items:
            if not isinstance(x, str) and x.tag not in INLINE and x.tag not in VOID and x.tag not in RAW:
                if children and children[-1][0].key == x.key:
                    children[-1].append(x)
                else:
                    children.append([x])
    return [nodes[0].key, nodes[0].out, nodes, [fold(c) for c in children]]


def own_text(nodes: list[Node]) -> tuple[str, int, int]:
    """Text that lies in these nodes themselves (inline elements included), its words, and how many of them are linked."""
    words, linked = [], 0
    stack = [(x, False) for n in reversed(nodes) for x in reversed(n.items)]
    while stack:
        x, a = stack.pop()
        if isinstance(x, str):
            got = x.split()
            words += got
            linked += len(got) * a
        elif x.tag in INLINE:
            stack += [(y, a or x.tag == "a") for y in reversed(x.items)]
    return " ".join(words), len(words), linked


# --- templates: dicts k (key), o (out), s (slots)


def hashed(text: str) -> int:
    """A signed 64-bit number."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def template_of(folded: list) -> dict:
    return {"k": folded[0], "o": int(folded[1]), "s": [template_of(c) for c in folded[3]]}


def matching(a: list, b: list, key, slots, seen: dict) -> list[tuple[int, int]]:
    """Simple tree matching of two rows of subtrees: the pairs, in order, that match the most nodes."""
    if len(a) == len(b) and all(key(x) == key(y) for x, y in zip(a, b, strict=True)):
        return [(k, k) for k in range(len(a))]
    # only kinds that both have can match: a template's many rare kinds cost a page nothing
    kinds = {key(y) for y in b}
    rows = [i for i, x in enumerate(a) if key(x) in kinds]
    if len(rows) < len(a):
        kinds = {key(a[i]) for i in rows}
        columns = [j for j, y in enumerate(b) if key(y) in kinds]
        return [(rows[i], columns[j]) for i, j in matching([a[i] for i in rows], [b[j] for j in columns], key, slots, seen)] if rows else []
    n, m = len(a), len(b)
    if n * m > PAIRS:
        pairs, j = [], 0
        for i, x in enumerate(a):
            at = next((k for k in range(j, m) if key(b[k]) == key(x)), None) if j < m else None
            if at is not None:
                pairs.append((i, at))
                j = at + 1
        return pairs
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            with_it = best[i - 1][j - 1] + _matched(a[i - 1], b[j - 1], key, slots, seen) if key(a[i - 1]) == key(b[j - 1]) else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], with_it)
    pairs, i, j = [], n, m
    while i and j:
        if key(a[i - 1]) == key(b[j - 1]) and best[i][j] == best[i - 1][j - 1] + _matched(a[i - 1], b[j - 1], key, slots, seen):
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _matched(x, y, key, slots, seen: dict) -> int:
    at = (id(x), id(y))
    if at not in seen:
        a, b = slots(x), slots(y)
        seen[at] = 1 + sum(_matched(a[i], b[j], key, slots, seen) for i, j in matching(a, b, key, slots, seen))
    return seen[at]


def _key(t):
    return t["k"] if isinstance(t, dict) else t[0]


def _slots(t):
    return t["s"] if isinstance(t, dict) else t[3]


def merge(t: dict, other: dict) -> dict:
    """t with another template of the same kind laid over it: matched slots become one, new ones take their place in the order."""
    own, new = t["s"], other["s"]
    pairs = dict((j, i) for i, j in matching(own, new, _key, _slots, {}))
    out, done = [], 0
    for j, y in enumerate(new):
        if j in pairs:
            out += own[done : pairs[j] + 1]
            done = pairs[j] + 1
            merge(out[-1], y)
        else:
            out.append(y)
    out += own[done:]
    t["s"] = out
    return t


def numbered(t: dict) -> dict:
    """t with a number i for each slot, in page order."""
    stack, n = [t], 0
    while stack:
        x = stack.pop()
        x["i"] = n
        n += 1
        stack += reversed(x["s"])
    return t


def slots_of(page: str | None, t: dict) -> Iterator[tuple[int, int, int, int]]:
    """Of each slot of a numbered template that the page has: its number, the hash of its text, words, linked words."""
    seen: dict = {}
    stack = [(t, fold([parse(page)]))]
    while stack:
        w, f = stack.pop()
        text, words, linked = own_text(f[2])
        yield w["i"], hashed(text), words, linked
        stack += [(w["s"][i], f[3][j]) for i, j in matching(w["s"], f[3], _key, _slots, seen)]


def wrapper_of(t: dict, counted: dict[int, tuple[int, int, int, int, int]]) -> dict:
    """The slots to leave out (x) and the slot of the article (r), marked in a slimmer copy of a numbered template.

    counted: slot -> pages that have it, of those with its commonest text, that text's hash, words, linked words.
    """

    def mark(s: dict) -> dict:
        kids = [mark(c) for c in s["s"]]
        kept = sum(c["w"] for c in kids if not c["x"])
        n, same, text, own, own_linked = counted.get(s["i"], (0, 0, 0, 0, 0))
        words, linked = own + sum(c["aw"] for c in kids), own_linked + sum(c["al"] for c in kids)
        tag = s["k"].split(".")[0]
        constant = n >= PAGES and own > 0 and same >= SAME * n
        menu = tag in ("ul", "ol", "div", "section", "table", "td", "p") and words >= 4 * n and linked >= LINKED * words
        out = bool(s["o"] or menu)
        return {"k": s["k"], "x": out, "t": constant, "h": text, "n": n, "o": s["o"], "r": False, "w": 0 if out else (0 if constant else own) + kept, "aw": words, "al": linked, "s": kids}

    top = mark(t)

    def named(s: dict) -> list[dict]:
        return [] if s["x"] else [s] if s["k"].split(".")[0] in ARTICLE else [y for c in s["s"] for y in named(c)]

    total = top["w"]
    found = [s for s in named(top) if s["w"] >= 0.3 * total]
    if not found:
        at = top
        while nxt := next((c for c in at["s"] if not c["x"] and c["k"].split(".")[0] in CONTAINERS and c["w"] >= 0.85 * max(total, 1)), None):
            at = nxt
        found = [at]
    for s in found:
        s["r"] = True

    def slim(s: dict) -> dict:
        # a rare kind that says nothing, and that no other slot here could be taken for, isn't carried to the pages
        of = Counter(c["k"] for c in s["s"])
        kids = [y for c in s["s"] for y in [slim(c)] if c["n"] >= PAGES or of[c["k"]] > 1 or y["r"] or y["s"] or y["x"] and not c["o"]]
        return {"k": s["k"], "x": int(s["x"]), "t": int(s["t"]), "h": s["h"], "r": int(s["r"]), "s": [] if s["x"] else kids}

    return slim(top)


# --- reading a page


def read_text(nodes: list[Node], out: set[int], quiet: set[int]) -> str:
    """Text below the nodes in page order. out: nodes left out whole; quiet: nodes whose own text is the template's."""
    parts: list[str] = []

    def walk(n: Node, silent: bool) -> None:
        stack = [(n, silent)]
        while stack:
            x, s = stack.pop()
            if isinstance(x, str):
                if not s:
                    parts.append(x)
                continue
            if x is None:
                parts.append(" ")
                continue
            if id(x) in out or x.out:
                if x.tag not in RAW:  # a script in the middle of a word doesn't part it
                    parts.append(" ")
                continue
            s = id(x) in quiet if x.tag not in INLINE else s
            block = x.tag not in INLINE
            if block:
                parts.append(" ")
                stack.append((None, s))
            stack += [(y, s) for y in reversed(x.items)]

    for n in nodes:
        walk(n, False)
        parts.append(" ")
    return " ".join("".join(parts).split())


def plain_text(root: Node) -> str:
    """By the meaning of the page's own tags: its articles, else all of it."""
    found: list[Node] = []
    stack: list[Node] = [root]
    while stack:
        n = stack.pop()
        if n.tag in ARTICLE and not n.out:
            found.append(n)
        elif not n.out or n is root:
            stack += [x for x in reversed(n.items) if not isinstance(x, str)]
    return read_text(found or [root], set(), set())


def extract(html: str | None, wrapper: dict | None) -> str:
    root = parse(html)
    if wrapper is None:
        return plain_text(root)
    out: set[int] = set()
    quiet: set[int] = set()
    roots: list[Node] = []

    def lay(w: dict, f: list, inside: bool) -> None:
        if w["x"]:
            out.update(id(n) for n in f[2])
            return
        if w["t"] and hashed(own_text(f[2])[0]) == w["h"]:
            quiet.update(id(n) for n in f[2])
        if w["r"] and not inside:
            roots.extend(f[2])
            inside = True
        for i, j in matching(w["s"], f[3], _key, _slots, seen):
            lay(w["s"][i], f[3][j], inside)

    seen: dict = {}
    lay(wrapper, fold([root]), False)
    return (read_text(roots, out, quiet) if roots else "") or plain_text(root)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


_SHAPES = pa.schema([("host", pa.string()), ("digest", pa.string()), ("template", pa.string())])


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html): the folded tree of each page with its digest, each once a task, as far as is remembered."""
    seen: set[tuple[str, str]] = set()
    for batch in batches:
        for part in slices(batch):
            rows = []
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                made = json.dumps(template_of(fold([parse(page)])), separators=(",", ":"))
                digest = hashlib.sha256(made.encode("utf-8", "replace")).hexdigest()
                if (host, digest) not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen.add((host, digest))
                    rows.append((host, digest, made))
            yield _table(rows, _SHAPES)
    seen.clear()
    trim()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, group, digest, template), sorted: the trees of each host and group laid over each other in their order."""
    at, held, last = None, None, None
    for batch in batches:
        rows = []
        for host, group, digest, made in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, group) != at:
                if at is not None:
                    rows.append((*at, json.dumps(held, separators=(",", ":"))))
                at, held = (host, group), json.loads(made)
            elif digest != last:
                held = merge(held, json.loads(made))
            last = digest
        yield _table(rows, _SHAPES)
    if at is not None:
        yield _table([(*at, json.dumps(held, separators=(",", ":")))], _SHAPES)


def _by_groups(shapes: DataFrame, digits: int) -> DataFrame:
    """(host, digest, template): merged over all that share the first digits of their digest."""
    grouped = shapes.select("host", F.substring("digest", 1, digits).alias("group"), "digest", "template")
    return grouped.repartition("host", "group").sortWithinPartitions("host", "group", "digest").mapInArrow(_merged, "host string, digest string, template string")


class Templates:
    """JSON by host, for the tasks: broadcast if all of it is small, by a check of its size; else joined to the pages by host."""

    def __init__(self, found: DataFrame):
        size = found.agg(F.sum(F.length("template") + F.length("host")), F.count(F.lit(1))).first()
        self.found, self.held = found, None
        if (size[0] or 0) * 2 + size[1] * 100 <= BROADCAST:
            self.held = found.sparkSession.sparkContext.broadcast({r["host"]: r["template"] for r in found.collect()})

    def beside(self, pages: DataFrame) -> DataFrame:
        """pages with a last column ``template``, null where it is broadcast."""
        if self.held is not None:
            return pages.withColumn("template", F.lit(None).cast("string"))
        return pages.join(self.found.select(F.col("host").alias("t_host"), "template"), F.col("host") == F.col("t_host"), "left").drop("t_host")

    def reader(self):
        """host, JSON of the row -> the parsed template, a few being kept; runs in a task."""
        held, kept = self.held, {}

        def of(host: str, made: str | None, ready=lambda t: t) -> dict | None:
            made = held.value.get(host) if held is not None else made
            if made is None:
                return None
            if host not in kept:
                if len(kept) >= 500:
                    kept.clear()
                kept[host] = ready(json.loads(made))
            return kept[host]

        return of

    def __getstate__(self):  # goes to tasks without its table
        return {"found": None, "held": self.held}


_COUNTS = pa.schema([("host", pa.string()), ("slot", pa.int32()), ("text", pa.int64()), ("n", pa.int64()), ("words", pa.int64()), ("linked", pa.int64())])


def _counts(templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (host, html, template): for each slot and text of it, the pages that have it, and words."""
        of, held = templates.reader(), {}
        for batch in batches:
            for part in slices(batch):
                for host, page, made in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for slot, text, words, linked in slots_of(page, of(host, made, numbered)):
                        c = held.setdefault((host, slot, text), [0, 0, 0])
                        c[0] += 1
                        c[1] += words
                        c[2] += linked
                if len(held) > COUNTED:
                    yield _table([(*k, *c) for k, c in held.items()], _COUNTS)
                    held.clear()
        yield _table([(*k, *c) for k, c in held.items()], _COUNTS)
        held.clear()
        trim()

    return run


def _wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("template", pa.string())])
    for batch in batches:
        for part in slices(batch):
            rows = []
            for host, made, told in zip(*(c.to_pylist() for c in part.columns), strict=True):
                counted = {c["slot"]: (c["n"], c["m"]["same"], c["m"]["text"], c["words"], c["linked"]) for c in told}
                rows.append((host, json.dumps(wrapper_of(numbered(json.loads(made)), counted), separators=(",", ":"))))
            yield _table(rows, schema)


def wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template): the wrapper of every host, as JSON, from all its distinct pages; a table in the shared folder."""
    own = only(pages, page_id=id_col, url=url_col, html=html_col).where("html is not null").select(host_of(F.col("url")).alias("host"), "page_id", "html", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    # digests of pages that come again, a table whose size Spark knows; the row of smallest id stands for its copies
    again = own.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1")
    again = written(again.select(F.col("host").alias("a_host"), F.col("digest").alias("a_digest"), "first"), "wrapper-copies")
    joined = own.join(again, (F.col("host") == F.col("a_host")) & (F.col("digest") == F.col("a_digest")), "left")
    alone = joined.where(F.col("a_digest").isNull() | F.col("page_id").eqNullSafe(F.col("first"))).select("host", "html")
    shapes = alone.mapInArrow(_induce, "host string, digest string, template string")
    # ranges of digests first: no task holds all trees of a host
    built = written(_by_groups(_by_groups(_by_groups(shapes, 3), 1), 0).select("host", "template"), "wrapper-templates")
    templates = Templates(built)
    counts = templates.beside(alone).mapInArrow(_counts(templates), "host string, slot int, text long, n long, words long, linked long")
    by_text = counts.groupBy("host", "slot", "text").agg(*[F.sum(c).alias(c) for c in ("n", "words", "linked")])
    most = F.max(F.struct(F.col("n").alias("same"), "text")).alias("m")
    by_slot = by_text.groupBy("host", "slot").agg(most, *[F.sum(c).alias(c) for c in ("n", "words", "linked")])
    told = by_slot.groupBy("host").agg(F.collect_list(F.struct("slot", "n", "m", "words", "linked")).alias("told"))
    return written(built.join(told, "host").select("host", "template", "told").mapInArrow(_wrapped, "host string, template string"), "wrappers")


def main_text(pages: DataFrame, found: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. Wrappers are broadcast if they are small, and else joined by host."""
    own = only(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    templates = Templates(found)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = templates.reader()
        for batch in batches:
            for part in slices(batch):
                texts = [extract(page, of(host, made)) for page, host, made in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
        trim()

    return templates.beside(own.select("page_id", "url", "html", "host")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
