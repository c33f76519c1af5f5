"""Operator 5: the main text of web pages, by a style tree of each site.

A page is read as a tree of block elements; a branch is known by its path of tags with their classes.
The pages of a host are merged into one tree of all their branches, menus and footers included. A branch
has an importance there, from three figures of the host's different pages that hold it: the entropy of its
form (the elements that make it up), that of its content (of the texts of its leaves, carried upwards by
their words), and its share of the words of its pages. A branch that has one form and a small share, or the
same text on page after page, is of no importance.

The markup sets what a branch must reach. What is declared as no content (a footer, a class that says
``ad``, whatever stands beside an <article>) must hold most of the words of its pages, in texts that differ, to
stay; a branch that isn't declared goes only if it is of hardly any importance. So classes never remove the branch
that holds a page's text, and every article stays. Scripts, controls and readers' comments always go.
Pages that are copies of each other count once, so a text isn't taken for a template because it is copied.

Counting is a grouped aggregation by (host, branch, value), which no popular host makes uneven. Only branches that
are judged against their declaration travel back to the pages. These stay in their input splits if that list is
small enough to be broadcast; if not, the pages of a host are dealt by salt to as many tasks as there are
shuffle partitions, each with a copy of its list.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitlekit.llm.common import buckets_of, checkpoint

LEAST_PAGES = 4  # different pages of a host that hold a branch, for it to be removed without a declaration
LEAST_CONTENT, LEAST_IMPORTANCE, MOST = 0.15, 0.05, 0.5
BROADCAST_BYTES = 64 << 20  # verdicts are broadcast up to this measured size, and joined by a shuffle beyond
DEPTH = 512  # as in browsers, what is nested deeper belongs to the branch at this depth

# Element names of HTML, and words in classes and ids that declare what isn't content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br img".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
NEVER = frozenset(
    "head script style template noscript button select option svg math canvas object iframe textarea title audio video "
    "map noframes noembed input datalist".split()
)
SHUT = frozenset("nav footer aside menu dialog".split())
DECLARED = SHUT | {"form", "fieldset"}
MAIN = frozenset({"article", "main"})
CONTAINER = frozenset("html body div section center td th tr tbody table form fieldset article main".split())
ITEM = frozenset("li dt dd tr td th".split())  # a run of them of one form counts as one, so a list has one form at any length
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices newsletter subscribe subscription popup modal overlay menu menus nav navbar navigation "
    "breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer header masthead comment comments disqus respond "
    "reply replies share sharing social related recommended recommendations login signup pagination pager toolbar "
    "skip hidden".split()
)
NEUTRAL = frozenset(
    "site page main top bottom left right box block area section list bar item items unit slot link links post posts article "
    "articles story stories form inner outer container wrapper wrap content text primary secondary global js".split()
)
COMMENT = frozenset({"comment", "comments", "disqus", "respond", "reply", "replies"})
NOISE_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert"})
#: Opening one of these closes an open one of the set, up to the nearest element that bounds it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SCHEMA = "page_id long, url string, html string, host string"


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _noise(attributes: dict[str, str]) -> set[str]:
    """The words that declare noise, of the classes and the id that say nothing else (``has-sidebar`` does)."""
    found: set[str] = set()
    for name in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = [w for w in re.findall(r"[^\W\d_]+", name)]
        noise = NOISE.intersection(words)
        if noise and all(w in noise or w in NEUTRAL for w in words):
            found |= noise
    return found


# What the markup says of a branch: nothing; that it stands apart from the branch that holds most words; that it is content
# only if it holds most words (declared where no article is beside it, or undeclared beside one); the same, and on several
# pages (declared beside an article); that it is no content; that it is or leads to an article.
PLAIN, APART, LOW, LOWER, NEVER_TEXT, ARTICLE = range(6)


class Element:
    """An element of a page; an inline one lends its text to the block around it."""

    __slots__ = ("article", "comment", "depth", "form", "forms", "key", "kind", "label", "name", "never", "node", "noted", "own", "parent", "shut", "words")

    def __init__(self, name: str, raw: str, parent: Element | None):
        attributes = _attributes(raw)
        role, noise = attributes.get("role", ""), _noise(attributes)
        block = parent.node if parent else None
        self.name = name
        inside = block is not None and block.article
        if inside:
            noise -= {"header", "masthead"}  # the heading of the article
        if name in ("html", "body"):
            noise, role = set(), ""
        noted = bool(noise) or role in NOISE_ROLES or name in DECLARED or (name == "header" and not inside)
        self.never = (parent is not None and parent.never) or name in NEVER or "hidden" in raw.lower().split() or (noted and name in INLINE)
        self.comment = (parent is not None and parent.comment) or bool(COMMENT & noise)
        self.parent = block
        if name in INLINE or (block is not None and block.depth >= DEPTH):
            self.node = block
            if block is not None:
                return
        self.node = self
        self.depth = block.depth + 1 if block else 0
        self.label = name + "".join("." + c for c in attributes.get("class", "").split())
        self.shut = (block is not None and block.shut) or name in SHUT or (name == "header" and not inside)
        self.noted = noted
        self.kind = NEVER_TEXT if noted and self.shut else LOW if noted else PLAIN
        # an article inside what elements declare as no content, or among comments, is none
        self.article = not self.comment and not self.shut and (inside or name in MAIN or role == "main")
        self.words, self.own, self.forms, self.form, self.key = 0, [], [], 0, 0


def parse(page: str) -> tuple[list[Element], list[tuple[Element, str]]]:
    """The block elements of a page, parents first, and its (element, text) blocks, in order; no scripts and controls."""
    root = Element("html", "", None)
    nodes, out = [root], []
    stack: list[Element] = [root]
    text: list[str] = []
    at = 0

    def flush() -> None:
        words = " ".join("".join(text).split())
        if words:
            out.append((stack[-1].node, words))
        text.clear()

    def close(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                if any(e.name not in INLINE for e in stack[k:]):
                    flush()
                del stack[k:]
                return
            if name in INLINE and stack[k].name not in INLINE:
                return  # misnested: the element was closed by a block's end

    while at < len(page):
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not stack[-1].never and not stack[-1].comment:
            text.append(html.unescape(page[at:end]))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name == "br":
            if not stack[-1].never and not stack[-1].comment:
                text.append(" ")
            continue
        if m[1]:
            close(name)
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name == "html":
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES:
                kinds, bounds = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in bounds:
                        break
                    if stack[k].name in kinds:
                        del stack[k:]
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name not in INLINE:
                    break
        element = Element(name, m[3] or "", stack[-1])
        if name in RAW:
            stop = re.compile(f"</{name}", re.I).search(page, at)
            stop = stop.start() if stop else len(page)
            if not element.never and not element.comment and stop > at:
                text.append(html.unescape(page[at:stop]))
            at = stop
            closing = page.find(">", at)
            at = closing + 1 if closing >= 0 else len(page)
            continue
        if element.node is element and not element.never and not element.comment:
            nodes.append(element)
        if not (m[3] or "").rstrip().endswith("/") or name in ("p", "div", "article", "main", "section"):
            stack.append(element)
    flush()
    return _settle(nodes, out)


def _settle(nodes: list[Element], found: list[tuple[Element, str]]) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Words, forms, kinds and keys of all branches."""
    for node, text in found:
        node.words += len(text.split())
    free = {id(e): e.words for e in nodes}  # words outside of declared branches
    for e in reversed(nodes):
        if e.parent is not None:
            e.parent.words += e.words
            free[id(e.parent)] += 0 if e.noted else free[id(e)]
    mains = [e for e in nodes if e.article and e.words and not (e.parent is not None and e.parent.article)]
    if mains:
        nodes, found = _beside_articles(nodes, found, mains)
    else:
        _apart(nodes, free)
    for e in nodes:
        e.key = _digest(f"{e.parent.key if e.parent is not None else 0}>{e.label}#{e.kind}")
    for e, text in found:
        e.own.append(text)
    for e in reversed(nodes):
        e.form = _digest(e.label + ",".join(map(str, reversed(e.forms))))
        if e.parent is not None and not (e.name in ITEM and e.parent.forms[-1:] == [e.form]):
            e.parent.forms.append(e.form)
    return nodes, found


def _beside_articles(nodes: list[Element], found: list[tuple[Element, str]], mains: list[Element]) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Sets the kinds of a page with articles: those in declared branches count only where there are no others."""
    under: set[int] = set()
    for e in nodes:
        if e.noted or (e.parent is not None and id(e.parent) in under):
            under.add(id(e))
    trunk: dict[int, Element] = {}
    for e in [m for m in mains if id(m) not in under] or mains:
        while e is not None and id(e) not in trunk:
            trunk[id(e)], e = e, e.parent
    for e in nodes:
        if id(e) in trunk:
            e.kind = ARTICLE
        elif e.parent is not None and id(e.parent) in trunk and not e.parent.article and e.kind in (PLAIN, LOW):
            e.kind = LOWER if e.noted else LOW
    loose: dict[int, Element] = {}  # text right in the trunk is a branch of its own
    moved = []
    for e, text in found:
        if id(e) in trunk and not e.article:
            if id(e) not in loose:
                loose[id(e)] = child = Element("#text", "", e)
                child.kind = LOW
            loose[id(e)].words += len(text.split())
            e = loose[id(e)]
        moved.append((e, text))
    return nodes + list(loose.values()), moved


def _apart(nodes: list[Element], free: dict[int, int]) -> None:
    """Sets what stands apart from the containers that each hold most words of the one around them."""
    undeclared = free[id(nodes[0])] > 0
    words = free if undeclared else {id(e): e.words for e in nodes}
    children: dict[int, list[Element]] = {}
    for e in nodes[1:]:
        if e.name in CONTAINER:
            children.setdefault(id(e.parent), []).append(e)
    at, trunk = nodes[0], []
    while at is not None:
        trunk.append(at)
        inner = children.get(id(at), ())
        at = next((e for e in inner if 2 * words[id(e)] > words[id(at)] and not (e.noted and undeclared)), None)
        if at is not None:
            for c in inner:
                if c is not at and c.kind == PLAIN:
                    c.kind = APART


def blocks(page: str, verdicts: frozenset[int] = frozenset()) -> list[tuple[str, str, bool]]:
    """(element with its classes, text, in an article) of the blocks of a page that stay, in order.

    A branch in ``verdicts`` is judged against what the markup says of it.
    """
    nodes, found = parse(page)
    gone: set[int] = set()
    for e in nodes:
        if (e.parent is not None and id(e.parent) in gone) or (e.kind in (LOW, LOWER, NEVER_TEXT)) != (e.key in verdicts):
            gone.add(id(e))
    return [(e.label, t, e.article) for e, t in found if id(e) not in gone]


def _forms(same: list[Element]) -> list[int]:
    return [e.form for k, e in enumerate(same) if not (k and e.name in ITEM and e.form == same[k - 1].form)]


def page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The branches of each page: words, digests of their own text and of their form, and the branches around them."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in TREE.names}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            nodes, found = parse(page)
            whole = _digest("\n".join(t for _, t in found))
            merged: dict[int, list[Element]] = {}
            for e in nodes:
                if e.words:
                    merged.setdefault(e.key, []).append(e)
            for name, same in merged.items():
                e, own, around = same[0], [t for x in same for t in x.own], []
                up = e if own else None
                while up is not None:
                    around.append(up.key)
                    up = up.parent
                row = (host, whole, name, e.kind, sum(x.words for x in same), nodes[0].words, sum(len(t.split()) for t in own),
                       _digest("\n".join(own)) if own else None, _digest(",".join(map(str, _forms(same)))), around)
                for k, v in zip(out, row):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in TREE], schema=TREE)


TREE = pa.schema(
    [("host", pa.string()), *((k, pa.int64()) for k in ("page", "branch", "kind", "words", "of_words", "own_words", "content", "form")),
     ("around", pa.list_(pa.int64()))]
)


def _entropy(counts: DataFrame, name: str) -> DataFrame:
    """(host, branch, pages, name) from the number n of pages of each value: entropy over that of all different."""
    grouped = counts.groupBy("host", "branch").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
    h = (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")
    return grouped.select("host", "branch", "pages", F.when(F.col("pages") > 1, h).otherwise(1.0).alias(name))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, branch, kind, pages, form, content, share, importance) of each branch; ``pages`` has host and html.

    ``content`` of a leaf is the entropy of its texts over the pages, of a branch the mean of its leaves by their words;
    ``share`` is its part of all words of the pages that hold it; importance is content times the larger of form and share.
    """
    schema = "host string, page long, branch long, kind long, words long, of_words long, own_words long, content long, form long, around array<long>"
    nodes = checkpoint(pages.select("host", "html").mapInArrow(page_nodes, schema).distinct())
    form = _entropy(nodes.groupBy("host", "branch", "form").agg(F.count(F.lit(1)).alias("n")), "form")
    leaf = _entropy(nodes.where("content is not null").groupBy("host", "branch", "content").agg(F.count(F.lit(1)).alias("n")), "content").drop("pages")
    sums = nodes.groupBy("host", "branch").agg(
        F.min("kind").alias("kind"), (F.sum("words") / F.sum("of_words")).alias("share"), F.sum("own_words").alias("own"),
        F.max("around").alias("around"),  # equal on all pages, as a branch is named by its path
    )
    carried = (
        sums.join(leaf, ["host", "branch"]).select("host", F.explode("around").alias("branch"), "own", "content")
        .groupBy("host", "branch").agg((F.sum(F.col("own") * F.col("content")) / F.sum("own")).alias("content"))
    )
    tree = sums.drop("own", "around").join(form, ["host", "branch"]).join(carried, ["host", "branch"])
    return tree.withColumn("importance", F.col("content") * F.greatest("form", "share"))


def against_markup(tree: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, branch) that the tree judges against the markup: declared ones that stay, others that go."""
    kind, several = F.col("kind"), F.col("pages") >= least_pages
    stays = ((kind == LOW) | ((kind == LOWER) & several)) & (F.col("share") >= MOST) & (F.col("content") >= LEAST_CONTENT)
    template = (F.col("content") < LEAST_CONTENT) & (F.col("share") < MOST)
    goes = kind.isin(PLAIN, APART) & several & (template | ((kind == APART) & (F.col("importance") < LEAST_IMPORTANCE)))
    return tree.where(stays | goes).select("host", "branch")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, noise in zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist()):
            texts.append("\n".join(t for _, t, _ in blocks(page, frozenset(noise or ()))))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _with_noise(sited: DataFrame, noise: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``sited`` with the list of branches of its host that are judged against their markup."""
    size = noise.agg(F.sum(F.size("noise") * F.lit(8) + F.octet_length("host") + 64)).first()[0] or 0
    if size <= broadcast_bytes:
        return sited.join(F.broadcast(noise), "host", "left")
    salts = buckets_of(sited.sparkSession)
    salted = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = sited.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(salts)).cast("int"))
    return dealt.join(salted.hint("shuffle_hash"), ["host", "salt"], "left")


def extract_text(pages: DataFrame, *, least_pages: int = LEAST_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Blocks are in page order, joined by a line end; white space inside a block is one space. On fewer than
    ``least_pages`` different pages that hold it, a branch goes only if the markup declares it. A null or empty page
    has the empty text; a null url is a host of its own kind; repeated rows give a row each; an empty table gives
    an empty table. A page of any length and nesting is read whole; branches nested deeper than ``DEPTH`` are one.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    sited = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"),
    )
    verdicts = against_markup(style_tree(sited), least_pages)
    noise = checkpoint(verdicts.groupBy("host").agg(F.collect_list("branch").alias("noise")))
    return _with_noise(sited, noise, broadcast_bytes).select("page_id", "url", "html", "noise").mapInArrow(_extract, "page_id long, url string, text string")
