"""Operator 5: the style tree decides, and no class removes the text of a page."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from entitlekit.llm import htmltext

STORY = "the long story of a page with many words in it that nobody else tells " * 4


def _texts(page, verdicts=frozenset()):
    return [t for _, t, _ in htmltext.blocks(page, verdicts)]


def _extract(spark, pages):
    rows = [(k, url, page) for k, (url, page) in enumerate(pages)]
    found = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def test_classes_that_say_more_declare_nothing():
    for wrapper in ("container has-sidebar", "post no-comments", "layout with-widget"):
        assert _texts(f'<div class="{wrapper}"><h1>A</h1><p>{STORY}</p></div>') == ["A", STORY.strip()]
    assert _texts('<article><p class="share-price">up</p><section class="related-work"><p>cited</p></section></article>') == ["up", "cited"]
    assert _texts('<div class="layout with-widget"><article>one</article><article>two</article></div>') == ["one", "two"]
    assert _texts('<article>one</article><div class="related-posts"><article>teaser</article></div>') == ["one"]
    assert _texts('<div class="widget"><article>one</article><article>two</article></div>') == ["one", "two"]
    assert _texts('<article>a<div class="site-footer">f</div><div class="comments"><article>c</article></div></article>') == ["a"]
    assert _texts("<aside><article>side</article></aside><p>text</p>") == ["text"]


def test_the_branch_with_most_words_stays(spark):
    form = f'<body><form id="page"><div class="x"><p>{STORY}</p></div><input><button>go</button></form></body>'
    teaser = f'<body><article>read more</article><div class="story"><p>{STORY}</p></div><footer>f</footer></body>'
    widget = f'<body><div class="widget"><p>{STORY}</p></div><div class="newsletter"><p>mail me</p></div></body>'
    got = _extract(spark, [("http://a.example/", form), ("http://b.example/", teaser), ("http://c.example/", widget), ("http://d.example/", "<nav>x</nav>")])
    assert got == [STORY.strip(), "read more\n" + STORY.strip(), STORY.strip(), ""]


def test_forms_and_texts_that_repeat_go_without_a_declaration(spark):
    def page(k):
        menu = "".join(f"<li><a href=/{j}>m{k + j}</a>" for j in range(4))
        body = "".join(f"<p>{k} {j} {STORY}" for j in range(1 + k % 3))
        return f"<body><div class=q1><ul>{menu}</ul></div><div class=q2><h1>T{k}</h1>{body}<div class=q4>Share this</div></div><div class=q3>c {k}</div>"

    got = _extract(spark, [("http://a.example/", page(k)) for k in range(6)] + [("http://b.example/", page(k)) for k in range(2)])
    for k in range(6):
        assert got[k].split("\n") == [f"T{k}", *(f"{k} {j} {STORY.strip()}" for j in range(1 + k % 3))]
    for k in range(2):
        assert "Share this" in got[6 + k] and f"T{k}" in got[6 + k]  # two pages say too little


def test_the_tree_agrees_with_brute_force(spark):
    pages = [("h", f"<div class=a>menu</div><div class=b><p>{k % 3} x</p>" + "<p>y</p>" * (k % 2) + "</div>") for k in range(5)]
    tree = {r["branch"]: r for r in htmltext.style_tree(spark.createDataFrame(pages + pages[:2], "host string, html string")).collect()}
    pages = list(dict.fromkeys(p for _, p in pages))
    whole, forms, texts, share = set(), defaultdict(list), defaultdict(list), defaultdict(lambda: [0, 0])
    leaves: dict[int, dict[int, int]] = defaultdict(dict)
    for page in pages:
        nodes, found = htmltext.parse(page)
        if (said := tuple(t for _, t in found)) in whole:
            continue
        whole.add(said)
        same = defaultdict(list)
        for e in nodes:
            if e.words:
                same[e.key].append(e)
        for key, es in same.items():
            forms[key].append(tuple(e.form for e in es))  # no lists here, whose runs count once
            share[key][0] += sum(e.words for e in es)
            share[key][1] += nodes[0].words
            if es[0].own:
                texts[key].append(tuple(t for e in es for t in e.own))
                up = es[0]
                while up is not None:
                    leaves[up.key].setdefault(key, 0)
                    up = up.parent

    def entropy(values):
        n = len(values)
        return 1.0 if n < 2 else -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(n)

    words = {key: sum(len(t.split()) for said in texts[key] for t in said) for key in texts}
    assert set(tree) == set(forms)
    for key, r in tree.items():
        under = leaves[key]
        content = sum(words[k] * entropy(texts[k]) for k in under) / sum(words[k] for k in under)
        assert r["pages"] == len(forms[key])
        assert r["form"] == pytest.approx(entropy(forms[key])) and r["content"] == pytest.approx(content)
        assert r["share"] == pytest.approx(share[key][0] / share[key][1])
        assert r["importance"] == pytest.approx(content * max(entropy(forms[key]), share[key][0] / share[key][1]))


def test_the_tree_alone_finds_menus_and_footers(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("host", F.lit("one"))
    tree = {r["branch"]: r for r in htmltext.style_tree(pages).collect()}
    for (page,) in pages.select("html").limit(20).collect():
        for e in htmltext.parse(page or "")[0]:
            if e.words and e.label in ("nav", "footer", "div.ad"):
                assert tree[e.key]["importance"] < htmltext.LEAST_IMPORTANCE
            if e.label == "article" and e.words:
                assert tree[e.key]["importance"] > htmltext.MOST


def test_class_names_carry_no_text_away(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    named = htmltext.extract_text(pages)
    swapped = htmltext.extract_text(pages.withColumn("html", F.regexp_replace("html", r'class="[^"]*"', 'class="zq7"')))
    undone = pages.withColumn("html", F.regexp_replace("html", "<(/?)(article|nav|footer)", "<$1div"))
    words = lambda df: Counter(w for r in df.select("text").collect() for w in re.findall(r"\S+", r["text"]))
    a, b, c = words(named), words(swapped), words(htmltext.extract_text(undone))
    assert sum((a - b).values()) <= 0.02 * sum(a.values())
    assert sum((a - c).values()) <= 0.02 * sum(a.values())


def test_deep_and_broken_pages(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    got = _extract(spark, [("http://a.example/", deep), (None, "</p></div>x<b"), ("", "<article></article>y"), ("http://a.example/", None)])
    assert got == ["deep", "x", "y", ""]
