"""The text operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from entitlekit.llm import (
    components, decontamination, htmltext, licenses, minhash, packing, quality, recompression, secrets, suffixes, toxicity,
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def _text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 9, n)))


def _documents() -> list[tuple]:
    shared = _text(1, 60)
    rows = [(0, None), (1, ""), (2, "one two"), (3, _text(3, 200) + "\n" + shared), (4, shared + " " + _text(4, 100)),
            (5, _text(3, 200) + "\n" + shared), (6, "same " * 80), (7, "same " * 45 + "end"), (8, "a b " * 60),
            (9, "é ü " * 40 + shared), (10, "x" * 300), (11, "y" * 20 + "x" * 120), (None, shared)]
    return rows + [(3, _text(3, 200) + "\n" + shared)]


def _frame(spark, rows, columns="doc_id long, text string"):
    """Rows with extra columns whose names clash with those that the operators use."""
    df = spark.createDataFrame(rows, columns)
    return df.withColumns({c: F.lit("clash") for c in ("tag", "part", "kind", "found", "node", "score", "words", "n")})


@pytest.fixture(scope="module")
def docs(spark):
    return _frame(spark, _documents()).repartition(3)


def _kept_words(rows):
    seen, out = {}, []
    known = sorted({r for r in rows if r[0] is not None})
    for doc, text in known:
        words = (text or "").split()
        for p in range(len(words) - 19):
            seen.setdefault(tuple(words[p : p + 20]), (doc, p))
    for doc, text in rows:
        words, gone = (text or "").split(), set()
        for p in range(len(words) - 19 if doc is not None else 0):
            if seen[tuple(words[p : p + 20])] < (doc, p):
                gone |= set(range(p, p + 20))
        out.append((doc, len(words), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return Counter(out)


def test_recompression_equals_brute_force(docs):
    got = recompression.cut_repeated_windows(docs).select("doc_id", "n_words", "kept").collect()
    assert Counter(map(tuple, got)) == _kept_words(_documents())


def test_suffixes_equal_brute_force(docs):
    rows, first = _documents(), {}
    for doc, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49 if doc is not None else 0):
            first[raw[p : p + 50]] = min(doc, first.get(raw[p : p + 50], doc))
    want = []
    for doc, text in rows:
        raw, keep = (text or "").encode(), []
        gone = set()
        for p in range(len(raw) - 49 if doc is not None else 0):
            if first[raw[p : p + 50]] < doc:
                gone |= set(range(p, p + 50))
        keep = bytes(b for i, b in enumerate(raw) if i not in gone)
        want.append((doc, len(raw), keep))
    got = suffixes.cut_repeated_strings(docs).select("doc_id", "n_bytes", "kept").collect()
    assert Counter((r[0], r[1], bytes(r[2])) for r in got) == Counter(want)


def test_long_texts_are_cut_into_chunks_alike(spark, monkeypatch):
    monkeypatch.setattr(recompression, "STEP", 64)
    scheme = recompression.SCHEME
    small = recompression.Scheme(scheme.depth, 64, scheme.units, scheme.runs, scheme.payload, scheme.sizes, scheme.group)
    monkeypatch.setattr(recompression, "SCHEME", small)
    rows = [(1, _text(1, 500)), (2, _text(2, 100) + " " + _text(1, 500))]
    got = recompression.cut_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.select("doc_id", "n_words", "kept").collect())) == _kept_words(rows)


def test_packing_round_trip(docs):
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(packing.TOKENIZER)
    rows = packing.pack(docs, capacity=128).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for doc, text in _documents():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes()
        own = sorted(pieces[doc, len(ids) // 4], key=lambda r: (r["sequence_id"], r["offset"]))
        copies = 2 if doc == 3 else 1
        assert sum(len(r["ids"]) for r in own) == copies * len(ids)
        assert all(bytes(r["ids"]) == ids[4 * r["start"] : 4 * (r["start"] + r["length"])] for r in own)
    lengths = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == lengths[r["sequence_id"]]
        lengths[r["sequence_id"]] += r["length"]
    assert max(lengths.values()) <= 128


def test_tokenizer_units_equal_whole_texts():
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(packing.TOKENIZER)
    own = packing.WordTokenizer(packing.TOKENIZER)
    texts = ["Don't stop. It's 3.14, e.g. 'x'!", "É'À…—“quoted”, áb <|endoftext|> A<|EndOfText|>", "x×y ß×2 İstanbul ΣΑΣ", "$%&''s 've ... (a)[b]", " nbsp em \x1cfs", ""]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    ids, bounds = own.encode(np.frombuffer(b"".join(data), np.uint8), offsets)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_best_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(20):
        places = [0, *np.cumsum(rng.integers(1, 9, 30)).tolist()]
        penalties = [0, *rng.integers(0, 5, 29).tolist(), 0]
        cost = {0: 0}
        for j in range(1, 31):
            cost[j] = min((cost[i] + 16 - (places[j] - places[i]) + penalties[j] for i in range(j) if places[j] - places[i] <= 16), default=10**9)
        cuts = packing.best_cuts(places, penalties, 16, lambda n: n * 10**6)
        steps = [0, *cuts]
        assert cuts[-1] == 30
        assert sum(16 - (places[b] - places[a]) + penalties[b] for a, b in zip(steps, steps[1:])) == cost[30]


def test_quality_base_counts(docs):
    got = Counter(tuple(r) for r in quality.judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for doc, text in _documents():
        words = (text or "").split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        counts, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        want[doc, len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)] += 1
    assert got == want


def test_quality_counts_by_strings_alike(spark):
    rows = [(i, t) for i, (_, t) in enumerate(_documents()) if t is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.array_remove(F.split("text", quality.WHITE), "").alias("words"), "doc_id")
    df = df.withColumn("n", F.size("words"))
    slow = {r[0]: r[1] for r in df.select("doc_id", quality.by_strings("words", "n")).collect()}
    fast = {r[0]: r[1] for r in quality.features(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_repeat_words").collect()}
    assert slow == fast


def test_near_classes_equal_brute_force(spark):
    base = [_text(100 + g, 120).split() for g in range(6)]
    rng, rows = np.random.default_rng(7), []
    for i in range(90):
        words = list(base[i % 6])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 120))] = f"new{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "two words"), (203, "two  words"), (5, rows[5][1])]
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = Counter((d, find(d)) for d, _ in rows)
    assert Counter(map(tuple, minhash.near_classes(_frame(spark, rows)).collect())) == want


def test_links_of_a_group_equal_brute_force():
    def linked(nodes, sets, weighted=False):
        root = {n: n for n in nodes}
        for a, b in minhash.link_group(np.array(nodes), [np.array(sorted(s), np.uint64).tobytes() for s in sets], weighted, 0.8):
            ra, rb = root[a], root[b]
            root = {n: rb if r == ra else r for n, r in root.items()}
        return [[root[a] == root[b] for b in nodes] for a in nodes]

    def brute(sets):
        reach = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
        for _ in sets:
            reach = reach @ reach
        return reach.tolist()

    # i-x, b-y, b-z and the bridge x-y; the star of b is larger and has shingles of its own, so it comes second
    core = set(range(100))
    x, y = core, (core - set(range(10))) | {200, 201}
    i = core - set(range(90, 100))
    b = (y - set(range(10, 20))) | {300}
    z = (b - set(range(20, 28))) | {400}
    sets = [i, x, b, y, z]
    want = brute(sets)
    assert want[1][3] and linked([1, 2, 3, 4, 5], sets) == want
    rng = np.random.default_rng(5)
    for _ in range(300):
        sets = [set(range(40)) - set(rng.choice(40, rng.integers(0, 9), replace=False).tolist()) | set(rng.integers(40, 50, rng.integers(0, 4)).tolist()) for _ in range(12)]
        assert linked(list(range(12)), sets) == brute(sets)


def test_signatures_estimate_weighted_similarity():
    names = np.arange(300, dtype=np.uint64) * np.uint64(7919) + np.uint64(1)
    x = (names[:200], np.linspace(0.5, 3.0, 200))
    y = (names[100:], np.full(200, 2.0))
    wx, wy = dict(zip(*map(list, x))), dict(zip(*map(list, y)))
    want = sum(min(wx.get(n, 0), wy.get(n, 0)) for n in names) / sum(max(wx.get(n, 0), wy.get(n, 0)) for n in names)
    sx, sy = minhash.signatures([x, y])
    assert abs((sx == sy).mean() - want) < 0.15


def test_weighted_classes(spark):
    text = _text(1, 100)
    rows = [(1, text), (2, text + (" " + " ".join(text.split()[:20])) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[1] for r in minhash.near_classes(df, weighted=True).collect()} == {1, 2}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 101), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99}


@pytest.mark.parametrize("block_bytes", [1 << 21, 150])
def test_passages_equal_brute_force(spark, block_bytes):
    item = _text(50, 30)
    items = [(1, item), (2, "short Item here"), (3, None), (4, ""), (1, item), (None, _text(51, 20)), (10, item.upper())]
    rows = [(1, "x y " + " ".join(item.split()[5:22]) + " z"), (2, "a SHORT, item here b"), (3, None), (4, _text(51, 20)), (5, " ".join(item.split()[:12])), (1, "x y " + " ".join(item.split()[5:22]) + " z"), (None, item)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = Counter()
    for doc, text in rows:
        w, hit, listed = words(text), set(), set()
        for name, passage in items:
            p = words(passage)
            for k in range(max(1, len(p) - 12) if p else 0):
                window = p[k : k + 13]
                for at in range(len(w) - len(window) + 1):
                    if w[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        listed |= {str(name)} if name is not None else set()
        want[doc, len(w), len(hit), tuple(sorted(listed))] += 1
    found = decontamination.find_passages(_frame(spark, rows), _frame(spark, items, "item_id long, text string"), block_bytes)
    got = decontamination.contamination(found).select("doc_id", "n_words", "n_hit", "items").collect()
    assert Counter((r[0], r[1], r[2], tuple(r[3])) for r in got) == want


def test_secrets_in_layers(spark):
    import base64
    import gzip
    from urllib.parse import quote

    plain = "password=hunter22222"
    coded = base64.b64encode(plain.encode()).decode()
    cases = ["say " + plain, "x " + coded + " y", "x " + quote("password = 'hunter22222'", safe="") + " y", "é " + base64.b64encode(gzip.compress(b"my secret: abcdefgh123")).decode(),
             "".join(f"\\u{ord(c):04x}" for c in plain), "d " + base64.b64encode(coded.encode()).decode()]
    rows = [(i, t) for i, t in enumerate([*cases, None, "", "token: short", "nothing %25%32%35"])]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(_frame(spark, rows)).collect()}
    for i, text in enumerate(cases):
        assert got[i]["spans"] and "hunter" not in got[i]["text"], text
        assert bool(got[i]["base"]) == (i == 0)
    assert all(not got[i]["spans"] for i in range(len(cases), len(rows)))
    assert [(s["kind"], s["start"], s["end"]) for s in got[0]["base"]] == [("assign", 4, 24)]
    masked = secrets.mask_secrets(spark.createDataFrame([(1, "é " + plain, 22), (None, None, None)], "doc_id long, text string, n_chars long")).collect()
    assert [tuple(r) for r in masked] == [(1, "é [SECRET]", 10), (None, None, None)]


def test_repeated_secrets_in_layers():
    import base64
    import zlib
    from urllib.parse import quote

    once = lambda t: base64.b64encode(t if isinstance(t, bytes) else t.encode()).decode()
    inner = once("password=hunter22222")
    for coded in (once(inner), once(once(inner)), quote(inner.replace("p", "%70"), safe=""), once(zlib.compress(inner.encode())), once("x " + quote("token: 'abcdefgh1'", safe=""))):
        text = f"a {coded} b\nand\nc {coded} d\n{coded}"
        base, every = secrets.scan(text)
        starts = [m.start() for m in re.finditer(re.escape(coded), text)]
        assert not base and len(starts) == 3
        for start in starts:
            assert any(start <= a < b <= start + len(coded) for a, _, b in every), (coded, start)
        assert "[SECRET]" in (masked := secrets.redact(text, every)) and coded not in masked


def test_secrets_in_bytes_of_any_kind(monkeypatch):
    import base64
    import bz2
    import gzip
    import lzma
    import zlib
    from urllib.parse import quote

    plain = "password=hunter22222"
    once = lambda t: base64.b64encode(t if isinstance(t, bytes) else t.encode()).decode()
    cases = [plain.encode("utf-16"), plain.encode("utf-16-be"), b"\xef\xbb\xbf" + plain.encode(), b"\0user\0" + plain.encode(), "clé\u00a0: é ".encode() + plain.encode(),
             b"\xff\xfe\x01 " + plain.encode(), ("\u202e\x1b[0m " + plain).encode(), *(pack(b"first") + pack(plain.encode()) for pack in (gzip.compress, bz2.compress, lzma.compress)),
             gzip.compress("é".encode() * 50 + b"\xff " + plain.encode()), gzip.compress(zlib.compress(plain.encode())), gzip.compress(plain.encode("utf-16"))]
    for data in cases:
        text = f"é {once(data)} end"
        (a, _, b), *_ = secrets.scan(text)[1]
        assert 2 <= a < b <= len(text) - 4, data
    assert secrets.scan("x " + quote(plain.encode("utf-16-le")) + " y")[1]
    for before in ("/", "/conf/", "abc", "key_"):
        for coded in (once(plain), once(gzip.compress(plain.encode()))):
            assert secrets.scan(f"{before}{coded}\nabcdefghijklmnopqrs")[1], (before, coded)
    assert secrets.scan("abcdefghijklmnopqrst\nx" + once(plain))[1]
    # beyond the old bound, with the secret far behind and a piece end inside a character
    monkeypatch.setattr(secrets, "CHUNK", 1 << 20)
    body = "é".encode() * (33 << 20) + b" " + plain.encode() + b" " + b"\xc3\xa9" * 5
    assert secrets.scan("x " + once(zlib.compress(body, 1)) + " y")[1]
    parts = list(secrets._pieces(iter([b"a b\nc: ", b"dd;\n passw", b"ord=abcdefgh1\n", b"\xff\xffend"])))
    assert b"".join(parts) == b"a b\nc: dd;\n password=abcdefgh1\n\xff\xffend" and any(b"password=abcdefgh1" in p for p in parts)


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"]
    rows = [(1, "intro\n" + licenses.TEMPLATES["mit-notice"] + "\nmore"), (2, mit), (3, "some text\n\n" + mit.replace("Software", "Program", 2) + "\n\nend"), (4, None), (5, ""), (6, "word"), (1, "again")]
    got = {(r["doc_id"], r["licenses"], r["best_license"]) for r in licenses.licenses_of(_frame(spark, rows), licenses.templates_table(spark)).collect()}
    assert got == {(1, "mit-notice", "mit-notice"), (2, "mit", "mit"), (3, "mit", "mit"), (4, "", None), (5, "", None), (6, "", None)}


def test_licenses_of_several_paragraphs_inside_a_text(spark):
    def published(name, breaks, mark=""):
        text = licenses.TEMPLATES[name]
        for b in breaks:
            assert b in text.replace("\n", " ")
            text = re.sub(re.escape(b).replace(r"\ ", r"\s"), "\n\n" + b, text)
        return "\n".join(mark + line for line in text.split("\n"))

    mit = published("mit", ["The above copyright", "THE SOFTWARE IS PROVIDED"])
    apache = published("apache-2.0-header", ["You may obtain", "http://www", "Unless required"], "# ")
    gpl = published("gpl-3.0-header", ["This program is distributed", "You should have"], " * ")
    code = "\n".join(f"def f{i}(x):\n    return x + {i}\n" for i in range(30))
    prose = _text(9, 300)
    notice = licenses.TEMPLATES["mit-notice"]
    rows = [(1, f"# Title\n\n{prose}\n\n{mit}\n\n{code}"), (2, f"{apache}\n\n{code}"), (3, f"/*\n{gpl}\n */\n{code}"), (4, f"{prose}. {notice} {prose}"),
            (5, f"{prose}. {' '.join(mit.split())} {prose}"), (6, f"{prose}\n{code}")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.licenses_of(_frame(spark, rows), licenses.templates_table(spark)).collect()}
    wanted = {1: "mit", 2: "apache-2.0-header", 3: "gpl-3.0-header", 4: "mit-notice", 5: "mit"}
    assert all(name in got[k].split(",") for k, name in wanted.items()) and got[6] == "", got


def test_html_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav>
    <div class="cookie-notice">cookies</div><header>site</header><article class=post><h1>A &amp; B</h1><p>one
    two<br>three<p>four <b>bold</b>text<script>var x="</p>";</script><ul><li>i<li>j</ul><div class="comments"><p>reader</div>
    <aside>side</aside></article><footer>foot</footer></body></html>"""
    assert [t for _, t, _ in htmltext.blocks(page)] == ["A & B", "one two three", "four boldtext", "i", "j"]
    assert htmltext.blocks("") == [] and [t for _, t, _ in htmltext.blocks("plain <i>text")] == ["plain text"]


def test_style_tree_removes_templates(spark):
    page = lambda k: f"<body><div class=promo2><p>Read our offer</p></div><div class=story><p>{_text(k, 30)}</p></div>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(8)] + [(20 + k, "https://b.example/", page(99)) for k in range(9)] + [(50, None, None)]
    pages = _frame(spark, rows, "page_id long, url string, html string").withColumn("salt", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(pages).collect()}
    assert got == {r["page_id"]: r["text"] for r in htmltext.extract_text(pages, broadcast_bytes=0).collect()}
    assert all(got[k] == _text(k, 30) for k in range(8))
    assert all(_text(99, 30) in got[20 + k] for k in range(9)) and got[50] == ""


def test_toxicity_ignores_group_names(spark):
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        who = "women" if bad or i % 7 == 0 else "people"
        rows.append((i, f"{_text(i, 20)}. {'the idiot scum' if bad else 'the kind folk'} spoke of {who} there."))
        labels.append((i, int(bad)))
    model = toxicity.train(_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    tests = [(1, "what an idiot scum"), (2, "the women spoke there"), (3, None), (4, ""), (5, "the men spoke there")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(_frame(spark, tests), model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] < 0.5 and abs(got[2] - got[5]) < 0.2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    frames = [
        packing.pack(docs), quality.judge_quality(docs), recompression.cut_repeated_windows(docs), suffixes.cut_repeated_strings(docs),
        minhash.near_classes(docs), secrets.scan_secrets(docs), licenses.licenses_of(docs, licenses.templates_table(spark)),
        decontamination.find_passages(docs, items), toxicity.score_toxicity(docs, toxicity.train(docs, labels)),
        htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r["doc_id"] for r in decontamination.contamination(decontamination.find_passages(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))).where("contaminated").collect()}
    kept = corpus_pipeline.drop_contaminated(spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    one = corpus_pipeline.keep_one_of_each(spark, docs, sf)
    assert one.columns == docs.columns and {r[0] for r in one.select("doc_id").collect()} == {r["doc_id"] for r in minhash.near_classes(docs).where("doc_id = class_id").collect()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert pieces and {r["doc_id"] for r in pieces} <= {r["doc_id"] for r in docs.collect()} - bad
