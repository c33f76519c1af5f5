"""Vector codes, shards and the source audit against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entitlekit.llm import divergence, sharding, vectorcodes
from entitlekit.llm.queries import QUERIES

CLASH = ("code", "error", "shard", "slot", "range", "sort_key", "digest", "place", "p", "its_label", "label_error", "weight")


def _clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


# ---- vector codes -------------------------------------------------------------------------------


@given(st.integers(1, 9).flatmap(lambda w: st.tuples(
    st.lists(st.lists(st.integers(-50, 50), min_size=w, max_size=w), min_size=1, max_size=12),
    st.lists(st.lists(st.integers(-50, 50), min_size=w, max_size=w), min_size=1, max_size=12),
)), st.sampled_from([1, 2**40]))
@settings(max_examples=60, deadline=None)
def test_nearest_entry_equals_brute_force(case, factor):
    x, book = (np.array([[v * factor for v in row] for row in rows], np.int64) for rows in case)
    index, far = vectorcodes.assign(x, book)
    for i, row in enumerate(x.tolist()):
        distances = [sum((a - b) ** 2 for a, b in zip(row, entry)) for entry in book.tolist()]
        assert int(far[i]) == min(distances) and int(index[i]) == distances.index(min(distances))


@pytest.mark.parametrize("m", [1, 2, 8, 16])
def test_rows_of_the_transform_are_in_sequency_order(m):
    rows = vectorcodes.walsh(np.eye(m, dtype=np.int64)).T
    assert [int((np.diff(r) != 0).sum()) for r in rows] == list(range(m))
    assert (rows @ rows.T == m * np.eye(m)).all()


def _brute_codes(vectors, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks in Python integers; vectors: (id, components)."""
    kept = [(i, v) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    size = -(-max(len(v) for _, v in kept) // parts) * parts
    fraction = lambda x: x.as_integer_ratio()
    floor = lambda x: fraction(x)[0] * 1024 // fraction(x)[1]
    whole = [(i, [floor(float(x)) for x in v] + [0] * (size - len(v)), v) for i, v in kept]
    width = size // parts
    cut = [(i, [v[k * width : (k + 1) * width] for k in range(parts)]) for i, v, _ in whole]
    first = sorted(range(len(whole)), key=lambda n: (whole[n][0] is None, whole[n][0] or 0, whole[n][2]))[:entries]
    books = [[cut[n][1][k] for n in first] for k in range(parts)]

    def find(part, book):
        distances = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return distances.index(min(distances)), min(distances)

    for _ in range(rounds):
        for k in range(parts):
            members = {}
            for _, p in cut:
                members.setdefault(find(p[k], books[k])[0], []).append(p[k])
            books[k] = [[sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else b for e, b in enumerate(books[k])]
    codes = []
    for i, p in cut:
        found = [find(p[k], books[k]) for k in range(parts)]
        codes.append((i, "".join(f"{e:02x}" for e, _ in found), min(2**63 - 1, sum(d for _, d in found))))
    return codes, books


VECTORS = [
    (3, [0.5, -0.25, 1.0, 2.0, -3.0]), (1, [0.1, 0.2]), (2, []), (4, [0.5, -0.25, 1.0, 2.0, -3.0]), (4, [0.5, -0.25, 1.0, 2.0, -3.0]),
    (None, [1.0, 1.0, 1.0]), (5, None), (6, [1.0, None]), (7, [float("nan")]), (8, [float("-inf"), 1.0]), (9, [-0.0004] * 8),
    *((10 + i, [math.sin(i * k + k) for k in range(8)]) for i in range(40)),
]


@pytest.mark.parametrize("more,entries", [([], 256), ([], 5), ([(100, [1e300, -1e300, 1.0]), (101, [3e38] * 8)], 7)])
def test_codes_equal_brute_force(spark, more, entries):
    rows = VECTORS + more
    df = _clash(spark.createDataFrame([(i, v, i % 3 if i else None) for i, v in rows], "vec_id long, embedding array<double>, label int")).repartition(5)
    books = vectorcodes.train_codebooks(df, entries=entries)
    expected, expected_books = _brute_codes(rows, entries=entries)
    assert [[[int(x) for x in e] for e in b] for b in books.entries] == expected_books
    text = ",".join(str(x) for b in expected_books for e in b for x in e)
    assert books.digest() == hashlib.sha256(text.encode()).hexdigest()
    coded = vectorcodes.with_label_error(vectorcodes.encode_vectors(df, books))
    got = coded.select("vec_id", F.lower(F.hex("code")), "error", "label", "label_error").collect()
    assert Counter(tuple(r)[:3] for r in got) == Counter(expected)
    for r in got:
        assert r["label_error"] == min(2**63 - 1, sum(s["error"] for s in got if s["label"] == r["label"]))


def test_decoded_vectors_are_the_entries(spark):
    df = spark.createDataFrame([(i, v) for i, v in VECTORS if v and None not in v and all(map(math.isfinite, v))], "vec_id long, embedding array<double>")
    books = vectorcodes.train_codebooks(df, entries=300 - 44)
    coded = vectorcodes.encode_vectors(df, books).where("error = 0")
    back = {r["vec_id"]: r["embedding"] for r in vectorcodes.decode_vectors(coded, books).collect()}
    for i, v in VECTORS:
        if i in back:
            assert back[i][: len(v)] == [math.floor(1024 * x) / 1024 for x in v]


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")
    assert vectorcodes.train_codebooks(df) is None
    assert vectorcodes.with_label_error(vectorcodes.encode_vectors(df, None)).collect() == []


# ---- shards -------------------------------------------------------------------------------------


def _shard_rows():
    rng = np.random.default_rng(5)
    rows = [(i, "w" * int(n)) for i, n in enumerate(rng.integers(0, 400, 1500))]
    rows += [(2000 + i, "copy " * 40) for i in range(800)]  # a third of all rows
    rows += [(7, None), (None, "no id"), (None, "no id"), *([(9000, "one row, many times")] * 300), (9001, "é" * 100), (9002, "x" * 5000)]
    return rows


def _laws(rows, shards, expected):
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    mean, largest = sum(sizes.values()) / shards, max((r["size"] for r in rows), default=0)
    assert all(abs(sizes[k] - mean) <= 0.001 * mean + 2 * largest for k in range(shards))
    size = lambda t: len((t or "").encode()) + 16
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert got == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in expected)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_keep_their_law(spark, shards):
    rows = _shard_rows()
    docs = _clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(6)
    dealt = sharding.shard_by_bytes(sharding.document_sizes(docs), shards=shards)
    _laws(dealt.collect(), shards, rows)


def test_identical_rows_alone_are_parted(spark):
    rows = [(1, "same")] * 1000
    dealt = sharding.shard_by_bytes(sharding.document_sizes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), shards=8)
    _laws(dealt.collect(), 8, rows)
    assert dealt.groupBy("shard").count().agg(F.min("count"), F.max("count")).first()[:] == (125, 125)


def test_copies_stay_together_within_the_tolerance(spark):
    rows = [(i, f"text {i % 500}") for i in range(5000)]
    dealt = sharding.shard_by_bytes(sharding.document_sizes(spark.createDataFrame(rows, "doc_id long, text string")), shards=5, tolerance=0.05)
    assert dealt.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, "")], [(i, "a") for i in range(3)]])
def test_few_rows(spark, rows):
    dealt = sharding.shard_by_bytes(sharding.document_sizes(spark.createDataFrame(rows, "doc_id long, text string")))
    _laws(dealt.collect(), 40, rows)


def test_rows_are_exchanged_once_and_natively(spark):
    docs = spark.createDataFrame(_shard_rows(), "doc_id long, text string")
    dealt = sharding.shard_by_bytes(sharding.document_sizes(docs), shards=3)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_written_shards_hold_the_texts(spark, tmp_path):
    rows = _shard_rows()
    stored = sharding.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), f"{tmp_path}/shards", shards=4)
    assert Counter((r["doc_id"], r["text"]) for r in stored.collect()) == Counter(rows)
    _laws(stored.collect(), 4, rows)


def test_shards_of_the_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_histogram_shards"](spark, sf)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r["law"] for r in got.select("law").distinct().collect()} == {"bytes"}
    _laws(got.collect(), 40, rows)


# ---- source audit -------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute_audit(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = [(s, Counter(TERM.findall(t.translate(A_Z)))) for la, s, t in rows if la == lang]
        held = Counter(w for _, c in docs for w in c)
        kept = [w for w, n in held.items() if n >= least]
        counts = {s: Counter() for s, _ in docs}
        for s, c in docs:
            counts[s].update({w: c[w] for w in kept if c[w]})
        every = sum(counts.values(), Counter())

        def shares(c):
            n = sum(c.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // n for w in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            order = lambda x: (-x[0], x[1].encode())
            out += [(lang, s, "pair", i, v, k + 1) for k, (v, i) in enumerate(sorted(pairs, key=order))]
            out += [(lang, s, "term", i, v, k + 1) for k, (v, i) in enumerate(sorted(terms, key=order)[:top])]
    return Counter(out)


def _audit_rows():
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["É", "é", "straße", "ÀB", "日本", "X", "y"]
    text = lambda n: " 1,".join(words[min(int(i), len(words) - 1)] for i in rng.exponential(15, n))
    rows = [(("en", "de", None)[i % 3], f"s{i % 7}" if i % 11 else None, text(int(rng.integers(0, 40)))) for i in range(240)]
    return rows + [("fr", "s0", None), ("fr", "s1", ""), ("fr", None, "42 !"), ("", "s1", "only once"), ("es", "s1", "uno"), rows[0], rows[0]]


@pytest.mark.parametrize("bits", [64, 5, 0])
def test_audit_equals_brute_force(spark, bits):
    rows = _audit_rows()
    docs = _clash(spark.createDataFrame(rows, "lang string, source string, text string")).repartition(4)
    got = divergence.audit_sources(docs, least_docs=4, top=5, digest_bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == _brute_audit(rows, 4, 5)


def test_blocks_of_terms_add_up():
    """One block of all terms and several blocks give the same sums."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    zero = rng.integers(1, 50, 6)
    rows = [(int(s), int(d), int(rng.integers(50, 10**9))) for s in range(6) for d in range(30) if rng.random() < 0.4]

    def sums(first, second, chunks):
        total = Counter()
        for c in range(chunks):
            held = [(s, 1, d, None, p, 40) for s, d, p in rows if d % chunks == c] + [(s, 0, None, None, int(z), 40) for s, z in enumerate(zero)]
            columns = zip(("place", "kind", "digest", "split", "p", "terms"), zip(*held), (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()))
            table = pa.table({n: pa.array(v, t) for n, v, t in columns})
            for r in divergence._block_sums([pa.scalar(x) for x in (1, first, second, c)], table).to_pylist():
                total[r["a"], r["b"]] += r["value"]
        return total

    share = {(s, d): p for s, d, p in rows}
    gap = lambda x, y: (x - y) ** 2 // (x + y)
    expected = {(a, b): sum(gap(share.get((a, d), int(zero[a])), share.get((b, d), int(zero[b]))) for d in range(40)) for a in range(6) for b in range(a + 1, 6)}
    assert sums(0, 0, 1) == sums(0, 0, 4) == expected


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit_sources(docs).collect() == []


def test_filter_lets_all_members_pass(spark):
    members = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 5000)
    bits = divergence.digest_filter(spark.createDataFrame([(int(m),) for m in members], "digest long"))
    assert divergence._in_filter(bits, members).all()
    others = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 5000)
    assert divergence._in_filter(bits, others).mean() < 0.02
