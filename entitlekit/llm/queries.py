"""The registered queries of this subpackage; DuckDB equivalents are in ``oracle.py``."""

from __future__ import annotations

from pyspark.sql import functions as F

from entitlekit.llm import decontamination, divergence, htmltext, licenses, minhash, packing, quality, recompression, secrets, sharding, suffixes, toxicity, vectorcodes
from entitlekit.llm.common import checkpoint, read

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op4_recompression_dedup(spark, sf):
    """Every word covered by a 20-word window that starts earlier in the corpus is cut."""
    cut = recompression.cut_repeated_windows(read(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op6_suffix_dedup(spark, sf):
    """Every byte covered by a 50-byte string that starts in a document of a smaller id is cut."""
    cut = suffixes.cut_repeated_strings(read(spark, sf, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op10_decontamination(spark, sf):
    """Words of every document inside a passage of the benchmark."""
    found = decontamination.find_passages(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return decontamination.contamination(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@query
def op7_minhash_near_dedup(spark, sf):
    """The class of near-duplicates of every document."""
    return minhash.near_classes(read(spark, sf, "documents"))


@query
def op1_packing(spark, sf):
    """All documents as pieces of packed sequences."""
    pieces = packing.pack(read(spark, sf, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_quality_rules(spark, sf):
    """Base counts of every document, and whether the weighed rules keep it."""
    judged = quality.judge_quality(read(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op8_secret_scan(spark, sf):
    """Secrets of every document: counts and digests of those in the text, and the places of all."""
    found = secrets.scan_secrets(read(spark, sf, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in secrets.KINDS), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query
def op9_license_scan(spark, sf):
    """Licence notices and texts in every document."""
    return licenses.licenses_of(read(spark, sf, "documents"), licenses.templates_table(spark))


@query
def op3_toxicity(spark, sf):
    """A toxicity score for every document, learnt from the labels that aren't held out."""
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op5_html_extraction(spark, sf):
    """The main text of every page."""
    found = htmltext.extract_text(read(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_vector_codes(spark, sf):
    """The code of every vector, and the error that each label's codes add up to."""
    vectors = read(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    books = vectorcodes.train_codebooks(vectors)
    coded = vectorcodes.with_label_error(checkpoint(vectorcodes.encode_vectors(vectors, books)))
    digest = F.lit(books.digest() if books else None).cast("string")
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


@query
def op12_histogram_shards(spark, sf):
    """The shard of every document and its slot there, by the law of near equal bytes."""
    dealt = sharding.shard_by_bytes(sharding.document_sizes(read(spark, sf, "documents")))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op13_source_divergence(spark, sf):
    """How far the sources of each language are apart, and the terms that each uses more than its language."""
    return divergence.audit_sources(read(spark, sf, "documents"))
