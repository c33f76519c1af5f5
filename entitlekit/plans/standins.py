"""Domain tables derived by Spark from the driver's generic tables (whole tables, no sampling).

* profiles: every customer with its nation.
* schemes: one scheme per (brand, type) of ``part``, its rules aggregated over all its parts, so
  the catalog stays a catalog while the work grows with ``part``.
* directory: one scheme per part, for the linear catalog operators.
* faqs: every ``benchmark`` text. Named schemes: every distinct sentence of ``benchmark``.
* queries: every user turn of ``conversations``; every document for long texts.
* users, changes: ``events``. Bundles and dictionaries: ``documents`` and ``benchmark``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import DOCUMENT, EXTRACTED, PROFILE, RULES

LANGS = ["hi", "ta"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table read by at least as many tasks as there are cores.

    A small file is one task however costly its rows are; such a table is spread by key. A table
    with enough splits of its own is not moved.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def pick(number: Column, size: int, options: dict[int, Column], default: Column) -> Column:
    case = F.when(F.lit(False), default)
    for rest, value in options.items():
        case = case.when(number % size == rest, value)
    return case.otherwise(default)


def strings(*items: str) -> Column:
    return F.array(*[F.lit(i) for i in items])


def profile_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms_of(spread_table(spark, sf_dir, "customer", "c_custkey"), table(spark, sf_dir, "nation"))


def forms_of(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Raw form rows, every value a string. ``nation`` has 25 rows at every scale factor."""
    nation = F.broadcast(nation)
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    key = F.col("c_custkey")
    segment = F.col("c_mktsegment")
    return joined.select(
        key.alias("profile_id"),
        F.col("c_name").alias("name"),
        (key % 90).cast("string").alias("age"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 50).cast("string").alias("income"),
        F.when(segment == "AUTOMOBILE", "General").when(segment == "BUILDING", "OBC")
        .when(segment == "FURNITURE", "SC").when(segment == "HOUSEHOLD", "ST")
        .otherwise("").alias("category"),
        pick(key, 3, {0: F.lit("Male"), 1: F.lit("Female")}, F.lit("Other")).alias("gender"),
        pick(key, 4, {0: F.lit("farmer"), 1: F.lit("student")}, F.lit("none")).alias("special_category"),
        F.col("n_name").alias("state"),
    )


def _rules(n: Column, low: Column, income: Column) -> Column:
    return F.struct(
        F.when(n % 7 != 0, low).cast("bigint").alias("min_age"),
        F.when(n % 11 != 0, low + 30).cast("bigint").alias("max_age"),
        F.when(n % 13 != 0, income).cast("bigint").alias("max_income"),
        pick(n, 3, {0: strings("all"), 1: strings("sc", "st")}, strings("general", "obc"))
        .alias("allowed_categories"),
        pick(n, 4, {0: strings("female")}, strings("all")).alias("gender"),
        pick(n, 6, {0: strings("farmer")}, strings("all")).alias("special_category"),
        F.lit(None).cast("array<string>").alias("occupation"),
        F.lit(None).cast("array<string>").alias("state"),
    ).cast(RULES)


def _state(n: Column) -> Column:
    named = F.concat(F.lit("NATION_"), (n % 25).cast("string"))
    return pick(
        n, 5, {0: F.lit("All India"), 1: F.lit("All India"), 2: named, 3: named}, F.lit(None)
    )


def schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scheme per (brand, type): 150 at every scale factor."""
    grouped = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(
        F.sum("p_size").alias("n"), F.max("p_retailprice").alias("price"),
        F.count(F.lit(1)).alias("parts"),
    )
    n = F.col("n")
    brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("bigint")
    name = F.concat_ws(" ", "p_brand", F.lower("p_type"), F.lit("scheme"))
    return grouped.select(
        F.concat_ws("/", "p_brand", "p_type").alias("scheme_id"),
        (brand * 10 + F.length("p_type")).alias("pos"),
        name.alias("name"),
        F.concat(F.lit("Covers "), F.col("parts").cast("string"), F.lit(" parts. For "),
                 F.lower("p_type"), F.lit(" makers.")).alias("description"),
        F.concat(F.lit("https://example.org/"), F.col("p_type")).alias("official_website"),
        F.lower("p_type").alias("target_beneficiaries"),
        F.lit(None).cast("string").alias("application_process"),
        F.concat(F.lit("Up to "), n.cast("string")).alias("benefits"),
        F.lit("1. Visit the office. 2. Apply.").alias("steps"),
        _state(n).alias("state"),
        _rules(n, n % 40, F.floor(F.col("price")) * (n % 90 + 10) * 5).alias("rules"),
    )


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scheme per part."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    rules = _rules(key, F.col("p_size"), F.floor(F.col("p_retailprice") * 200))
    rule_state = F.when(key % 9 == 0, F.array(F.concat(F.lit("NATION_"), (key % 25).cast("string"))))
    return part.select(
        key.cast("string").alias("scheme_id"),
        key.alias("pos"),
        F.col("p_name").alias("name"),
        F.concat_ws(" ", F.lit("Help for"), F.lower("p_type"), F.lit("makers of"), "p_brand",
                    F.lit("goods and for the trades that use them every day")).alias("description"),
        F.concat(F.lit("https://example.org/"), key.cast("string")).alias("official_website"),
        F.lower("p_type").alias("target_beneficiaries"),
        pick(key, 2, {0: F.lit("Apply at the office.")}, F.lit(None)).alias("application_process"),
        F.concat(F.lit("Up to "), F.col("p_size").cast("string")).alias("benefits"),
        F.concat(F.lit("1. Visit "), F.col("p_brand"), F.lit(". 2. Ask for "), F.col("p_name"),
                 F.lit(".\n3. Apply.")).alias("steps"),
        _state(key).alias("state"),
        rules.withField("state", rule_state).alias("rules"),
    )


def faqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("pos"),
        F.col("text").alias("question"),
        F.concat(F.lit("Answer "), item.cast("string")).alias("answer"),
        F.concat(F.lit("c"), (item % 7).cast("string")).alias("category"),
        F.when(item % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("s"), (item % 11).cast("string"))
        ).alias("scheme"),
    )


def messy_faqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The FAQs behind as many rows that are repeats, blank, menu labels, or without a question."""
    clean = faqs(spark, sf_dir)
    pos = F.col("pos")
    question = pick(
        pos, 4, {0: F.col("question"), 1: F.lit(""), 2: pick(pos, 8, {2: F.lit("Main Menu")}, F.lit("List All Schemes"))}, F.lit(None)
    )
    return clean.withColumns({"question": question, "pos": pos - 1000000}).unionByName(clean)


def stage_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of every kind: user turns, names of schemes, topic words, and commands (one for each supplier)."""
    phrases = [
        "", "Main Menu please", "Hello!", "thanks a lot", "What is your name?", "show schemes now", "my state", "zzz",
    ]
    key, item = F.col("s_suppkey"), F.col("item_id")
    word = F.regexp_extract(F.lower("text"), r"[^\s.,]{9,}", 0)
    parts = [
        turns(spark, sf_dir).select("query_id", "query"),
        name_queries(spark, sf_dir).select((-10 * F.col("query_id") - 1).alias("query_id"), "query"),
        table(spark, sf_dir, "benchmark").select((-10 * item - 2).alias("query_id"), word.alias("query")),
        table(spark, sf_dir, "supplier").select(
            (-10 * key - 3).alias("query_id"),
            pick(key, len(phrases), {i: F.lit(p) for i, p in enumerate(phrases)}, F.lit("")).alias("query"),
        ),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.withColumn("lang", F.lit("en"))


def _sentences(text: Column) -> Column:
    return F.filter(
        F.transform(F.split(text, r"[.\n]"), strip), lambda s: F.length(s) > 0
    )


def named_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog named by the distinct sentences of ``benchmark``, in text order."""
    sentences = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(_sentences(F.col("text"))).alias("at", "name")
    )
    first = sentences.groupBy("name").agg(
        F.min(F.col("item_id") * 1000 + F.col("at")).alias("pos")
    )
    pos = F.col("pos")
    return first.select(
        pos.cast("string").alias("scheme_id"),
        pos.cast("bigint").alias("pos"),
        "name",
        F.concat(F.lit("About "), F.col("name")).alias("description"),
        F.concat(F.lit("https://example.org/"), pos.cast("string")).alias("official_website"),
        F.concat(F.lit("c"), (pos % 7).cast("string")).alias("target_beneficiaries"),
        pick(pos, 2, {0: F.lit("Apply at the office.")}, F.lit(None)).alias("application_process"),
        F.when(pos % 3 != 0, F.concat(F.lit("Benefit "), pos.cast("string"))).alias("benefits"),
        F.lit("1. Visit. 2. Apply.").alias("steps"),
        _state(pos).alias("state"),
        _rules(pos, pos % 40, pos * 5).alias("rules"),
    )


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long words of ``benchmark`` as topic words; the topic follows the word's length."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.split(F.lower("text"), r"[\s.,]+")).alias("word")
    ).where(F.length("word") > 8).distinct()
    return words.select(
        "word", F.concat(F.lit("c"), (F.length("word") % 9).cast("string")).alias("label")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_table(spark, sf_dir, "conversations", "conv_id").where(F.col("role") == "user")
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("text").alias("query"),
        F.lit(None).cast("string").alias("lang"),
    )


def long_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("query_id"), F.col("text").alias("query"),
        F.lit(None).cast("string").alias("lang"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text to localize, into one of two languages."""
    return spread_table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("text_id"),
        pick(F.col("doc_id"), 2, {0: F.lit(LANGS[0])}, F.lit(LANGS[1])).alias("lang"),
        "text",
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of ``benchmark``: as split from the texts, marked as their translation.

    Every second sentence is stored in lower case, so it is found only when case is ignored.
    """
    parts = F.filter(
        F.transform(F.split("text", r"\n|\. "), strip), lambda s: F.length(s) > 0
    )
    sentences = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(parts).alias("at", "source")
    )
    ord_ = F.col("item_id") * 1000 + F.col("at")
    stored = F.when(F.col("at") % 2 == 1, F.lower("source")).otherwise(F.col("source"))
    langs = F.explode(strings(*LANGS)).alias("lang")
    return sentences.select(
        F.lit("from_en").alias("direction"), langs, stored.alias("source"),
        F.concat(F.lit("~ "), F.col("source")).alias("target"), ord_.cast("bigint").alias("ord"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed values and the stored documents they are checked against, one row per customer."""
    key = F.col("c_custkey")
    name = F.col("c_name")
    income = F.floor("c_acctbal").cast("bigint")
    dob = F.concat(F.lit("19"), F.lpad((key % 90 + 10).cast("string"), 2, "0"), F.lit("-05-1"),
                   (key % 10).cast("string"))
    dmy = F.concat(F.lit("1"), (key % 10).cast("string"), F.lit("/05/19"),
                   F.lpad((key % 90 + 10).cast("string"), 2, "0"))
    card_name = pick(
        key, 4, {0: name, 1: F.upper(name), 2: F.left(name, F.lit(8))}, F.lit("Someone Else")
    )
    claimed_income = pick(
        key, 5, {0: income, 1: F.floor(income * 1.1), 2: F.floor(income * 1.2)}, income
    ).cast("bigint")
    return spread_table(spark, sf_dir, "customer", "c_custkey").select(
        key.alias("user_id"), name.alias("name"), dob.alias("dob"),
        F.when(key % 6 != 0, claimed_income.cast("string")).alias("income"),
        F.lower("c_mktsegment").alias("category"),
        card_name.alias("card_name"),
        F.when(key % 8 == 0, F.lit("2001-01-01")).otherwise(dmy).alias("card_dob"),
        F.when(key % 7 == 0, F.lit("")).when(key % 7 != 1, income.cast("string")).alias("card_income"),
        F.when(key % 3 != 0, F.col("c_mktsegment")).alias("card_category"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity payloads of every customer: tag form, attribute form, plain text, broken XML."""
    key = F.col("c_custkey")
    gender = pick(key, 2, {0: F.lit("M")}, F.lit("F"))
    dob = F.concat(F.lit("0"), (key % 9 + 1).cast("string"), F.lit("/02/1990"))
    name = F.when(key % 10 == 9, F.lit("Rt")).otherwise(F.col("c_name"))
    city = F.concat(F.lit("CITY "), F.col("c_nationkey").cast("string"))
    tag = F.concat(
        F.lit("<PrintLetterBarcodeData><name>"), name, F.lit("</name><dob>"), dob,
        F.lit("</dob><gender>"), gender, F.lit("</gender><vtc>"), city,
        F.lit("</vtc><state>"), F.col("c_mktsegment"), F.lit("</state></PrintLetterBarcodeData>"),
    )
    attribute = F.concat(
        F.lit('<PrintLetterBarcodeData name="'), name, F.lit('" dob="'), dob, F.lit('" gender="'),
        gender, F.lit('" vtc="'), city, F.lit('" state="'), F.col("c_mktsegment"), F.lit('"/>'),
    )
    plain = F.concat(
        F.lit("Name: "), F.replace(name, F.lit("#"), F.lit(" ")), F.lit("\nDOB: "), dob,
        F.lit("\nGender: "), F.when(gender == "M", "Male").otherwise("Female"),
    )
    broken = F.concat(F.lit("<PrintLetterBarcodeData><name>"), name, F.lit("</name><dob>"), dob)
    return spread_table(spark, sf_dir, "customer", "c_custkey").select(
        key.alias("doc_id"),
        pick(key, 4, {0: tag, 1: attribute, 2: plain}, broken).alias("payload"),
    )


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id"), "ts", "event_id", "event_type", "value"
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per customer, with a stored profile and up to three documents."""
    key = F.col("c_custkey")
    extracted = {f.name: F.lit(None).cast(f.dataType) for f in EXTRACTED.fields}

    def document(**fields: Column) -> Column:
        values = {**extracted, **fields}
        return F.struct(
            F.lit("Verified").alias("status"),
            F.struct(*[v.alias(k) for k, v in values.items()]).alias("extracted_data"),
            (key % 101).cast("int").alias("confidence"),
            key.alias("verified_at"),
        ).cast(DOCUMENT)

    card_name = pick(
        key, 10, {3: F.lit("GOVERNMENT"), 4: F.lit("Anna Sanath"), 5: F.lit("")}, F.col("c_name")
    )
    documents = F.map_from_arrays(
        strings("aadhaar", "income", "caste"),
        F.array(
            document(name=card_name, dob=F.lit("1990-01-01")),
            document(name=F.lit(""), income=F.floor("c_acctbal").cast("string")),
            document(name=F.lit(""), category=F.col("c_mktsegment")),
        ),
    )
    profile = {f.name: F.lit(None).cast(f.dataType) for f in PROFILE.fields}
    profile |= {
        "name": F.col("c_name"), "age": key % 90, "gender": F.lit("male"),
        "state": F.lit("nowhere"), "income": F.floor("c_acctbal").cast("bigint"),
        "dob": F.lit("1990-01-01"), "address": F.lit("1 Road"),
    }
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.col("c_name").alias("name"),
        F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("@"))).alias("email"),
        F.lit("user").alias("role"),
        (key % 2 == 0).alias("aadhaar_verified"),
        F.struct(*[v.alias(k) for k, v in profile.items()]).cast(PROFILE).alias("profile"),
        documents.alias("documents"),
    )


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, key, text): the least text of each language and source of ``documents``."""
    return table(spark, sf_dir, "documents").groupBy("lang", F.col("source").alias("key")).agg(
        F.min("text").alias("text")
    )


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts of every customer, of four kinds, with what the customer claims."""
    key = F.col("c_custkey")
    name = F.concat(
        F.lit("Asha "), F.translate("c_mktsegment", "AEIOU", "aeiou"), F.lit(" "),
        F.translate(F.right(key.cast("string"), F.lit(2)), "0123456789", "BaDeFiGoHu"),
    )
    date = F.concat(F.lit("1"), (key % 10).cast("string"), F.lit("/05/19"),
                    F.lpad((key % 90 + 10).cast("string"), 2, "0"))
    amount = F.format_string("%,d", F.floor(F.abs("c_acctbal") * 100).cast("bigint"))
    identity = F.concat(
        F.lit("GOVERNMENT OF INDIA\n  "), name, F.lit("\nDOB: "), date,
        F.lit("\n"), pick(key, 8, {0: F.lit("MALE")}, F.lit("FEMALE")), F.lit("\nPost Office Road 12345"),
    )
    income = F.concat(
        F.lit("INCOME CERTIFICATE\nTotal 12\nAnnual Income: Rs. "), amount, F.lit(" only"),
    )
    caste = F.concat(F.lit("Certificate of class\n"), pick(
        key, 12, {2: F.lit("OBC member"), 6: F.lit("SCHEDULED TRIBE")}, F.lit("CASTE GENERAL")))
    other = F.concat(F.col("c_name"), F.lit("\nno known kind "), date)
    return spread_table(spark, sf_dir, "customer", "c_custkey").select(
        key.alias("doc_id"),
        pick(key, 4, {0: identity, 1: income, 2: caste}, other).alias("text"),
        pick(key, 5, {0: F.lit("Asha"), 1: F.lit("Nobody Here")}, name).alias("claimed_name"),
        pick(key, 7, {0: F.lit("")}, F.concat(
            F.lit("19"), F.lpad((key % 90 + 10).cast("string"), 2, "0"), F.lit("-05-1"),
            (key % 10).cast("string"))).alias("claimed_dob"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity scans: the payload of every customer, and a text with the name near a date."""
    key = F.col("c_custkey")
    given = F.concat(F.lit("rakesh "), F.lower("c_mktsegment"))
    date = F.concat(F.lit("199"), (key % 10).cast("string"), F.lit("-03-1"), (key % 10).cast("string"))
    on_line = F.concat(F.lit("GOVT OF STATE\n"), given, F.lit(" "), date, F.lit("\nMALE"))
    before = F.concat(F.lit("Mera Pehchaan\n"), given, F.lit("\n!\nDOB "), date, F.lit("\nFEMALE 12"))
    nowhere = F.concat(F.lit("Zoom\nab\n"), given, F.lit(" mohan\nMALE here"))
    text = pick(key, 3, {0: on_line, 1: before}, nowhere)
    return payloads(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 1, F.col("payload")).otherwise(F.lit("")).alias("payload"),
    ).join(table(spark, sf_dir, "customer").select(key.alias("doc_id"), text.alias("text")), "doc_id")


def tag_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes named by the FAQ tags, in the other case: one per size class of ``part``."""
    number = (F.col("p_size") % 11).cast("string")
    return table(spark, sf_dir, "part").groupBy(F.concat(F.lit("S"), number).alias("name")).agg(
        F.min("p_partkey").alias("pos")
    ).select(F.col("name").alias("scheme_id"), "pos", "name")


def name_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that name a scheme: in lower case, as a question, or inside a phrase."""
    pos = F.col("pos")
    query = pick(
        pos, 3, {0: F.lower("name"), 1: F.concat(F.lit(" "), F.col("name"), F.lit("?"))},
        F.concat(F.lit("About "), F.col("name")),
    )
    return named_schemes(spark, sf_dir).select(
        pos.alias("query_id"), query.alias("query"), F.lit("en").alias("lang")
    )


def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("phrase"),
        F.lit("hi").alias("lang"),
        F.concat(F.lit("ब्रांड "), F.col("n_nationkey").cast("string")).alias("target"),
    )


def profile_changes_of(events: DataFrame) -> DataFrame:
    """A profile change per event, one moment per user and row."""
    value, none = F.col("value"), F.lit(None).cast("string")
    return events.select(
        "user_id", "ts", F.col("event_id").cast("string").alias("name"),
        F.floor(value).cast("bigint").alias("age"), F.col("event_type").alias("gender"),
        F.lit("here").alias("state"), none.alias("district"),
        F.floor(value * 10).cast("bigint").alias("income"), F.lit("").alias("occupation"),
        F.lit("sc").alias("category"), F.lit("none").alias("special_category"),
    )
