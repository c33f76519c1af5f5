"""Record maintenance as table-to-table jobs: ``apply(base, changes) -> new base``.

Base tables have one row per key. Changes are reduced to one row per key first (map-side cut), so
both sides of every join are unique on the key and no key is hot. Spark picks the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present
from .ranking import keep_first, last_write_wins

IDENTITY_FIELDS = ["name", "dob", "gender", "address"]


def matched(base: DataFrame, keys: DataFrame, key: str, flag: str = "__hit") -> DataFrame:
    """Base rows with a flag telling whether their key is in ``keys``."""
    wanted = keys.select(key).distinct().withColumn(flag, F.lit(True))
    return base.join(wanted, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unmatched(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Change keys that no base row has."""
    return changes.select(key).distinct().join(base.select(key), key, "left_anti")


def insert_if_absent(
    base: DataFrame, new: DataFrame, key: str, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """(base with the accepted rows, rejected rows with a reason).

    Rows of one key that tie in ``order`` are told apart by a hash of the whole row; of rows that are
    equal throughout, one is accepted and the others are rejected.
    """
    numbered = new.withColumn("__blank", ~present(F.col(key).cast("string")))
    fresh = numbered.where(~F.col("__blank")).drop("__blank")
    hashed = fresh.withColumn("__row", F.xxhash64(F.to_json(F.struct(*new.columns))))
    first = keep_first(hashed, [key], [*order, "__row"])
    accepted = first.drop("__row").join(base.select(key), key, "left_anti")
    taken = matched(hashed, base, key)
    repeated = taken.where(~F.col("__hit")).join(first.select(key, F.col("__row").alias("__first")), key)
    is_first = F.col("__row") == F.col("__first")
    copies = (
        repeated.where(is_first).groupBy(key, "__row")
        .agg(F.first(F.struct(*new.columns)).alias("__copy"), F.count(F.lit(1)).alias("__times"))
        .where("__times > 1").select("__copy", F.explode(F.sequence(F.lit(2), F.col("__times"))))
        .select("__copy.*")
    )
    late = repeated.where(~is_first).select(*new.columns).unionByName(copies)
    taken = taken.drop("__row")
    rejects = (
        numbered.where("__blank").drop("__blank").withColumn("reason", F.lit("key required"))
        .unionByName(taken.where("__hit").drop("__hit").withColumn("reason", F.lit("already exists")))
        .unionByName(
            late.withColumn("reason", F.lit("already exists"))
        )
    )
    return base.unionByName(accepted, allowMissingColumns=True), rejects


def fold_patches(changes: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Sequential patches of one key to one: the newest supplied value of every field.

    NULL means "not supplied". Combined before the shuffle.
    """
    moment = F.struct(*order)
    return changes.groupBy(key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), moment)).alias(f) for f in fields]
    )


def update_fields(
    base: DataFrame, changes: DataFrame, key: str, fields: list[str], order: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(base with supplied fields set, keys that matched nothing).

    A key may have several changes: of each field the newest supplied value counts by ``order``, the
    greatest one without it. Base rows never multiply.
    """
    if order:
        patch = fold_patches(changes, key, order, fields)
    else:
        patch = changes.groupBy(key).agg(*[F.max(f).alias(f) for f in fields])
    patch = patch.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = base.join(patch, key, "left")
    out = [
        F.coalesce(f"__{c}", F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns
    ]
    return joined.select(*out), unmatched(base, changes, key)


def set_nested(target: Column, path: str, value: Column) -> Column:
    """A struct column with the dotted ``path`` set."""
    return target.withField(path, value)


def put_document(documents: Column, key: Column, document: Column) -> Column:
    """A documents map with ``key`` set, replacing any earlier entry."""
    kept = F.map_filter(documents, lambda k, _: k != key)
    entry = F.map_from_arrays(F.array(key), F.array(document))
    return F.when(documents.isNull(), entry).otherwise(F.map_concat(kept, entry))


def update_nested(
    base: DataFrame, changes: DataFrame, key: str = "user_id", order: list[str] | None = None
) -> DataFrame:
    """Set ``documents.<doc_key>`` from ``changes(key, doc_key, document)``.

    With ``order`` the newest change of each document counts, without it the greatest. A user's
    changes are folded into one map; a user holds few document types.
    """
    if order:
        changes = last_write_wins(changes, [key, "doc_key"], order)
    else:
        changes = changes.groupBy(key, "doc_key").agg(F.max("document").alias("document"))
    per_user = changes.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("doc_key", "document"))).alias("__new")
    )
    joined = base.join(per_user, key, "left")
    kept = F.map_filter("documents", lambda k, _: ~F.map_contains_key("__new", k))
    merged = F.when(F.col("__new").isNull(), F.col("documents")).otherwise(
        F.when(F.col("documents").isNull(), F.col("__new")).otherwise(F.map_concat(kept, "__new"))
    )
    return joined.withColumn("documents", merged).drop("__new").select(*base.columns)


def profile_struct(prefix: str, base: DataFrame, profile: str = "profile") -> Column:
    """A profile struct in the base's own field order; fields not supplied are NULL."""
    fields = base.schema[profile].dataType.fields
    supplied = {
        "name", "age", "gender", "state", "district", "income", "occupation", "category",
        "special_category",
    }
    return F.struct(
        *[
            (F.col(f"{prefix}.{f.name}") if f.name in supplied else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in fields
        ]
    )


def replace_profile(base: DataFrame, changes: DataFrame, key: str = "user_id") -> DataFrame:
    """U4: overwrite the nested profile as a whole; fields not supplied are dropped (NULL).

    ``changes`` has one row per key with the normalized profile columns.
    """
    rest = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*rest).alias("__new"))
    joined = base.join(new, key, "left")
    replaced = F.when(F.col("__new").isNotNull(), profile_struct("__new", base)).otherwise(
        F.col("profile")
    )
    return joined.withColumn("profile", replaced).select(*base.columns)


def unset_fields(base: DataFrame, keys: DataFrame, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(base with documents, flag and identity fields unset, keys that matched nothing)."""
    rows = matched(base, keys, key)
    hit = F.col("__hit")
    profile = F.col("profile")
    for name in IDENTITY_FIELDS:
        profile = profile.withField(name, F.when(~hit, F.col(f"profile.{name}")))
    out = (
        rows.withColumn("documents", F.when(~hit, F.col("documents")))
        .withColumn("aadhaar_verified", F.when(~hit, F.col("aadhaar_verified")))
        .withColumn("profile", F.when(F.col("profile").isNotNull(), profile))
    )
    return out.select(*base.columns), unmatched(base, keys, key)


def clear_fields(base: DataFrame, keys: DataFrame, key: str = "user_id") -> DataFrame:
    """Blank documents, flag and three identity fields; the address stays."""
    rows = matched(base, keys, key)
    hit = F.col("__hit")
    empty = F.map_from_arrays(F.array(), F.array()).cast(base.schema["documents"].dataType)
    profile_type = base.schema["profile"].dataType
    blank = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in profile_type.fields])
    profile = F.when(F.col("profile").isNull() & hit, blank).otherwise(F.col("profile"))
    cleared = profile
    for name in ("name", "dob", "gender"):
        cleared = cleared.withField(name, F.lit(""))
    out = (
        rows.withColumn("documents", F.when(hit, empty).otherwise(F.col("documents")))
        .withColumn("aadhaar_verified", F.when(hit, False).otherwise(F.col("aadhaar_verified")))
        .withColumn("profile", F.when(hit, cleared).otherwise(F.col("profile")))
    )
    return out.select(*base.columns)


def delete_by_key(base: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(base without the keys, keys that matched nothing)."""
    kept = base.join(keys.select(key).distinct(), key, "left_anti")
    return kept.select(*base.columns), unmatched(base, keys, key)


def confirm_identity(base: DataFrame, confirmed: DataFrame, key: str = "user_id") -> DataFrame:
    """U8: flag, profile fields and the identity document from confirmed data.

    ``confirmed(user_id, data struct<name,dob,gender,address>, ts)``; rows without a key or data
    are skipped; the newest confirmation of a user counts, one without a time only where there is no
    other, and of several of one time that with the largest hash.
    """
    usable = confirmed.where(present(F.col(key).cast("string")) & F.col("data").isNotNull())
    ordered = usable.withColumn("__tie", F.xxhash64(F.to_json("data")))
    newest = last_write_wins(ordered, [key], ["ts", "__tie"]).select(
        key, F.col("data").alias("__data"), F.unix_timestamp("ts").alias("__at"), F.lit(True).alias("__confirmed")
    )
    joined = base.join(newest, key, "left")
    hit = F.col("__confirmed").isNotNull()
    data = F.col("__data")
    document_type = base.schema["documents"].dataType.valueType
    extracted_type = document_type["extracted_data"].dataType
    extracted = F.struct(
        *[
            (data[f.name] if f.name in ("name", "dob", "gender") else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in extracted_type.fields
        ]
    )
    document = F.struct(
        F.lit("Verified").alias("status"),
        extracted.alias("extracted_data"),
        F.lit(100).alias("confidence"),
        F.col("__at").alias("verified_at"),
    ).cast(document_type)
    profile_type = base.schema["profile"].dataType
    blank = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in profile_type.fields])
    profile = F.coalesce(F.col("profile"), blank)
    for name in IDENTITY_FIELDS:
        profile = profile.withField(name, data[name])
    documents = put_document(F.col("documents"), F.lit("aadhaar"), document)
    out = (
        joined.withColumn("aadhaar_verified", F.when(hit, True).otherwise(F.col("aadhaar_verified")))
        .withColumn("profile", F.when(hit, profile).otherwise(F.col("profile")))
        .withColumn("documents", F.when(hit, documents).otherwise(F.col("documents")))
    )
    return out.select(*base.columns)
