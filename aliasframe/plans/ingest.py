"""Statement rows into the store: aliases issued, spellings resolved, everything staged before it is published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import cents
from ..functions.text import display_label, memo_tokens, token_number, variant_key
from ..operators import aliases, projection, resolve
from ..session import checkpoint
from ..sources.store import Store

TABLES = {
    "raw_transactions": "id bigint, account_id string, posted_date string, amount_cents bigint, currency string, raw_payee string, raw_memo string, source_file string, institution string, ttype string, category string",
    "alias_mapping": "alias_token string, entity_type string, real_value string, merged_into string",
    "payee_variant": "variant string, alias_token string, confidence double",
    "payee_journal": "op string, winner string, loser string, note string",
}


def table(store: Store, name: str) -> DataFrame:
    """A table of the store, empty where it was never written."""
    try:
        return store.read(name)
    except FileNotFoundError:
        return store.spark.createDataFrame([], TABLES[name])


def _new_variants(raw: DataFrame, mapping: DataFrame, variants: DataFrame, resolver: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(mapping rows, variant rows) for the spellings not recorded yet; recorded ones keep their token."""
    spelt = raw.where(F.coalesce(F.col("raw_payee"), F.lit("")) != "").select(variant_key(F.col("raw_payee")).alias("variant"), "id").groupBy("variant").agg(F.min("id").alias("seen"))
    fresh = spelt.join(variants.select("variant"), "variant", "left_anti")
    if fresh.isEmpty():
        return mapping.limit(0), variants.limit(0)
    found = resolver(variants.select("variant").union(fresh.select("variant")), "variant").select(F.col("memo").alias("variant"), "tokens", "entity", "confidence")
    owner = found.join(variants.select("variant", "alias_token"), "variant").groupBy("entity").agg(F.min_by("alias_token", token_number(F.col("alias_token"))).alias("alias_token"))
    mine = checkpoint(found.join(fresh, "variant").join(owner, "entity", "left"))
    lone = mine.where(F.col("alias_token").isNull())
    first = lone.groupBy("entity").agg(F.min("seen").alias("seen"), F.min_by("variant", "seen").alias("variant"), F.min_by("tokens", "seen").alias("tokens"))
    label = display_label(F.col("variant"), F.col("tokens"))
    taken = mapping.where(F.col("entity_type") == "PAYEE").select(F.col("real_value").alias("label"), F.lit(1).alias("used"))
    named = first.withColumn("label", label).join(taken, "label", "left").withColumn("label", F.when(F.col("used") == 1, F.concat_ws(" ", "label", F.concat(F.lit("("), "entity", F.lit(")")))).otherwise(F.col("label")))
    named = checkpoint(named.groupBy("label").agg(F.min("seen").alias("seen"), F.collect_list("entity").alias("entities")))
    issued = aliases.issue(named.select(F.lit("PAYEE").alias("entity_type"), F.col("label").alias("real_value"), "seen"), None, aliases.counters(mapping) if not mapping.isEmpty() else None)
    issued = checkpoint(issued)
    token_of = named.select("label", F.explode("entities").alias("entity")).join(issued, F.col("label") == F.col("real_value")).select("entity", F.col("alias_token").alias("new_token"))
    opening = lone.groupBy("entity").agg(F.min_by("variant", "seen").alias("opening"))  # the spelling an entity begins with is certain
    opened = F.col("alias_token").isNull() & (F.col("variant") == F.col("opening"))
    rows = mine.join(token_of, "entity", "left").join(opening, "entity", "left").select("variant", F.coalesce("alias_token", "new_token").alias("alias_token"), F.when(opened, 1.0).otherwise(F.col("confidence")).alias("confidence"))
    return issued.select("alias_token", "entity_type", "real_value", F.lit(None).cast("string").alias("merged_into")), rows


def ingest(store: Store, rows: DataFrame, resolver: Callable[[DataFrame, str], DataFrame] = resolve.resolve) -> DataFrame:
    """Take rows of the ``statement`` source; returns the summary per file. Any ``resolver`` with the columns of :func:`resolve.resolve` can stand in.

    Faulty rows stay out and are counted per file. Values brought again keep their tokens; raw rows are appended as they come.
    Nothing is written before every part is computed, and raw rows come last, so a failure leaves no row without its aliases.
    """
    raw, mapping, variants = (table(store, t) for t in ("raw_transactions", "alias_mapping", "payee_variant"))
    last = raw.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = checkpoint(rows)
    good = rows.where(F.col("reason").isNull())
    new = checkpoint(good.select(
        (F.lit(last + 1) + F.monotonically_increasing_id()).alias("id"), "account_id", F.col("date").alias("posted_date"), cents(F.col("amount")).alias("amount_cents"), F.lit("USD").alias("currency"),
        F.col("description").alias("raw_payee"), F.lit(None).cast("string").alias("raw_memo"), "source_file", "institution", "ttype", "category",
    ))
    values = new.select(F.lit("ACCT").alias("entity_type"), F.col("account_id").alias("real_value"), F.col("id").alias("seen")).unionByName(new.select(F.lit("INST").alias("entity_type"), F.col("institution").alias("real_value"), F.col("id").alias("seen")))
    issued = checkpoint(aliases.issue(values, mapping, aliases.counters(mapping)))
    more_map, more_variants = _new_variants(new, mapping, variants, resolver)
    summary = checkpoint(projection.ingest_summary(new, mapping, variants).join(rows.where(F.col("reason").isNotNull()).groupBy("source_file").agg(F.count("*").alias("faulty")), "source_file", "full").na.fill(0))
    whole_map = checkpoint(mapping.select("alias_token", "entity_type", "real_value", "merged_into").unionByName(issued.select("alias_token", "entity_type", "real_value", F.lit(None).cast("string").alias("merged_into"))).unionByName(more_map.select("alias_token", "entity_type", "real_value", "merged_into")))
    whole_variants = checkpoint(variants.select("variant", "alias_token", "confidence").unionByName(more_variants.select("variant", "alias_token", "confidence")))
    store.write("alias_mapping", whole_map)
    store.write("payee_variant", whole_variants)
    store.append("raw_transactions", new)
    return summary


def payee_matcher(store: Store) -> Callable[[DataFrame], DataFrame]:
    """``mention`` -> ``mention, token, score``: the head token of the payee that a mention means, by the evidence over all recorded spellings; mentions of no one have no row."""
    mapping, variants = table(store, "alias_mapping"), table(store, "payee_variant")
    spelt = variants.select(F.col("variant").alias("memo"), "alias_token").withColumn("tokens", memo_tokens(F.col("memo")))
    at = aliases.heads(mapping)
    known = spelt.join(at, F.col("alias_token") == F.col("token")).select(F.col("head").alias("entity"), "tokens")
    common = resolve.generic_tokens(resolve.documents(variants, "variant"))
    return lambda mentions: resolve.match(mentions, known, common).withColumnRenamed("entity", "token")


def change(store: Store, how, *args) -> None:
    """Apply merge, split or rename to the store's dictionary and journal it."""
    mapping, row = how(table(store, "alias_mapping"), *args)
    journal = checkpoint(table(store, "payee_journal").unionByName(row))
    store.write("alias_mapping", checkpoint(mapping))
    store.write("payee_journal", journal)


def open_store(spark: SparkSession, path: str, key: str | None = None, create: bool = False) -> Store:
    return Store(spark, path, key, create)
