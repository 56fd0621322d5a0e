"""The alias dictionary: durable numbers, redirects, reviews and the journal, as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CLASSES, is_canonical, token_number
from .graph import chain_heads

REVIEW_BELOW = 0.95
JOURNAL = "op string, winner string, loser string, note string"


def issue(values: DataFrame, known: DataFrame | None = None, next_n: DataFrame | None = None, slices: int = 64) -> DataFrame:
    """Tokens for the values not yet known: ``entity_type, real_value, n, alias_token``.

    ``values(entity_type, real_value, seen)``: the least ``seen`` orders new values within their class; null and
    empty values are left out, classes outside the closed set too. ``known(entity_type, real_value)`` is left
    out by an anti-join; ``next_n(entity_type, next_n)`` is the durable counter, 1 where missing, so a number once
    used never returns. Numbering is a prefix sum over ``slices`` ranges of each class, so that a class with
    most of all values is not one task's work.
    """
    new = values.where(F.col("entity_type").isin(*CLASSES) & (F.coalesce(F.col("real_value"), F.lit("")) != "")).groupBy("entity_type", "real_value").agg(F.min("seen").alias("seen"))
    if known is not None:
        new = new.join(known.select("entity_type", "real_value"), ["entity_type", "real_value"], "left_anti")
    cuts = new.groupBy("entity_type").agg(F.percentile_approx("seen", [i / slices for i in range(1, slices)], 1000).alias("cuts"))
    placed = new.join(cuts, "entity_type").withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("seen")))).drop("cuts")
    sizes = placed.groupBy("entity_type", "slice").agg(F.count("*").alias("size"))
    before = sizes.select("entity_type", "slice", F.coalesce(F.sum("size").over(Window.partitionBy("entity_type").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("entity_type", "slice").orderBy("seen", "real_value"))
    numbered = placed.withColumn("rank", rank).join(before, ["entity_type", "slice"])
    start = F.lit(1)
    if next_n is not None:
        numbered = numbered.join(next_n.select("entity_type", "next_n"), "entity_type", "left")
        start = F.coalesce(F.col("next_n"), F.lit(1))
    n = (start - 1 + F.col("before") + F.col("rank")).cast("bigint")
    return numbered.select("entity_type", "real_value", n.alias("n"), F.concat_ws("-", "entity_type", n.cast("string")).alias("alias_token"))


def counters(mapping: DataFrame) -> DataFrame:
    """entity_type, next_n: one above the highest number issued."""
    return mapping.groupBy("entity_type").agg((F.max(token_number(F.col("alias_token"))) + 1).alias("next_n"))


def put(mapping: DataFrame, rows: DataFrame) -> DataFrame:
    """The mapping with ``rows(alias_token, entity_type, real_value)`` put in: a token that is there gets the new value and keeps its redirect.

    Tokens that are no canonical tokens of their class, and null or empty values, are left out. Of several rows with one token the greatest value is kept.
    """
    good = rows.where(is_canonical(F.col("alias_token")) & (F.substring_index("alias_token", "-", 1) == F.col("entity_type")) & (F.coalesce("real_value", F.lit("")) != ""))
    new = good.groupBy("alias_token", "entity_type").agg(F.max("real_value").alias("__new"))
    both = mapping.join(new, ["alias_token", "entity_type"], "full")
    return both.withColumn("real_value", F.coalesce("__new", "real_value")).select(*mapping.columns)


def heads(mapping: DataFrame) -> DataFrame:
    """token, head of every token of the mapping; only redirected ones go through the chain."""
    moved = mapping.where(F.col("merged_into").isNotNull())
    ends = chain_heads(moved.select(F.col("alias_token").alias("token"), "merged_into"))
    return mapping.select(F.col("alias_token").alias("token")).join(ends, "token", "left").select("token", F.coalesce("head", "token").alias("head"))


def resolve_values(mapping: DataFrame, cls: str) -> DataFrame:
    """real_value, token of a class, one per value (the lowest number)."""
    return mapping.where(F.col("entity_type") == cls).groupBy("real_value").agg(F.min_by("alias_token", token_number(F.col("alias_token"))).alias("token"))


def review(mapping: DataFrame, variants: DataFrame) -> DataFrame:
    """Per canonical payee: label, number of variants, weakest confidence (1.0 without variants), low flag."""
    payees = mapping.where(F.col("entity_type") == "PAYEE")
    at = heads(payees)
    counted = variants.join(at, F.col("alias_token") == F.col("token")).groupBy("head").agg(F.count("*").alias("variant_count"), F.min("confidence").alias("weakest"))
    kept = payees.where(F.col("merged_into").isNull()).select(F.col("alias_token").alias("head"), F.col("real_value").alias("label"))
    out = kept.join(counted, "head", "left").select("head", "label", F.coalesce("variant_count", F.lit(0)).alias("variant_count"), F.coalesce("weakest", F.lit(1.0)).alias("confidence"))
    return out.withColumn("low_confidence", F.col("confidence") < REVIEW_BELOW)


def flagged(mapping: DataFrame, variants: DataFrame) -> DataFrame:
    return review(mapping, variants).where("low_confidence").select("head", "confidence").orderBy(token_number(F.col("head")))


def _journal(spark, op: str, winner: str, loser: str | None, note: str | None) -> DataFrame:
    return spark.createDataFrame([(op, winner, loser, note)], JOURNAL)


def merge(mapping: DataFrame, winner: str, loser: str) -> tuple[DataFrame, DataFrame]:
    """(mapping, journal row) after redirecting the loser token to the winner's head; the same head twice is refused."""
    at = {r["token"]: r["head"] for r in heads(mapping).where(F.col("token").isin(winner, loser)).collect()}
    if set(at) != {winner, loser}:
        raise ValueError("unknown token")
    if at[winner] == at[loser]:
        raise ValueError("both tokens already mean the same payee")
    done = mapping.withColumn("merged_into", F.when(F.col("alias_token") == loser, at[winner]).otherwise(F.col("merged_into")))
    return done, _journal(mapping.sparkSession, "merge", at[winner], loser, None)


def split(mapping: DataFrame, token: str) -> tuple[DataFrame, DataFrame]:
    """(mapping, journal row) after taking a redirect back; a token that isn't merged is refused."""
    row = mapping.where(F.col("alias_token") == token).select("merged_into").first()
    if row is None or row[0] is None:
        raise ValueError("the token is not merged")
    done = mapping.withColumn("merged_into", F.when(F.col("alias_token") != token, F.col("merged_into")))
    return done, _journal(mapping.sparkSession, "split", row[0], token, None)


def rename(mapping: DataFrame, token: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(mapping, journal row) with a new label; empty labels, unknown tokens and labels taken in the class are refused."""
    label = " ".join(label.split())
    row = mapping.where(F.col("alias_token") == token).select("entity_type").first()
    if not label or row is None:
        raise ValueError("unknown token or empty label")
    if not mapping.where((F.col("entity_type") == row[0]) & (F.col("real_value") == label) & (F.col("alias_token") != token)).isEmpty():
        raise ValueError("the label is taken")
    done = mapping.withColumn("real_value", F.when(F.col("alias_token") == token, label).otherwise(F.col("real_value")))
    return done, _journal(mapping.sparkSession, "rename", token, None, label)


def split_variant(mapping: DataFrame, variants: DataFrame, variant: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapping, variants, journal row): one variant moves to a token of its own with a new number and a free label."""
    row = variants.where(F.col("variant") == variant).select("alias_token").first()
    if row is None:
        raise ValueError("unknown variant")
    n = mapping.where(F.col("entity_type") == "PAYEE").agg(F.max(token_number(F.col("alias_token")))).first()[0] or 0
    token, k, label = f"PAYEE-{n + 1}", 1, variant.title()
    while not mapping.where((F.col("entity_type") == "PAYEE") & (F.col("real_value") == label)).isEmpty():
        k += 1
        label = f"{variant.title()} ({k})"
    extra = mapping.sparkSession.createDataFrame([(token, "PAYEE", label)], "alias_token string, entity_type string, real_value string")
    moved = variants.withColumn("alias_token", F.when(F.col("variant") == variant, token).otherwise(F.col("alias_token")))
    return mapping.unionByName(extra, allowMissingColumns=True), moved, _journal(mapping.sparkSession, "split_variant", token, row[0], variant)


def upsert_variants(variants: DataFrame, new: DataFrame) -> DataFrame:
    """Variants with those added whose spelling is new; of a spelling brought twice the first token stays."""
    fresh = new.join(variants.select("variant"), "variant", "left_anti").groupBy("variant").agg(F.min(F.struct("alias_token", "confidence")).alias("v"))
    return variants.unionByName(fresh.select("variant", "v.alias_token", "v.confidence"), allowMissingColumns=True)
