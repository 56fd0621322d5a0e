"""Zones of timestamps that state none, and their conversion to UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import with_instant
from ..session import broadcast_checked


#: Zones that can stand to choice; the public database has some 600.
MOST_ZONES = 1000


def account_prefix(account: Column) -> Column:
    """Letters before the first dash of an account id; null where there is no dash."""
    return F.when(F.instr(account, "-") > 1, F.substring_index(account, "-", 1))


def with_declared_zone(rows: DataFrame, institutions: DataFrame, account: str, institution: str | None, out: str = "zone") -> DataFrame:
    """Add the zone declared for the account's institution, by account prefix, else by name; null if unknown."""
    known = institutions.where(F.col("time_zone").isNotNull())
    by_prefix = known.where(F.col("account_prefix").isNotNull()).groupBy(F.col("account_prefix").alias("__prefix")).agg(F.min("time_zone").alias("__z1"))
    got = rows.withColumn("__prefix", account_prefix(F.col(account))).join(broadcast_checked(by_prefix), "__prefix", "left")
    second = F.lit(None).cast("string")
    if institution is not None:
        by_name = known.where(F.col("institution").isNotNull()).groupBy(F.col("institution").alias("__name")).agg(F.min("time_zone").alias("__z2"))
        got = got.join(broadcast_checked(by_name), F.col(institution) == F.col("__name"), "left")
        second = F.col("__z2")
    return got.withColumn(out, F.coalesce(F.col("__z1"), second)).drop("__prefix", "__name", "__z1", "__z2")


def estimate_zones(rows: DataFrame, source: str, value: str, ingested: str, zones: DataFrame, most_lag_days: int = 45) -> DataFrame:
    """(source, zone): for each source the offset history that violates the order of events least.

    Every zone of ``zones(zone)`` is a candidate history of offsets, daylight saving included. Under a
    candidate a clock reading is a violation if its instant lies after the row's ingestion. Violations are counted
    per source and candidate before the shuffle; ties go to the candidate whose readings come
    closest to their ingestion, then to the alphabetically first. Only readings that state no zone count; those
    ingested over ``most_lag_days`` later say nothing about closeness. Sources without such a reading have no row.
    """
    read = rows.select(F.col(source).alias("__source"), F.col(value).alias("__value"), F.col(ingested).alias("__ingested"))
    names = sorted(r[0] for r in zones.where(F.col("zone").isNotNull()).select("zone").distinct().limit(MOST_ZONES + 1).collect())
    if len(names) > MOST_ZONES:
        raise ValueError("more zones than there are in the world")
    tried = read.where(F.col("__source").isNotNull() & F.col("__ingested").isNotNull()).withColumn("__zone", F.explode(F.array(*[F.lit(z) for z in names]) if names else F.array().cast("array<string>")))
    at = with_instant(tried, "__value", F.col("__zone"), "__v_").where(F.col("__v_needs_zone"))
    lag = (F.unix_micros("__ingested") - F.unix_micros("__v_instant")) / 1e6
    close = (lag >= 0) & (lag <= most_lag_days * 86_400)
    cost = at.groupBy("__source", "__zone").agg(F.sum(F.when(lag < 0, 1).otherwise(0)).alias("__bad"), F.coalesce(F.sum(F.when(close, F.floor(lag))), F.lit(0)).alias("__lag"))
    best = cost.groupBy("__source").agg(F.min(F.struct("__bad", "__lag", "__zone")).alias("__best"))
    return best.select(F.col("__source").alias(source), F.col("__best.__zone").alias("zone"), F.col("__best.__bad").alias("violations"))


def to_utc(rows: DataFrame, value: str, account: str, institution: str | None, ingested: str, institutions: DataFrame, prefix: str = "", sources: DataFrame | None = None) -> DataFrame:
    """Normalise a column of written timestamps (:func:`with_instant`) in the zone of the row's institution.

    The declared zone is the history of a source; where none is declared, the history of the source
    (institution name, else account prefix, else account) is estimated from its own rows. Rows whose
    source gives no reading either count as UTC. Extra columns are kept; one named like an added column gives way to it. ``sources``
    holds the account and institution of all rows where that is a smaller table; the estimate is planned
    only if some source there lacks a declared zone.
    """
    kept = rows.columns
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(kept)]).alias("__row"), F.col(value).alias("__value"), F.col(account).alias("__account"), (F.col(institution) if institution else F.lit(None).cast("string")).alias("__institution"), F.col(ingested).alias("__ingested"))
    zoned = with_declared_zone(packed, institutions, "__account", "__institution", "__zone")
    given = with_declared_zone(sources if sources is not None else rows, institutions, account, institution, "__zone")
    if given.where(F.col("__zone").isNull()).isEmpty():
        return _converted(zoned, kept, prefix)
    known = zoned.where(F.col("__zone").isNotNull())
    open_ = zoned.where(F.col("__zone").isNull()).drop("__zone").withColumn("__source", F.coalesce("__institution", account_prefix(F.col("__account")), "__account"))
    zones = institutions.where(F.col("time_zone").isNotNull()).select(F.col("time_zone").alias("zone"))
    guess = estimate_zones(open_, "__source", "__value", "__ingested", zones).select("__source", F.col("zone").alias("__zone"))
    both = known.unionByName(open_.join(guess, "__source", "left").drop("__source"))
    return _converted(both, kept, prefix)


def _converted(zoned: DataFrame, kept: list[str], prefix: str) -> DataFrame:
    done = with_instant(zoned, "__value", F.col("__zone"), prefix)
    added = [f"{prefix}{c}" for c in ("form", "instant", "shown_day", "utc_day", "needs_zone")]
    taken = [c for c in dict.fromkeys(kept) if c not in (*added, f"{prefix}zone")]
    return done.select(*[F.col("__row")[c].alias(c) for c in taken], F.coalesce(F.col("__zone"), F.lit("UTC")).alias(f"{prefix}zone"), *added)

