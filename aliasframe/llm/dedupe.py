"""New batches against all history: repeats found by hashes inside buckets, never by reading history again.

A record's paragraphs are its account, its amount, its payee (in any spelling) and its posting day. ``key`` hashes
the first two, ``content`` all four. Accepted rows stand in a table bucketed by ``key``; a batch meets it in a semi-join
inside its buckets. A full copy has an equal ``content``; a changed one covers the first three paragraphs and lies at most
``days`` apart. Rows fall into sessions, runs of days of one key without a gap above ``days``: no repeat crosses a
session, so sessions are independent, and those of a single batch leave the plan before any payee is read.
Inside a session rows of equal content are one spelling and need no comparison; what differs is gathered under one entity. Rows of
one day, batch and entity are one unit (they stand or fall together), and one streaming pass per entity takes the units batch by
batch: a unit repeats the first accepted one of an earlier batch within ``days``, or is accepted, and its hashes are appended.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.timestamps import to_utc
from ..session import checkpoint, written
from .names import Core, group_entities, read_name
from .names import entities as core_entities
from .pii import without_contacts

DAYS, BUCKETS = 3, 64
#: Up to so many spellings of one session are compared pairwise in place; more go through equal rewritings, by the same rule.
FEW = 24
KEY = ["key", "session"]


def prepare(transactions: DataFrame, institutions: DataFrame) -> DataFrame:
    """``id, account_id, amount_cents, payee, batch_id, day`` of the rows that can repeat or be repeated.

    Rows without account, amount, payee (null or blank), batch or readable day can't; they count as accepted.
    """
    at = to_utc(transactions.select("id", "account_id", "institution", "posted_date", "ingested_at", "amount_cents", "raw_payee", "batch_id"), "posted_date", "account_id", "institution", "ingested_at", institutions, sources=transactions.select("account_id", "institution"))
    payee = F.upper(F.trim(F.regexp_replace("raw_payee", r"\s+", " ")))
    rows = at.select("id", "account_id", "amount_cents", payee.alias("payee"), "batch_id", F.unix_date("utc_day").alias("day"))
    return rows.where(F.col("account_id").isNotNull() & F.col("amount_cents").isNotNull() & F.col("batch_id").isNotNull() & F.col("day").isNotNull() & (F.col("payee") != ""))


def hashed(rows: DataFrame) -> DataFrame:
    """``id, key, payee, batch_id, day`` of rows as from :func:`prepare`; a 64-bit hash takes the place of account and amount."""
    return rows.select("id", F.xxhash64("account_id", "amount_cents").alias("key"), "payee", "batch_id", "day")


def _content() -> Column:
    return F.xxhash64("key", "day", "payee")


def in_sessions(rows: DataFrame, days: int = DAYS) -> DataFrame:
    """The rows of sessions with more than one batch, with ``session``, the session's first day.

    The windows run over the distinct days of a key, so a group however large is combined before the shuffle to one row per day.
    """
    daily = rows.groupBy("key", "day").agg(F.min("batch_id").alias("least"), F.max("batch_id").alias("most"))
    by_day = Window.partitionBy("key").orderBy("day")
    starts = F.when(F.coalesce(F.col("day") - F.lag("day").over(by_day) > days, F.lit(True)), F.col("day"))
    runs = daily.withColumn("start", starts).withColumn("session", F.last("start", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*KEY)
    mixed = runs.withColumn("a", F.min("least").over(whole)).withColumn("b", F.max("most").over(whole)).where(F.col("a") < F.col("b"))
    return rows.join(mixed.select("key", "day", "session"), ["key", "day"])


def _label(names: list[str]) -> list[str]:
    """The least spelling of each name's entity among a few names of one session."""
    if len(names) == 1:
        return names
    cores = [None if (c := read_name(without_contacts(n))) is None else c.key() for n in names]
    label = group_entities({k for k in cores if k is not None})
    least: dict[str, str] = {}
    for n, k in zip(names, cores, strict=True):
        if k is not None:
            least[label[k]] = min(n, least.get(label[k], n))
    return [n if k is None else least[label[k]] for n, k in zip(names, cores, strict=True)]


_ENTITY = pa.schema([("key", pa.int64()), ("session", pa.int32()), ("payee", pa.string()), ("entity", pa.string())])
_ENTITY_DDL = "key bigint, session int, payee string, entity string"


def _entity_batches(few: int):
    """Sorted (key, payee) rows -> the same with ``entity``; null where a session has more than ``few`` payees."""

    def run(batches):
        current, names, many = None, [], False

        def flush():
            got = [None] * len(names) if many else _label(names)
            return [(*current, n, e) for n, e in zip(names, got, strict=True)]

        for batch in batches:
            out = []
            for *key, payee in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != current:
                    if names:
                        out += flush()
                    current, names, many = key, [], False
                names.append(payee)
                if many or len(names) > few:
                    many = True
                    out += flush()
                    names = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ENTITY.types, strict=True)], schema=_ENTITY)
        if names and (out := flush()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ENTITY.types, strict=True)], schema=_ENTITY)

    return run


def _core_of_payee(batches):
    for batch in batches:
        cores = [None if (c := read_name(without_contacts(p))) is None else c.key() for p in batch.column("payee").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cores, pa.string())], names=[*batch.schema.names, "core"])


def entities(spellings: DataFrame, few: int = FEW) -> DataFrame:
    """``key, session, payee, entity`` for the distinct spellings of each session."""
    named = spellings.select(*KEY, "payee").distinct().repartition(F.xxhash64(*KEY)).sortWithinPartitions(*KEY, "payee")
    got = checkpoint(named.mapInArrow(_entity_batches(few), _ENTITY_DDL))
    many = got.where(F.col("entity").isNull())
    if many.isEmpty():
        return got
    group = F.xxhash64(*KEY).cast("string")
    cored = checkpoint(many.select(*KEY, "payee").mapInArrow(_core_of_payee, "key bigint, session int, payee string, core string").withColumn("grp", group))
    found = core_entities(cored.where(F.col("core").isNotNull()).select("core", "grp"))
    node = F.when(F.col("core").isNotNull(), F.concat_ws("\x1f", "grp", "core"))
    done = cored.join(found, node == F.col("node"), "left").select(*KEY, "payee", F.coalesce("label", node, F.col("payee")).alias("entity"))
    return got.where(F.col("entity").isNotNull()).unionByName(done)


_FOLD = "key bigint, session int, entity bigint, day int, batch_id bigint, first_id bigint"
_FOLD_ARROW = pa.schema([("key", pa.int64()), ("session", pa.int32()), ("entity", pa.int64()), ("day", pa.int32()), ("batch_id", pa.int64()), ("first_id", pa.int64())])


def _fold_batches(days: int):
    def run(batches):
        current, accepted = None, {}
        for batch in batches:
            out = []
            for *key, day, batch_id, first in zip(*(batch.column(n).to_pylist() for n in (*KEY, "entity", "day", "batch_id", "least_id")), strict=True):
                if key != current:
                    current, accepted = key, {}
                near = [a for d in range(day - days, day + days + 1) if (a := accepted.get(d)) and a[0] < batch_id]
                if near:
                    out.append((*key, day, batch_id, min(i for _, i in near)))
                else:
                    accepted.setdefault(day, (batch_id, first))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FOLD_ARROW.types, strict=True)], schema=_FOLD_ARROW)

    return run


def _repeats(rows: DataFrame, days: int, few: int = FEW) -> DataFrame:
    """``first_id, id`` among hashed rows."""
    near = checkpoint(in_sessions(rows, days))
    known = entities(near, few).select(*KEY, F.xxhash64("payee").alias("spelling"), F.xxhash64("entity").alias("entity"))
    tagged = checkpoint(near.select("id", *KEY, F.xxhash64("payee").alias("spelling"), "day", "batch_id").join(known, [*KEY, "spelling"]).drop("spelling"))
    units = tagged.groupBy(*KEY, "entity", "day", "batch_id").agg(F.min("id").alias("least_id"))
    folded = units.repartition(F.xxhash64(*KEY, "entity")).sortWithinPartitions(*KEY, "entity", "batch_id", "least_id").mapInArrow(_fold_batches(days), _FOLD)
    return tagged.join(folded, [*KEY, "entity", "day", "batch_id"]).select("first_id", "id").distinct()


def repeats(rows: DataFrame, days: int = DAYS, few: int = FEW) -> DataFrame:
    """``first_id, id`` for each row that repeats an accepted row of an earlier batch (see the module's text).

    ``rows`` as from :func:`prepare`, in any number of batches. Rows of one batch never repeat each other.
    Of several accepted rows in reach the lowest id is named. Rows standing twice with one id give one pair.
    """
    return _repeats(written(hashed(rows)), days, few)


class History:
    """Hashes of the accepted rows in a written table, bucketed by the hash of account and amount.

    ``admit`` takes a delivery of one batch or several: it reads the buckets the delivery falls into, of these only rows that share a key
    with it (a semi-join inside the bucket), decides batch by batch, and appends what it accepts. The time
    for a delivery depends on it and its buckets, not on the deliveries before. A batch delivered later must have a higher number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, days: int = DAYS):
        self.spark, self.path, self.buckets, self.days = spark, path, buckets, days

    def _bucket(self):
        return F.pmod(F.col("key"), F.lit(self.buckets)).cast("int")

    def accepted(self) -> DataFrame | None:
        """``id, key, content, payee, batch_id, day, bucket`` of all accepted rows; None before the first delivery."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.parquet(self.path)

    def admit(self, delivery: DataFrame) -> DataFrame:
        """``first_id, id`` of the delivery's repeats; its other rows (as from :func:`prepare`) are appended."""
        new = written(hashed(delivery))
        stored, rows = self.accepted(), new
        if stored is not None:
            placed = new.withColumn("bucket", self._bucket())
            touched = [r[0] for r in placed.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            old = stored.where(F.col("bucket").isin(touched)).join(placed.select("bucket", "key").distinct(), ["bucket", "key"], "left_semi")
            rows = new.unionByName(old.select(*new.columns))
        found = _repeats(rows, self.days)
        if stored is not None:
            found = found.join(new.select("id"), "id", "left_semi")
        found = checkpoint(found)
        kept = new.join(found.select("id"), "id", "left_anti").select("id", "key", _content().alias("content"), "payee", "batch_id", "day", self._bucket().alias("bucket"))
        kept.repartition("bucket").write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(self.path)
        return found.select("first_id", "id")


__all__ = ["Core", "History", "entities", "hashed", "in_sessions", "prepare", "repeats"]
