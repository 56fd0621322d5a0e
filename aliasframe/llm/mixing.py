"""Sources mixed to target shares along a time-varying curriculum.

A run of ``total`` tokens is laid out over the time 0..1. Each source has a weight schedule; its integral up
to t times the source's tokens is what the source must have delivered by t. The documents of a source stand
in a random but fixed order, repeated passes one after another; the cumulative tokens before a document,
put into the inverse of that demand, give its training position, and a range sort by position gives the
order of training. The last pass is a part of the documents only: those that fit what is left of the demand, in
that order, then, where the next would reach beyond it, the ones that fill the rest best. Prefix sums run inside
hash buckets, as many as the documents ask for, and over bucket totals, so no source, however large, is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import broadcast_checked, checkpoint

#: Documents a bucket of prefix sums holds on average, and the part of a demand that may stay open.
PER_BUCKET, NEAR = 50_000, 0.002


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per source of ``targets`` or ``sizes``: what it has, may give and gives.

    ``source, target_share, max_repeats, documents, available, wanted_share, demand, sets_size``, the last true for the source that held
    the size of the mix down. Sources without tokens
    can't take part and sources without a target get none; the target shares of the others are scaled to sum
    to 1. Without ``total``, the mix is the largest in which every share is met exactly: the source
    that runs out first under its cap of repeats sets the size. With it, capped sources fall short.
    Null shares count as 0, null caps as 1. A source named twice counts with its summed share, lowest cap.
    """
    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.when(F.col("tokens") > 0, 1)).alias("documents"), F.sum("tokens").alias("available"))
    want = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    both = want.join(have, "source", "full").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available"))
    live = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    over = Window.partitionBy(F.lit(1))  # one row per source
    out = both.withColumn("wanted_share", F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(over)).otherwise(0.0))
    most = F.col("available") * F.col("max_repeats")
    size = F.lit(total) if total is not None else F.floor(F.min(F.when(live, most / F.col("wanted_share"))).over(over))
    reach = F.when(live, most / F.col("wanted_share"))
    out = out.withColumn("sets_size", F.lit(False) if total is not None else F.coalesce(reach == F.min(reach).over(over), F.lit(False)))
    return out.withColumn("demand", F.when(live, F.least(most, F.floor(size * F.col("wanted_share")))).otherwise(0).cast("bigint"))


def _position(done: Column, w0: Column, w1: Column) -> Column:
    """t with integral(weight, 0..t) = done * integral(weight, 0..1), for a weight that runs straight from w0 to w1."""
    a, b = (w1 - w0) / 2, w0
    c = done * (w0 + w1) / 2
    return F.when(F.abs(a) < 1e-9, done).otherwise(F.greatest(F.lit(0.0), (-b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * a * c))) / (2 * a)))


def _before(rows: DataFrame, group: list[str], buckets: int) -> DataFrame:
    """Add ``at``, the tokens before each row of its group in the order of ``h``: a prefix sum inside buckets and over their totals."""
    cut = rows.withColumn("__bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets).cast("int"))
    totals = cut.groupBy(*group, "__bucket").agg(F.sum("tokens").alias("__sum"))
    base = F.sum("__sum").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("tokens").over(Window.partitionBy(*group, "__bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.withColumn("__in", F.coalesce(inside, F.lit(0))).join(totals.select(*group, "__bucket", F.coalesce(base, F.lit(0)).alias("__base")), [*group, "__bucket"])
    return placed.withColumn("at", F.col("__base") + F.col("__in")).drop("__bucket", "__base", "__in")


def _exchanged(rows: DataFrame, taken: DataFrame, left: DataFrame, near: float) -> DataFrame:
    """``taken`` with documents exchanged, one a round and source, as long as that brings a source that is still off nearer to its demand.

    Only sources whose documents are large against their demand come here. The best partner of each free document is found by sorting both by
    size: the free one stands where the size it should replace would stand.
    """
    while True:
        off = left.where(F.abs("open") > near * F.col("demand")).select("source", "open")
        if off.isEmpty():
            return taken
        mine = taken.join(broadcast_checked(off), "source")
        free = rows.join(taken.select("source", "doc_id"), ["source", "doc_id"], "left_anti").join(broadcast_checked(off), "source")
        doc = F.struct("tokens", "h", "doc_id")
        both = mine.select("source", "open", F.col("tokens").alias("size"), doc.alias("old"), F.lit(None).cast("struct<tokens:bigint,h:bigint,doc_id:bigint>").alias("new"))
        both = both.unionByName(free.select("source", "open", (F.col("tokens") - F.col("open")).alias("size"), F.lit(None).cast("struct<tokens:bigint,h:bigint,doc_id:bigint>").alias("old"), doc.alias("new")))
        w = Window.partitionBy("source").orderBy("size", "old", "new")
        nearest = both.select("source", "open", "new", "size", F.last("old", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("below"), F.first("old", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("above"))
        beside = nearest.select("source", "open", "new", "size", F.explode(F.array("below", "above")).alias("old"))
        gap = F.abs(F.col("old.tokens") - F.col("size"))
        best = beside.where(F.col("new").isNotNull() & F.col("old").isNotNull()).groupBy("source", "open").agg(F.min(F.struct(gap.alias("gap"), "old", "new")).alias("b")).where(F.col("b.gap") < F.abs("open"))
        best = checkpoint(best)
        if best.isEmpty():
            return taken
        kept = taken.join(best.select("source", F.col("b.old.doc_id").alias("doc_id")), ["source", "doc_id"], "left_anti")
        taken = checkpoint(kept.unionByName(best.select("source", "b.new.doc_id", "b.new.tokens", "b.new.h").select(*taken.columns)))
        moved = best.select("source", (F.col("open") - F.col("b.new.tokens") + F.col("b.old.tokens")).alias("now"))
        left = checkpoint(left.join(moved, "source").select("source", F.col("now").alias("open"), "demand"))


def _last_pass(rows: DataFrame, rest: DataFrame, buckets: int, near: float) -> DataFrame:
    """The rows (source, doc_id, tokens, h) that fill ``rest(source, open, demand)``: no document twice, and no source beyond half its open rest.

    First, in the order of ``h``, documents that fit as long as the sum does; what the next one leaves open goes through the same with the documents
    that still fit. Once under a twentieth of the demand is open, the document nearest to it is taken, as long as one brings the sum nearer. Where
    no document fits any more, taken ones are exchanged for others (:func:`_exchanged`).
    """
    taken, left = rows.limit(0), checkpoint(rest.where(F.col("open") > 0))
    while True:
        wide = left.where(F.col("open") > 0.05 * F.col("demand"))
        narrow = left.where((F.col("open") <= 0.05 * F.col("demand")) & (F.col("open") > near * F.col("demand")))
        free = rows.join(taken.select("source", "doc_id"), ["source", "doc_id"], "left_anti")
        fits = free.join(broadcast_checked(wide.select("source", "open")), "source").where(F.col("tokens") <= F.col("open"))
        prefix = _before(fits, ["source"], buckets).where(F.col("at") + F.col("tokens") <= F.col("open")).select("source", "doc_id", "tokens", "h")
        gap = F.abs(F.col("open") - F.col("tokens"))
        close = free.join(broadcast_checked(narrow.select("source", "open")), "source").where(gap < F.col("open"))
        one = close.groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "h", "doc_id", "tokens")).alias("best")).select("source", "best.doc_id", "best.tokens", "best.h")
        more = checkpoint(prefix.unionByName(one.select(*prefix.columns)))
        if more.isEmpty():
            return _exchanged(rows, taken, left, near)
        taken = taken.unionByName(more)
        got = more.groupBy("source").agg(F.sum("tokens").alias("got"))
        left = checkpoint(left.join(got, "source", "left").withColumn("open", F.col("open") - F.coalesce("got", F.lit(0))).drop("got"))


def mix(sizes: DataFrame, targets: DataFrame, schedule: dict[str, tuple[float, float]] | None = None, total: int | None = None, seed: int = 7, near: float = NEAR) -> tuple[DataFrame, DataFrame]:
    """(selection, report) for ``sizes(doc_id, source, tokens)`` and ``targets(source, target_share, max_repeats)``.

    selection: ``position, source, doc_id, use_no, tokens``, sorted by position. ``schedule`` gives the weight of a source at the
    begin and the end of training; the others stay level. A source misses its demand by at most ``near`` of it unless no document that is
    left brings it nearer. A document named twice counts once, with its greater size. report: the plan with ``used_tokens, used_rows, most_uses, reached_share``. Empty inputs give empty results.
    """
    sizes = checkpoint(sizes.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens")).withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    goals = checkpoint(plan(sizes, targets, total))
    buckets = 4 + int(goals.agg(F.coalesce(F.max("documents"), F.lit(0))).first()[0]) // PER_BUCKET
    goal = goals.where(F.col("demand") > 0).select("source", "demand", "available", F.expr("demand div available").alias("full"), (F.col("demand") % F.col("available")).alias("open"))
    rows = sizes.where(F.col("tokens") > 0).join(broadcast_checked(goal.select("source", "full")), "source")
    passes = rows.where("full > 0").select("source", "doc_id", "tokens", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("use_no"))
    last = _last_pass(rows.select("source", "doc_id", "tokens", "h"), goal.select("source", "open", "demand"), buckets, near)
    last = last.join(broadcast_checked(goal.select("source", F.col("full").alias("use_no"))), "source").select(*passes.columns)
    used = _before(passes.unionByName(last), ["source", "use_no"], buckets).join(broadcast_checked(goal.select("source", "demand", "available")), "source")
    done = F.least(F.lit(1.0), (F.col("use_no") * F.col("available") + F.col("at")) / F.col("demand"))
    w0, w1 = F.lit(1.0), F.lit(1.0)
    for name, (begin, end) in (schedule or {}).items():
        w0 = F.when(F.col("source") == name, begin).otherwise(w0)
        w1 = F.when(F.col("source") == name, end).otherwise(w1)
    chosen = used.select(_position(done, w0, w1).alias("position"), "source", "doc_id", (F.col("use_no") + 1).alias("use_no"), "tokens")
    counted = chosen.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("used_rows"), F.max("use_no").alias("most_uses"))
    report = goals.join(counted, "source", "left").select(*goals.columns, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("used_tokens", "used_rows", "most_uses")])
    all_used = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    report = report.withColumn("reached_share", F.when(all_used > 0, F.col("used_tokens") / all_used).otherwise(0.0))
    return chosen.orderBy("position", "source", "doc_id", "use_no"), report
