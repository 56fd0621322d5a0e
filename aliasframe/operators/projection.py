"""The alias-space view of a ledger: projection, windows, balances, probes, export."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.instants import with_instant
from ..functions.text import token_number, variant_key
from ..session import broadcast_checked
from . import aliases, checks

RECORD = ("account", "institution", "payee", "date", "amount", "ttype", "category")


def payee_tokens(mapping: DataFrame, variants: DataFrame) -> DataFrame:
    """variant, payee: the canonical token of every recorded spelling."""
    at = aliases.heads(mapping.where(F.col("entity_type") == "PAYEE"))
    return variants.join(at, F.col("alias_token") == F.col("token"), "left").withColumn("payee", F.coalesce("head", "alias_token")).groupBy("variant").agg(F.min_by("payee", F.struct(token_number(F.col("payee")), "payee")).alias("payee"))


def with_day(raw: DataFrame) -> DataFrame:
    """Add ``day``: the calendar day of ``posted_date`` in UTC, as ``YYYY-MM-DD``, in whatever way it is written.

    Values without a clock, or with a clock but no zone, keep the day they show. Text that states no day stays as it is; null stays null.
    """
    taken = [c for c in raw.columns if c != "day"]
    read = with_instant(raw.select(*taken, F.col("posted_date").alias("__date")), "__date", prefix="__p_")
    day = F.date_format("__p_utc_day", "yyyy-MM-dd")
    return read.select(*taken, F.coalesce(day, "posted_date").alias("day"))


def project(raw: DataFrame, mapping: DataFrame, variants: DataFrame) -> DataFrame:
    """``id`` and a record of :data:`RECORD` per raw row, with ``amount_cents``.

    Dates are calendar days (:func:`with_day`). Identifying values become tokens; a value without one stays as it is, for the lint to refuse. An
    empty institution is null. Dictionaries are broadcast only while they are small.
    """
    accounts = aliases.resolve_values(mapping, "ACCT").select(F.col("real_value").alias("account_id"), F.col("token").alias("__account"))
    banks = aliases.resolve_values(mapping, "INST").select(F.col("real_value").alias("institution"), F.col("token").alias("__bank"))
    payees = payee_tokens(mapping, variants).withColumnRenamed("payee", "__payee")
    carried = [F.col(c) if c in raw.columns else F.lit("").alias(c) for c in ("ttype", "category")]
    rows = with_day(raw.select("id", "account_id", "institution", "raw_payee", "posted_date", "amount_cents", *carried)).withColumn("variant", variant_key(F.col("raw_payee")))
    out = rows.join(broadcast_checked(accounts), "account_id", "left").join(broadcast_checked(banks), "institution", "left").join(broadcast_checked(payees), "variant", "left")
    return out.select(
        "id",
        F.coalesce("__account", "account_id", F.lit("")).alias("account"),
        F.coalesce("__bank", F.nullif("institution", F.lit(""))).alias("institution"),
        F.coalesce("__payee", "raw_payee", F.lit("")).alias("payee"),
        F.col("day").alias("date"),
        (F.col("amount_cents") / F.lit(100.0)).alias("amount"),
        F.coalesce("ttype", F.lit("")).alias("ttype"),
        F.coalesce("category", F.lit("")).alias("category"),
        "amount_cents",
    )


def month_rows(raw: DataFrame, month: str) -> DataFrame:
    """Rows whose calendar day, however written, lies in the month ``YYYY-MM``."""
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", month):
        raise ValueError("a month is written YYYY-MM")
    return with_day(raw).where(F.col("day").startswith(month)).select(*raw.columns)


def months(raw: DataFrame) -> DataFrame:
    """month: every ``YYYY-MM`` in which a row's calendar day lies."""
    return with_day(raw).where(F.col("day").try_cast("date").isNotNull()).select(F.substring("day", 1, 7).alias("month")).distinct()


def window(records: DataFrame, start: str | None = None, end: str | None = None, accounts: list[str] | DataFrame | None = None) -> DataFrame:
    """Records with start <= date <= end (dates are ``YYYY-MM-DD``; either end may be open) of some accounts (None: all, empty: none)."""
    out = records
    if start is not None:
        out = out.where(F.col("date") >= start)
    if end is not None:
        out = out.where(F.col("date") <= end)
    if isinstance(accounts, DataFrame):
        return out.join(accounts.select("account").distinct(), "account", "left_semi")
    return out if accounts is None else out.where(F.col("account").isin(list(accounts)))


def balances(records: DataFrame) -> DataFrame:
    """Per account: institution first seen, net, debits (<= 0), credits (>= 0) in cents, and the count."""
    c = F.col("amount_cents")
    return records.groupBy("account").agg(
        F.min_by("institution", "id").alias("institution"),
        F.coalesce(F.sum(c), F.lit(0)).alias("net_cents"),
        F.coalesce(F.sum(F.when(c < 0, c)), F.lit(0)).alias("debit_cents"),
        F.coalesce(F.sum(F.when(c >= 0, c)), F.lit(0)).alias("credit_cents"),
        F.count("*").alias("txn_count"),
    )


def payee_spend(records: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    rows = records if tokens is None else records.join(tokens.select("payee").distinct(), "payee", "left_semi")
    return rows.groupBy("payee").agg(F.sum("amount_cents").alias("spend_cents"), F.count("*").alias("n"))


def account_net(records: DataFrame) -> DataFrame:
    return records.groupBy("account").agg(F.sum("amount_cents").alias("net_cents"))


def account_count(records: DataFrame) -> DataFrame:
    return records.groupBy("account").agg(F.count("*").alias("n"))


def largest_expense(records: DataFrame) -> DataFrame:
    """Per account the smallest amount, its payee and id (the first of equals)."""
    worst = records.where(F.col("amount_cents").isNotNull()).groupBy("account").agg(F.min(F.struct("amount_cents", "id", "payee")).alias("w"))
    return worst.select("account", "w.amount_cents", "w.id", "w.payee")


def canonical_statements(files: DataFrame) -> DataFrame:
    """One file per account, type and month: the first by path."""
    w = Window.partitionBy("account_id", "account_type", "stmt_month").orderBy("source_file", "file_id")
    return files.withColumn("__k", F.row_number().over(w)).where(F.col("__k") == 1).drop("__k")


def collapse_check(records: DataFrame, group: str) -> DataFrame:
    """Per group: rows, distinct payees, and whether 100 rows or more share payees a hundredfold."""
    counted = records.groupBy(group).agg(F.count("*").alias("n_rows"), F.countDistinct("payee").alias("n_payees"))
    return counted.withColumn("collapsed", (F.col("n_rows") >= 100) & (F.col("n_payees") > 0) & (F.col("n_rows") >= 100 * F.col("n_payees")))


def ingest_summary(raw: DataFrame, mapping: DataFrame, variants: DataFrame) -> DataFrame:
    """Per source file: rows, spellings not yet known, and values in each class not yet known."""
    accounts = aliases.resolve_values(mapping, "ACCT").select(F.col("real_value").alias("account_id"), F.lit(1).alias("__a"))
    known = variants.select("variant").distinct().withColumn("__v", F.lit(1))
    rows = raw.withColumn("variant", variant_key(F.col("raw_payee"))).join(known, "variant", "left").join(accounts, "account_id", "left")
    return rows.groupBy("source_file").agg(F.count("*").alias("n_rows"), F.countDistinct(F.when(F.col("__v").isNull(), F.col("variant"))).alias("new_variants"), F.countDistinct(F.when(F.col("__a").isNull(), F.col("account_id"))).alias("new_accounts"))


def record_json(fields: tuple[str, ...] = RECORD) -> Column:
    """A record as JSON with sorted keys; nulls stand there as null."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def attestation(stamp: str) -> dict:
    return {"tool": "aliasframe", "check": "lint", "status": "green", "leak_count": 0, "timestamp": stamp, "linter": "aliasframe.checks", "linter_version": 1}


def document(records: DataFrame, **head) -> str:
    """``{version, records}`` and what else ``head`` holds as one JSON text with sorted keys, records by id: for a window that a reader takes whole."""
    rows = [json.loads(r[0]) for r in records.orderBy("id").select(record_json()).toLocalIterator()]
    return json.dumps({"version": 1, **head, "records": rows}, sort_keys=True, ensure_ascii=False)


def write_document(records: DataFrame, path: str, **head) -> None:
    """The same document written to one file of any file system as the rows stream by; it appears under its name only when whole."""
    jvm = records.sparkSession._jvm
    stage, final = jvm.org.apache.hadoop.fs.Path(f"{path}._staged"), jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(records.sparkSession._jsc.hadoopConfiguration())
    out = fs.create(stage, True)
    before, after = {k: v for k, v in head.items() if k < "records"}, {"version": 1, **{k: v for k, v in head.items() if k > "records"}}
    out.write(bytearray(("{" + "".join(f"{json.dumps(k)}: {json.dumps(v, sort_keys=True)}, " for k, v in sorted(before.items())) + '"records": [').encode()))
    for i, r in enumerate(records.orderBy("id").select(record_json()).toLocalIterator()):
        out.write(bytearray(((", " if i else "") + r[0]).encode()))
    out.write(bytearray(("]" + "".join(f", {json.dumps(k)}: {json.dumps(v, sort_keys=True)}" for k, v in sorted(after.items())) + "}").encode()))
    out.close()
    fs.delete(final, True)
    fs.rename(stage, final)


def export_month(raw: DataFrame, mapping: DataFrame, variants: DataFrame, month: str, out: str, stamp: str, single: bool = False) -> dict:
    """Write one month's projection if nothing leaks: ``{month, rows, verdict, findings, path}``.

    With ``single`` the month is one JSON document ``{provenance, records, version}``; else a JSON-lines table of its records with the attestation
    beside it, written by the executors. Either is made visible by a rename. The lint runs over the records' whole JSON. On findings nothing is written; an empty month is written as such and says so.
    """
    records = project(month_rows(raw, month), mapping, variants)
    text = records.select("id", record_json().alias("text"))
    findings = checks.conformance(records, "id").select(F.lit("alias_nonconformance").alias("kind"), "match", "field").unionByName(checks.lint_text(text, "id", "text").select("kind", "match", F.col("detail").alias("field")))
    n, bad = records.count(), findings.count()
    if bad:
        return {"month": month, "rows": n, "verdict": "red", "findings": bad, "path": None}
    if single:
        write_document(records, out, provenance=attestation(stamp))
        return {"month": month, "rows": n, "verdict": "green" if n else "empty", "findings": 0, "path": os.fspath(out)}
    jvm = raw.sparkSession._jvm
    stage, final = jvm.org.apache.hadoop.fs.Path(f"{out}._staged"), jvm.org.apache.hadoop.fs.Path(out)
    fs = final.getFileSystem(raw.sparkSession._jsc.hadoopConfiguration())
    fs.delete(stage, True)
    records.select(record_json().alias("value")).write.text(f"{out}._staged/records")
    envelope = raw.sparkSession.createDataFrame([(json.dumps({"version": 1, "provenance": attestation(stamp)}, sort_keys=True),)], "value string")
    envelope.coalesce(1).write.text(f"{out}._staged/envelope")
    fs.delete(final, True)
    fs.rename(stage, final)
    return {"month": month, "rows": n, "verdict": "green" if n else "empty", "findings": 0, "path": os.fspath(out)}
