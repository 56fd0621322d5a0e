"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import parse_lines
from ..session import checkpoint, ensure_checkpoint_dir, read_table
from . import dedupe, encoding, mixing, names, packing, pii, splitting
from .tokens import with_tokens

_PII_FIELDS = {"raw_transactions": ("id", ["raw_payee", "raw_memo"]), "injection_memos": ("memo_id", ["raw"])}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, (key, fields) in _PII_FIELDS.items():
        found = pii.find(read_table(spark, d, table), key, fields).select(F.lit(table).alias("tbl"), "row_id", "field_name", "pii_kind")
        out = found if out is None else out.unionByName(found)
    return out


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    raw = pii.redact_fields(read_table(spark, d, "raw_transactions"), "id", ["raw_payee", "raw_memo"])
    memos = pii.redact_fields(read_table(spark, d, "injection_memos"), "memo_id", ["raw"])
    return raw.select(F.lit("raw_transactions").alias("tbl"), "*").unionByName(memos.select(F.lit("injection_memos").alias("tbl"), "*"), allowMissingColumns=True)


def _descriptions(spark: SparkSession, d: str, only: str | None = None) -> DataFrame:
    """line_id, text: the description of every record; of a record that can't be read, the whole record.

    ``only`` keeps lines that match a pattern, and the headers.
    """
    lines = read_table(spark, d, "statement_lines")
    if only is not None:
        lines = lines.where((F.col("line_no") == 1) | F.col("raw_line").rlike(only))
    parsed = parse_lines(lines).where(~F.col("blank"))
    return parsed.select("line_id", F.when(F.col("fault").isNull(), F.col("description")).otherwise(F.array_join("cells", ",")).alias("text"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    memos = read_table(spark, d, "raw_transactions").select(F.lit("raw_transactions").alias("tbl"), F.col("id").alias("row_id"), F.col("raw_memo").alias("text"))
    lines = _descriptions(spark, d, r"[^\x00-\x7F]").select(F.lit("statement_lines").alias("tbl"), F.col("line_id").alias("row_id"), "text")
    return encoding.repair_texts(memos.unionByName(lines), ["tbl", "row_id"], "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_restored(spark, d).select("tbl", "row_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    variants = read_table(spark, d, "payee_variant").select("id", F.col("variant").alias("name")).where(F.col("name").isNotNull())
    linked = variants.join(names.link_names(variants).select("name", "entity"), "name").select("entity", "id")
    a, b = linked.select("entity", F.col("id").alias("id_a")), linked.select("entity", F.col("id").alias("id_b"))
    return a.join(b, "entity").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Cores of the recorded spellings that agree, with the summed rarity of the rewritings they share."""
    cores = checkpoint(names.cores(read_table(spark, d, "payee_variant").select(F.col("variant").alias("name"))))
    keys = cores.where(F.col("core").isNotNull() & ~F.col("core").rlike(r"^P\|[^|]*\|\|")).select("core", F.lit("").alias("grp")).distinct()
    return names.links(keys)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a recorded spelling: its entity, and how many spellings that has."""
    variants = read_table(spark, d, "payee_variant").select("id", F.col("variant").alias("name")).where(F.col("name").isNotNull())
    linked = checkpoint(variants.join(names.link_names(variants).select("name", "entity"), "name"))
    return linked.join(linked.groupBy("entity").agg(F.count("*").alias("spellings")), "entity").select("id", "entity", "spellings")


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every distinct spelling in the variants, the transactions and the statement files."""
    spellings = read_table(spark, d, "payee_variant").select(F.col("variant").alias("name"))
    spellings = spellings.union(read_table(spark, d, "raw_transactions").select("raw_payee")).union(_descriptions(spark, d).select("text"))
    return names.link_names(spellings).select("name", "entity")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The whole table as one delivery of all its batches to an empty history."""
    rows = dedupe.prepare(read_table(spark, d, "raw_transactions"), read_table(spark, d, "institutions"))
    history = dedupe.History(spark, f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}")
    return history.admit(rows).select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b"))


def p7_history(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs, delivered in four parts to a history on disk: each part reads only the buckets and keys it falls into."""
    rows = checkpoint(dedupe.prepare(read_table(spark, d, "raw_transactions"), read_table(spark, d, "institutions")))
    history, out = dedupe.History(spark, f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"), None
    cuts = rows.agg(F.percentile_approx("batch_id", [0.25, 0.5, 0.75]).alias("c")).first()["c"] or []
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = rows if low is None else rows.where(F.col("batch_id") > low)
        found = history.admit(part if high is None else part.where(F.col("batch_id") <= high))
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("first_id").alias("id_a"), F.col("id").alias("id_b"))


def p7_accepted(spark: SparkSession, d: str) -> DataFrame:
    """The accepted rows: all but those that repeat an earlier one."""
    return read_table(spark, d, "raw_transactions").select("id", "account_id", "batch_id").join(p7_found(spark, d).select(F.col("id_b").alias("id")), "id", "left_anti")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(with_tokens(read_table(spark, d, "documents"), ["doc_id"]))


#: Weight at the begin and the end of training of the sources that don't stay level.
SCHEDULE = {"support_chat": (1.4, 0.6), "policy_page": (0.6, 1.4), "audit_log": (0.5, 1.5)}


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(with_tokens(read_table(spark, d, "documents"), ["doc_id", "source"]), read_table(spark, d, "mix_targets"), SCHEDULE)


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(read_table(spark, d, "documents"), with_text=False).where(F.col("piece_no") == 0).select("doc_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_documents(read_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p4_found, p4_restored, p5_found, p5_links, p5_classes, p5_entities, p7_found, p7_history, p7_accepted, p8_packed, p9_mixed, p9_shares, p10_found, p10_pieces)}

SQL = {
    "p10_found": r"""
        SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')) > 512
    """,
}
