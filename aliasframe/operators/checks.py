"""Leak checks: checksums, patterns, deny-lists, conformance of projections, seeds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import aba_valid, is_canonical, luhn_valid, spans
from ..session import broadcast_checked, written
from .sieve import sieve

LINE_BREAKS = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
DIGITS = r"(?<![0-9])[0-9]+(?![0-9])"
ACCOUNT_ID = r"(?i)\b[A-Z]{3,}-[A-Z]{2,4}-\d{4,}\b"
NINE = r"\b\d{9}\b"


def scan_text(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, match, line, col``: SSN shapes, nine-digit runs with a valid routing checksum and card numbers.

    Digit runs are maximal. Lines and columns count from 1. Rows that can't hold a hit leave the plan first.
    """
    some = rows.where(F.col(text).rlike(r"[0-9]{9}|[0-9]{3}-[0-9]{2}-[0-9]{4}")).select(key, F.posexplode(F.split(text, LINE_BREAKS)).alias("__line", "__text"))
    some = some.where(F.col("__text").rlike(r"[0-9]{9}|[0-9]{3}-[0-9]{2}-[0-9]{4}"))
    ssn = F.transform(spans(F.col("__text"), SSN), lambda s: F.struct(F.lit("ssn").alias("kind"), s["raw"].alias("match"), s["start"].alias("at")))
    run = F.transform(
        F.filter(spans(F.col("__text"), r"[0-9]+"), lambda s: F.length(s["raw"]).between(9, 19)),
        lambda s: F.struct(F.when((F.length(s["raw"]) == 9) & aba_valid(s["raw"]), "aba_routing").when((F.length(s["raw"]) >= 13) & luhn_valid(s["raw"]), "luhn_card").alias("kind"), s["raw"].alias("match"), s["start"].alias("at")),
    )
    found = some.select(key, "__line", F.explode(F.concat(ssn, F.filter(run, lambda r: r["kind"].isNotNull()))).alias("f"))
    return found.select(key, F.col("f.kind").alias("kind"), F.col("f.match").alias("match"), (F.col("__line") + 1).cast("bigint").alias("line"), (F.col("f.at") + 1).cast("bigint").alias("col"))


def detect(rows: DataFrame, key: str, text: str, deny: dict[str, list[str]] | None = None) -> DataFrame:
    """``key, entity_type, start, end, match, score`` of account ids, nine-digit runs and deny-listed terms.

    ``deny`` maps an entity type to its terms, which are matched whole, longest first, in any case. One
    finding per type and place, with the higher score.
    """
    found = None
    rules = [("ACCOUNT_ID", ACCOUNT_ID, 0.85), ("ROUTING_NUMBER", NINE, 0.4)]
    for kind, terms in (deny or {}).items():
        ordered = sorted(set(terms), key=lambda t: (-len(t), t))
        if ordered:
            rules.append((kind, r"(?i)(?:^|(?<=\W))(?:" + "|".join(_escape(t) for t in ordered) + r")(?:$|(?=\W))", 1.0))
    for kind, pattern, score in rules:
        one = rows.where(F.col(text).rlike(pattern)).select(key, F.explode(spans(F.col(text), pattern)).alias("s"))
        one = one.select(key, F.lit(kind).alias("entity_type"), F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), F.col("s.raw").alias("match"), F.lit(score).alias("score"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy(key, "entity_type", "start", "end", "match").agg(F.max("score").alias("score"))


def _escape(term: str) -> str:
    return "".join(c if c.isalnum() else r"\s+" if c == " " else "\\" + c for c in term)


def lint_text(rows: DataFrame, key: str, text: str, deny: dict[str, list[str]] | None = None) -> DataFrame:
    """``key, kind, match, detail``: everything :func:`scan_text` and :func:`detect` find, each once."""
    one = scan_text(rows, key, text).select(key, "kind", "match", F.concat_ws(":", F.col("line").cast("string"), F.col("col").cast("string")).alias("detail"))
    two = detect(rows, key, text, deny).select(key, F.col("entity_type").alias("kind"), "match", F.concat(F.col("start").cast("string"), F.lit(":"), F.col("end").cast("string"), F.format_string(" score=%.2f", F.col("score"))).alias("detail"))
    return one.unionByName(two).distinct()


def conformance(records: DataFrame, key: str) -> DataFrame:
    """``key, field, match`` of identifying fields (account, institution, payee) that are no canonical token; null is fine."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("match")) for f in ("account", "institution", "payee")])
    return records.select(key, F.inline(fields)).where(F.col("match").isNotNull() & ~is_canonical(F.col("match")))


#: Suffixes of the files that are scanned.
SUFFIXES = ("csv", "ofx", "qfx", "json", "md", "txt", "py", "toml", "yaml", "yml")


def scan_files(spark: SparkSession, target: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``path, kind, match, line, col`` of everything :func:`scan_text` finds in the files below ``target``; files that are no UTF-8 are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target).where(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))
    texts = files.where(F.expr("is_valid_utf8(CAST(content AS STRING))")).select("path", F.col("content").cast("string").alias("text"))
    return scan_text(texts, "path", "text")


_DOCUMENT = "struct<records:array<struct<account:string,institution:string,payee:string>>>"


def lint_file(spark: SparkSession, path: str, deny: dict[str, list[str]] | None = None) -> DataFrame:
    """``path, kind, match, detail`` of one file: all findings of its text and, if it is a JSON object with a list ``records``, its identifying fields that are no tokens."""
    files = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    found = lint_text(files, "path", "text", deny)
    records = files.select("path", F.posexplode(F.from_json("text", _DOCUMENT)["records"]).alias("at", "r")).select(F.concat_ws("#", "path", "at").alias("key"), "r.account", "r.institution", "r.payee")
    odd = conformance(records, "key").select(F.lit(path).alias("path"), F.lit("alias_nonconformance").alias("kind"), "match", F.concat(F.lit("records["), F.regexp_extract("key", r"#(\d+)$", 1), F.lit("]."), F.col("field")).alias("detail"))
    return found.unionByName(odd)


def report(findings: DataFrame, most: int = 200) -> str:
    """A report for a terminal: one line a kind with its count, then the first ``most`` findings by place; values are not shown."""
    counts = {r["kind"]: r["n"] for r in kind_counts(findings).collect()}  # one row a kind
    if not counts:
        return "clean"
    lines = [f"{k}: {n}" for k, n in sorted(counts.items())]
    return "\n".join([*lines, *(f"  {r['kind']} at {r['detail']}" for r in findings.orderBy("kind", "detail").limit(most).collect())])


def verdict(findings: DataFrame) -> DataFrame:
    """One row: ``verdict`` (clean or leaks), ``findings``, and the sorted ``kinds`` joined by commas."""
    return findings.agg(F.count("*").alias("findings"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).select(F.when(F.col("findings") == 0, "clean").otherwise("leaks").alias("verdict"), "findings", "kinds")


#: Lengths of the pieces of words that seeds and texts meet on.
SIZES = tuple(range(12, 0, -1))
_WORD, _EDGE = re.compile(r"[^\W_]+"), re.compile(r"[\W_]+")
#: Words whose pieces a task keeps at hand.
KEPT = 200_000


def _pieces(low: str) -> list[str]:
    """What a text that holds the seed is sure to hold: the words between two others whole, the end of the first, the beginning of the last, any part of an only word."""

    def cut(kind: str, word: str, take: Callable[[str, int], str]) -> list[str]:
        return next(([f"{kind}{k:02}{take(word, k)}"] for k in SIZES if len(word) >= k), [])

    first, *inner = _EDGE.split(low)
    if not inner:
        return cut("g", first, lambda w, k: w[:k])
    *inner, last = inner
    found = [f"w{w}" for w in inner] + cut("e", first, lambda w, k: w[-k:]) + cut("b", last, lambda w, k: w[:k])
    return found or [f"s{low[0]}"]


def _pieces_of_word(word: str, kinds: set[str]) -> list[str]:
    """The pieces of the kinds and sizes asked for that a word of a text gives."""
    found = [f"w{word}"] if "w" in kinds else []
    for k in SIZES:
        if len(word) >= k:
            found += [f"e{k:02}{word[-k:]}"] if f"e{k:02}" in kinds else []
            found += [f"b{k:02}{word[:k]}"] if f"b{k:02}" in kinds else []
            found += [f"g{k:02}{word[i : i + k]}" for i in range(len(word) - k + 1)] if f"g{k:02}" in kinds else []
    return found


def _seed_batches(batches):
    """seed, low, piece."""
    for batch in batches:
        found = [_pieces(x) for x in batch["low"].to_pylist()]
        at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["seed"].take(at), batch["low"].take(at), pa.array([p for f in found for p in f], pa.string())], names=["seed", "low", "piece"])


def _hash_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(p.encode()) for p in batch["piece"].to_pylist()], pa.int64())], names=["h"])


def _said_batches(bitmap: np.ndarray, kinds: set[str]):
    """k, piece: the pieces of each text that the bitmap of the seeds' pieces may hold."""
    bits, mask = bitmap.astype("<u8").tobytes(), len(bitmap) * 64 - 1

    def known(pieces):
        return tuple(p for p in pieces if bits[(h := zlib.crc32(p.encode()) & mask) >> 3] >> (h & 7) & 1)

    def run(batches):
        kept: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            at, said = [], []
            for i, t in enumerate(batch["t"].to_pylist()):
                found: set[str] = set()
                for w in set(_WORD.findall(t)):
                    if (ps := kept.get(w)) is None:
                        if len(kept) >= KEPT:
                            kept.clear()
                        ps = kept[w] = known(_pieces_of_word(w, kinds))
                    found.update(ps)
                if "s" in kinds:
                    found.update(known(f"s{c}" for c in set(_WORD.sub("", t))))
                at += [i] * len(found)
                said += found
            yield pa.RecordBatch.from_arrays([batch["k"].take(pa.array(at, pa.int64())), pa.array(said, pa.string())], names=["k", "piece"])

    return run


def seed_hits(rows: DataFrame, key: str, text: str, seeds: DataFrame) -> DataFrame:
    """``key, seed`` of every seed (``seeds(seed)``) that stands anywhere in a text, in any case, inside words too.

    A seed and the texts that hold it meet in an equi-join on one piece of the seed, that which fewest seeds have: a word between two others stands whole in the text;
    of the first word the end, of the last the beginning is certain, and of an only word any part of twelve letters (all letters of a shorter one).
    Texts put out only pieces that a bitmap of the seeds' pieces may hold; a word that comes again in a task is looked up, not cut again. Keys and such pieces are shuffled;
    the list of seeds is broadcast only while it is small. Then the whole seed is looked for. A seed of signs only meets texts on its first sign; null and empty seeds find nothing.
    """
    low = seeds.where(F.coalesce("seed", F.lit("")) != "").select("seed").distinct().withColumn("low", F.lower("seed"))
    pieces = written(low.mapInArrow(_seed_batches, "seed string, low string, piece string"))
    shared = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    best = F.min(F.struct("n", (-F.length("piece")).alias("less"), "piece"))["piece"]
    wanted = written(pieces.join(shared, "piece").groupBy("seed", "low").agg(best.alias("piece")))
    kinds = {r[0] for r in wanted.select(F.when(F.col("piece").rlike("^[ebg]"), F.left("piece", F.lit(3))).otherwise(F.left("piece", F.lit(1)))).distinct().collect()}  # at most 38
    bitmap = sieve(wanted.mapInArrow(_hash_batches, "h bigint"), wanted.count())
    form = StructType([StructField("k", rows.schema[key].dataType), StructField("piece", StringType())])
    told = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t")).mapInArrow(_said_batches(bitmap, kinds), form)
    met = told.join(broadcast_checked(wanted), "piece").select("k", "seed", "low")
    both = met.join(rows.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("t")), "k")
    return both.where(F.contains("t", "low")).select(F.col("k").alias(key), "seed").distinct()


def refuse(findings: DataFrame, allow: bool = False) -> None:
    """Raise if there is any finding; with ``allow`` only say so."""
    if not findings.isEmpty():
        if not allow:
            raise ValueError("the projection has findings; nothing was written")
        print("findings present; written because it was asked for")


def kind_counts(findings: DataFrame, kind: Column | str = "kind") -> DataFrame:
    return findings.groupBy(kind).agg(F.count("*").alias("n"))
