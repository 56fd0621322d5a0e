"""A folder of statements with a manifest beside them: what is true of the files, and what must not leak from them.

The manifest is JSON: ``accounts`` (account type -> ``account_id``, ``institution`` and, if known, ``routing_number``, ``mask``) and
``payees`` (label -> its spellings). File names are ``type_YYYY-MM.csv`` or ``.ofx``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks
from . import statement

_NAME = r"([^/_]+)_(\d{4}-\d{2})\.(csv|ofx)$"


def load_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest of a folder, as a dictionary; one small file."""
    return json.loads(spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0])


def _accounts(spark: SparkSession, manifest: dict) -> DataFrame:
    rows = [(t, a.get("account_id"), a.get("institution")) for t, a in sorted(manifest["accounts"].items())]
    return spark.createDataFrame(rows, "account_type string, known_account string, known_institution string")


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the ``statement`` reader with ``account_type, format, stmt_month``, for files named after an account of the manifest.

    A CSV has account and institution from the manifest; an OFX has its own, and the manifest's institution where it names none.
    Other files are passed over. Faulty rows come with their reason.
    """
    manifest = load_manifest(spark, folder)
    read = statement.read(spark, folder).withColumn("account_type", F.regexp_extract("source_file", _NAME, 1)).withColumn("stmt_month", F.regexp_extract("source_file", _NAME, 2)).withColumn("format", F.regexp_extract("source_file", _NAME, 3))
    both = read.join(F.broadcast(_accounts(spark, manifest)), "account_type")  # one row an account type
    csv, bare = F.col("format") == "csv", F.col("institution") == F.col("account_id")
    taken = [c for c in read.columns if c not in ("account_id", "institution")]
    return both.select(*taken, F.when(csv, F.col("known_account")).otherwise(F.col("account_id")).alias("account_id"), F.when(csv | bare, F.coalesce("known_institution", "institution")).otherwise(F.col("institution")).alias("institution"))


def payees(spark: SparkSession, manifest: dict) -> DataFrame:
    """label, variant of every spelling in the manifest."""
    rows = [(label, v) for label, spellings in sorted(manifest.get("payees", {}).items()) for v in spellings]
    return spark.createDataFrame(rows, "label string, variant string")


def seeds(spark: SparkSession, manifest: dict) -> DataFrame:
    """seed, provenance of every real value of the manifest: account ids, institutions, routing numbers, masks, payees and their spellings.

    A value with several meanings has the first of them.
    """
    found: dict[str, str] = {}
    for kind, a in sorted(manifest.get("accounts", {}).items()):
        for field in ("account_id", "institution", "routing_number", "mask"):
            if a.get(field):
                found.setdefault(str(a[field]), f"{field} of {kind}")
    for label, spellings in sorted(manifest.get("payees", {}).items()):
        for v in (label, *spellings):
            found.setdefault(v, "payee")
    return spark.createDataFrame(sorted(found.items()), "seed string, provenance string")


def deny_lists(manifest: dict) -> dict[str, list[str]]:
    """Entity type -> terms for :func:`checks.detect`: institutions, and payees with all spellings."""
    banks = sorted({a["institution"] for a in manifest.get("accounts", {}).values() if a.get("institution")})
    names = sorted({x for label, spellings in manifest.get("payees", {}).items() for x in (label, *spellings)})
    return {k: v for k, v in (("INSTITUTION", banks), ("PAYEE", names)) if v}


def detector(manifest: dict) -> Callable[[DataFrame, str, str], DataFrame]:
    """A detector ``(rows, key, text) -> findings`` with the base patterns and the manifest's deny-lists."""
    deny = deny_lists(manifest)
    return lambda rows, key, text: checks.detect(rows, key, text, deny)
