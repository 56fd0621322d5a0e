"""Amounts as statements write them -> exact decimals, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?$"


def _bare(text: Column) -> tuple[Column, Column]:
    """The digits of a written amount, and whether a mark makes it negative."""
    t = F.regexp_replace(text, r"(?Us)^\s*\((.*)\)\s*$", "$1")
    t = F.regexp_replace(t, r"(?Ui)(?:CR|DR)\s*$", "")
    t = F.regexp_replace(t, r"(?U)-\s*$", "")
    negative = text.rlike(r"(?Usi)^\s*\(.*\)\s*$|DR\s*\)?\s*$|-\s*(?:CR|DR)?\s*\)?\s*$")
    return F.regexp_replace(t, r"(?U)[,\s$£€]", ""), negative


def parse_amount(text: Column) -> Column:
    """DOUBLE of an amount: parentheses, a trailing DR or a trailing minus make it negative.

    Null for null, blank, non-numeric and non-finite text.
    """
    digits, negative = _bare(text)
    value = F.when(digits.rlike(_NUMBER), F.regexp_replace(digits, "_", "").try_cast("double"))
    value = F.when(F.abs(value) < F.lit(float("inf")), value)
    return F.when(negative, -F.abs(value)).otherwise(value)


def parse_money(text: Column) -> Column:
    """DECIMAL(18,2) of an amount, rounded half-even; null where :func:`parse_amount` is null."""
    return F.bround(parse_amount(text).try_cast("decimal(28,6)"), 2).try_cast("decimal(18,2)")


def cents(value: Column) -> Column:
    """BIGINT cents of a DOUBLE, rounded half-even."""
    return F.bround(value * 100).cast("bigint")


def number_kind(text: Column) -> Column:
    """``decimal``, ``whole`` or ``text``; marks of currency, sign and thousands don't count. Null for blank."""
    digits, _ = _bare(text)
    return (
        F.when(F.trim(text) == "", F.lit(None))
        .when(digits.rlike(r"^[+-]?\d+$"), "whole")
        .when(digits.rlike(r"^[+-]?(\d+\.\d*|\.\d+)$"), "decimal")
        .when(text.isNotNull(), "text")
    )
