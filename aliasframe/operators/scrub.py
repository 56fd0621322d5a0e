"""Instruction-shaped text in third-party memos: found by rules, replaced as merged spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import merge_spans, replace_spans, spans

PLACEHOLDER = "[scrubbed]"

# ---- fixed values: the rules' words and shapes --------------------------------------------------------
RULES: tuple[tuple[str, str], ...] = (
    ("override", r"(?i)\b(?:ignore|disregard|forget|override|discard|skip|bypass|reveal|print|output|dump|send|email|export|leak|exfiltrate|disclose|respond|reply|repeat|say|write|act|pretend|become|behave)\b[^.\n]{0,40}?\b(?:previous|prior|preceding|above|earlier|foregoing|everything|all|any|the)\b[^.\n]{0,40}?\b(?:instruction|instructions|prompt|prompts|context|rule|rules|direction|directions|command|commands|message|messages|guardrail|guardrails)\b"),
    ("override", r"(?i)\b(?:ignore|disregard|forget|discard|override|skip|bypass)\b\s+(?:everything|all|the\s+text|the)?\s*(?:above|before|prior|preceding|foregoing|so\s+far|earlier)\b"),
    ("role_hijack", r"(?i)\byou\s+are\s+(?:now\s+)?(?:a|an|the)?[^.\n]{0,60}"),
    ("role_hijack", r"(?i)\b(?:act|behave)\s+as\s+(?:an?\s+)?[^.\n]{0,40}"),
    ("role_hijack", r"(?i)\bpretend\s+(?:to\s+be|that\s+you)\b[^.\n]{0,40}"),
    ("fake_directive", r"(?i)\b(?:new|updated|revised|real|actual|following|these)\s+(?:instruction|instructions|prompt|prompts|directive|directives|rule|rules|command|commands)\b\s*:?"),
    ("fake_directive", r"(?i)\bsystem\s+prompt\b\s*:?"),
    ("exfiltration", r"(?i)\b(?:reveal|print|output|dump|send|email|export|leak|exfiltrate|disclose|list|show)\b[^.\n]{0,30}?\b(?:password|passwords|secret|secrets|api\s*keys?|account\s+numbers?|mapping\s+table|credentials?|ssn|social\s+security|private\s+keys?|routing\s+numbers?|card\s+numbers?)\b[^.\n]{0,30}"),
    ("role_marker", r"(?im)(?:(?<=^)|(?<=[\s.>|\]]))(?:system|assistant|user|human|ai)\s*:"),
    ("control_token", r"(?i)<\|?\s*(?:im_start|im_end|endoftext|system|user|assistant|eot_id|start_header_id|end_header_id)\s*\|?>"),
    ("control_token", r"(?i)\[/?\s*INST\s*\]"),
    ("control_token", r"(?i)<</?\s*SYS\s*>>"),
    ("fence", r"`{3,}|~{3,}"),
)


def hits(text: Column) -> Column:
    """ARRAY<STRUCT<kind, start, end, raw>> of all rules' matches, in the rules' order."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(spans(text, pattern), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["raw"].alias("raw")))

    return F.concat(*[of(kind, pattern) for kind, pattern in RULES])


def tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"\s+([.,;:])", "$1"))


def scrub(rows: DataFrame, text: str, out: str = "scrubbed") -> DataFrame:
    """Add ``{out}`` and ``{out}_hits``. Texts without a hit stay as they are, null stays null."""
    any_rule = F.lit(False)
    for _, p in RULES:
        any_rule = any_rule | F.col(text).rlike(p)
    found = rows.withColumn(f"{out}_hits", F.when(any_rule, hits(F.col(text))).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,raw:string>>")))
    clean = tidy(replace_spans(F.col(text), merge_spans(F.col(f"{out}_hits")), F.lit(PLACEHOLDER)))
    return found.withColumn(out, F.when(F.size(f"{out}_hits") > 0, clean).otherwise(F.col(text)))
