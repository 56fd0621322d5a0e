"""Outbound redaction and inbound rendering of free text."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ALIAS, lexicon_key, significant_tokens, spans, token_number, variant_key
from ..session import checkpoint
from . import aliases

# ---- fixed values: words that open sentences and fill questions, never an entity by themselves -----------
COMMON = frozenset(
    """A AN THE THIS THAT THESE THOSE AND OR BUT NOR SO YET FOR HOW WHAT WHEN WHERE WHY WHO WHICH WHOSE WHOM I ME MY MINE WE
    US OUR OURS YOU YOUR YOURS HE HIM HIS SHE HER IT ITS THEY THEM THEIR THEIRS IS ARE WAS WERE AM BE BEEN BEING DO DOES
    DID DONE HAS HAVE HAD HAVING CAN COULD SHALL SHOULD WILL WOULD MAY MIGHT MUST NEED TO OF IN ON AT BY WITH FROM INTO
    ONTO OVER UNDER ABOUT AS THAN THEN OUT UP SHOW TELL GIVE LIST FIND GET SEE CHECK COMPARE SPEND SPENT SPENDING PAY
    PAID PAYS BUY BOUGHT BUYING COST COSTS COSTING SAVE SAVED TOTAL TOTALS BALANCE BALANCES TRANSACTION TRANSACTIONS
    MUCH MANY MORE MOST LESS LEAST LAST NEXT MONTH MONTHS YEAR YEARS WEEK WEEKS DAY DAYS TODAY YESTERDAY TOMORROW AGO
    FAR NOW RECENT RECENTLY DOLLARS DOLLAR USD CENTS AMOUNT AMOUNTS AVERAGE JANUARY FEBRUARY MARCH APRIL JUNE JULY
    AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER MONDAY TUESDAY WEDNESDAY THURSDAY FRIDAY SATURDAY SUNDAY""".split()
)
_WORD = re.compile("[A-Za-z0-9]+")
PROPER = r"(?<![A-Za-z0-9])[A-Z][A-Za-z0-9'&.]*(?:\s+[A-Z][A-Za-z0-9'&.]*)*(?![A-Za-z0-9])"


def lens(rows: DataFrame, key: str, text: str, mapping: DataFrame) -> DataFrame:
    """``key``, text with every known token rendered as its head's real value, and ``substituted``.

    Unknown tokens stay as they are, byte by byte. Tokens of all texts meet the mapping in one equi-join; only ids and tokens
    are shuffled for it, and texts without a token take no part.
    """
    at = aliases.heads(mapping).join(mapping.select(F.col("alias_token").alias("head"), "real_value"), "head").select("token", "real_value")
    some = rows.where(F.col(text).rlike(ALIAS)).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(ALIAS), F.lit(0))).alias("i", "raw"))
    n = F.regexp_extract("raw", r"(\d+)", 1).try_cast("bigint").cast("string")
    found = some.withColumn("token", F.concat_ws("-", F.upper(F.regexp_extract("raw", "^([A-Za-z]+)", 1)), n)).join(at, "token")
    grouped = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "real_value"))).alias("__by"), F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda s: s["token"]).alias("substituted"))
    out = rows.select(key, text).join(grouped, key, "left")
    hits = F.regexp_extract_all(text, F.lit(ALIAS), F.lit(0))
    gaps = F.split(text, ALIAS, -1)
    shown = F.transform(hits, lambda h, i: F.coalesce(F.try_element_at(F.col("__by"), i), h))
    whole = F.array_join(F.zip_with(gaps, F.concat(shown, F.array(F.lit(""))), lambda g, h: F.concat(g, h)), "")
    none = F.array().cast("array<string>")
    return out.select(key, F.when(F.col("__by").isNotNull(), whole).otherwise(F.col(text)).alias("rendered"), F.coalesce("substituted", none).alias("substituted"))


def _phrases(batches):
    """(key, text, starts) -> every word sequence of a text that a surface with the same first word and length may equal."""
    for batch in batches:
        keys, texts, wanted = (batch.column(i) for i in range(3))
        at, begin, stop, phrase = [], [], [], []
        for row, (text, starts) in enumerate(zip(texts.to_pylist(), wanted.to_pylist(), strict=True)):
            sizes: dict[str, list[int]] = {}
            for x in starts:
                sizes.setdefault(x["first"], []).append(x["n"])
            found = [*_WORD.finditer(text)]
            words = [m[0].lower() for m in found]
            for i, w in enumerate(words):
                for n in sizes.get(w, ()):
                    if i + n <= len(words):
                        at.append(row)
                        begin.append(found[i].start())
                        stop.append(found[i + n - 1].end())
                        phrase.append(" ".join(words[i : i + n]))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), pa.array(begin, pa.int32()), pa.array(stop, pa.int32()), pa.array(phrase, pa.string())], names=["key", "start", "end", "phrase"])


def lexicon_hits(rows: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``key, start, end, token`` of the lexicon's surfaces in the texts, leftmost longest, no overlap.

    ``lexicon(surface, token)``; surfaces are compared as sequences of words in any case. The distinct words of the texts
    meet the first words of the surfaces in one equi-join; only where they meet are word sequences made, and these meet
    the surfaces in another. Neither side is broadcast or collected. A surface with several tokens gives the least.
    """
    words = F.filter(F.split(lexicon_key(F.col("surface")), "[^a-z0-9]+"), lambda w: w != "")
    entry = lexicon.where(F.col("surface").isNotNull()).select(words.alias("words"), "token").where(F.size("words") > 0)
    entry = entry.select(F.array_join("words", " ").alias("phrase"), F.col("words")[0].alias("first"), F.size("words").alias("n"), "token").groupBy("phrase", "first", "n").agg(F.min("token").alias("token"))
    firsts = entry.select("first", "n").distinct()
    said = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))).alias("first"))
    starts = said.join(firsts, "first").groupBy("key").agg(F.collect_set(F.struct("first", "n")).alias("starts"))
    kind = rows.schema[key].dataType.simpleString()
    tried = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).join(starts, "key").select("key", "text", "starts").mapInArrow(_phrases, f"key {kind}, start int, end int, phrase string")
    met = tried.join(entry.select("phrase", "token"), "phrase")
    found = met.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("less"), "token"))).alias("all"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,less:int,token:string>>").alias("kept"))
    kept = F.aggregate("all", none, lambda a, x: F.when(x["start"] >= a["at"], F.struct((-x["less"]).alias("at"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    return found.select(F.col("key").alias(key), F.explode(kept).alias("s")).select(key, F.col("s.start").alias("start"), (-F.col("s.less")).alias("end"), F.col("s.token").alias("token"))


def redact(rows: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """``key``, ``redacted`` and ``substitutions`` ARRAY<STRUCT<start, end, token>>; texts without a known surface stay as they are."""
    found = lexicon_hits(rows, key, text, lexicon).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("substitutions"))
    out = rows.select(key, text).join(found, key, "left")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rebuilt = F.aggregate("substitutions", zero, lambda a, s: F.struct(F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), s["token"]).alias("out"), s["end"].alias("at")), lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    return out.select(key, F.when(F.col("substitutions").isNotNull(), rebuilt).otherwise(F.col(text)).alias("redacted"), F.coalesce("substitutions", none).alias("substitutions"))


def warnings(rows: DataFrame, key: str, text: str, covered: DataFrame | None = None, matcher: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``key, start, end, surface, reason`` of capitalised mentions that are neither covered nor ordinary words nor known to the matcher.

    ``covered(key, substitutions)`` as from :func:`redact`: a mention that overlaps a substitution is known. ``matcher`` takes ``mention`` and gives the mentions it
    can resolve (see :func:`resolve.match`).
    """
    runs = rows.where(F.col(text).rlike("[A-Z]")).select(key, F.explode(spans(F.col(text), PROPER)).alias("s"))
    words = F.filter(F.split(F.upper(F.col("s.raw")), "[^A-Z0-9]+"), lambda w: w != "")
    odd = runs.where(~F.forall(words, lambda w: w.isin(sorted(COMMON))))
    if covered is not None:
        odd = odd.join(covered.select(key, "substitutions"), key, "left")
        odd = odd.where(~F.coalesce(F.exists("substitutions", lambda c: (F.col("s.start") < c["end"]) & (c["start"] < F.col("s.end"))), F.lit(False)))
    odd = odd.select(key, F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("end"), F.col("s.raw").alias("surface"))
    if matcher is not None:
        odd = checkpoint(odd)
        known = matcher(odd.select(F.col("surface").alias("mention")).distinct()).select(F.col("mention").alias("surface")).distinct()
        odd = odd.join(known, "surface", "left_anti")
    return odd.select(key, "start", "end", "surface", F.lit("unresolved-entity").alias("reason"))


def surfaces(raw: DataFrame, mapping: DataFrame, variants: DataFrame) -> DataFrame:
    """surface, token for outbound redaction.

    Real values of literal classes; labels and recorded spellings of payees; and of every raw payee that is recorded both the text as it came and the phrase of its
    telling words, which is how a person would say it. Where spellings of several payees give one phrase the row that came last wins, and a payee wins over a literal.
    """
    at = aliases.heads(mapping)
    literal = mapping.where(F.col("entity_type") != "PAYEE").join(at, F.col("alias_token") == F.col("token")).select(F.col("real_value").alias("surface"), F.col("head").alias("token"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("seen"))
    named = mapping.where(F.col("entity_type") == "PAYEE").join(at, F.col("alias_token") == F.col("token")).select(F.col("real_value").alias("surface"), F.col("head").alias("token"), F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("seen"))
    spelt = variants.join(at, F.col("alias_token") == F.col("token")).select("variant", F.col("head").alias("token"))
    said = raw.where(F.coalesce("raw_payee", F.lit("")) != "").groupBy("raw_payee").agg(F.max("id").cast("bigint").alias("seen")).withColumn("variant", variant_key(F.col("raw_payee"))).join(spelt, "variant")
    phrase = F.array_join(significant_tokens(F.col("raw_payee")), " ")
    spoken = said.select(F.explode(F.array("raw_payee", F.nullif(phrase, F.lit("")))).alias("surface"), "token", F.lit(2).alias("rank"), "seen")
    every = literal.unionByName(named).unionByName(spelt.select(F.col("variant").alias("surface"), "token", F.lit(1).alias("rank"), F.lit(0).cast("bigint").alias("seen"))).unionByName(spoken)
    best = every.where(F.col("surface").isNotNull()).groupBy(lexicon_key(F.col("surface")).alias("surface")).agg(F.max_by("token", F.struct("rank", "seen", F.negative(token_number(F.col("token"))))).alias("token"))
    return best
