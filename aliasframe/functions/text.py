"""Keys, tokens and checks of short texts, as Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instants import let

# ---- fixed values -------------------------------------------------------------------------------------
CLASSES = ("PAYEE", "ACCT", "INST", "PERSON", "CARD")
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP SEPT OCT NOV DEC".split()
FILLER = (
    "SEATTLE SEA KENT LOS GATOS SAN FRANCISCO MKT MARKET STORE WHSE WHOLESALE COM US BILL ONLINE ORDER OIL GAS SERVICE STATION CABLE COMM"
    " UTILITY PMT PAYMENT MEXICAN GRILL TRIP HELP EATS MKTP QPS CORP PAYROLL PPD PROPERTY MGMT RENT AUTOPAY THANK YOU INC CO LLC LTD THE"
).split()
NOISE = sorted({*STATES, *MONTHS, *FILLER})
ALIAS = r"(?i)(?<![A-Za-z0-9])(?:PAYEE|ACCT|INST|PERSON|CARD)[-_ ]\d+(?:['’]?s)?(?![0-9])"
ALIAS_EXACT = r"^(?:PAYEE|ACCT|INST|PERSON|CARD)-[1-9][0-9]*$"


def collapse(text: Column) -> Column:
    """Runs of white space to one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def variant_key(text: Column) -> Column:
    return F.upper(collapse(text))


def lexicon_key(text: Column) -> Column:
    return F.lower(collapse(text))


def header_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def significant_tokens(memo: Column) -> Column:
    """Upper-case tokens in order, without short ones, ones with digits, states, months and filler."""
    parts = F.split(F.upper(memo), "[^A-Za-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.rlike("[0-9]") & ~t.isin(NOISE))


def memo_tokens(memo: Column) -> Column:
    """Significant tokens, or the memo's letters run together (``UNKNOWN`` without any)."""
    tokens = significant_tokens(memo)
    letters = F.nullif(F.regexp_replace(F.upper(memo), "[^A-Z]", ""), F.lit(""))
    return F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.coalesce(letters, F.lit("UNKNOWN"))))


def acronym(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.left(t, F.lit(1))), "")


def display_label(memo: Column, brand: Column) -> Column:
    """Brand tokens as a title; without any, the collapsed memo, or ``Unknown Payee``."""
    plain = F.nullif(collapse(memo), F.lit(""))
    return F.when(F.size(brand) > 0, F.array_join(F.transform(brand, F.initcap), " ")).otherwise(F.coalesce(plain, F.lit("Unknown Payee")))


def canonical(cls: Column, n: Column) -> Column:
    """``CLASS-n``; null for an unknown class or a number below 1."""
    return F.when(F.upper(cls).isin(*CLASSES) & (n >= 1), F.concat_ws("-", F.upper(cls), n.cast("string")))


def is_canonical(value: Column) -> Column:
    return F.coalesce(value.rlike(ALIAS_EXACT), F.lit(False))


def token_number(token: Column) -> Column:
    return F.coalesce(F.regexp_extract(token, "-([0-9]+)$", 1).try_cast("bigint"), F.lit(0))


def figure(value: Column) -> Column:
    """An amount as a reply writes it: signed, two decimals."""
    return F.format_string("%+.2f", value.cast("double"))


def shows_figure(text: Column, value: Column) -> Column:
    """Whether a text holds the amount as :func:`figure` writes it or, if it is whole, as a whole number."""
    whole = F.when(value == F.floor(value), F.contains(text, F.floor(value).cast("bigint").cast("string"))).otherwise(False)
    return F.coalesce(F.contains(text, figure(value)) | whole, F.lit(False))


def aba_valid(digits: Column) -> Column:
    """Nine digits whose weighted sum (3, 7, 1, again and again) is a multiple of ten."""
    weights = F.array(*[F.lit(w) for w in (3, 7, 1) * 3])
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda s, i: s + F.substring(digits, i, F.lit(1)).try_cast("int") * F.element_at(weights, i))
    return F.when(digits.rlike("^[0-9]{9}$"), total % 10 == 0).otherwise(False)


def luhn_valid(digits: Column) -> Column:
    return F.when(digits.rlike("^[0-9]+$"), F.call_function("luhn_check", digits)).otherwise(False)


# ---- spans --------------------------------------------------------------------------------------------


def spans(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, raw>> of all matches, left to right, offsets in characters from 0."""
    none = F.array().cast("array<struct<start:int,end:int,raw:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("got"))
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def of(found: Column) -> Column:  # bound once: the fold reads it at every step
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(found["gaps"], i))
            hit = F.get(found["hits"], i)
            return F.struct((start + F.length(hit)).alias("at"), F.concat(acc["got"], F.array(F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("raw")))).alias("got"))

        steps = F.sequence(F.lit(0), F.size(found["hits"]) - 1)
        return F.when(F.size(found["hits"]) > 0, F.aggregate(steps, zero, step, lambda a: a["got"])).otherwise(none)

    return let(both, of)


def merge_spans(found: Column) -> Column:
    """Overlapping and touching (start, end) spans merged, in order; works on ARRAY<STRUCT<start, end, ...>>."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= F.try_element_at(acc, F.lit(-1))["end"], joined).otherwise(F.concat(acc, F.array(s)))

    def safe(acc: Column, s: Column) -> Column:
        return F.when(F.size(acc) == 0, F.array(s)).otherwise(step(acc, s))

    return F.aggregate(ordered, none, safe)


def replace_spans(text: Column, merged: Column, by: Column) -> Column:
    """The text with every span of a sorted, disjoint list replaced."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.concat(acc["out"], kept, by).alias("out"), s["end"].alias("at"))

    return F.aggregate(merged, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def alias_matches(text: Column) -> Column:
    """ARRAY<STRUCT<cls, n, token>> of the alias tokens in a text; a number 0 is no token."""
    hits = F.regexp_extract_all(text, F.lit(ALIAS), F.lit(0))
    parts = F.transform(hits, lambda h: F.struct(F.upper(F.regexp_extract(h, "^([A-Za-z]+)", 1)).alias("cls"), F.regexp_extract(h, r"(\d+)", 1).try_cast("bigint").alias("n")))
    return F.transform(F.filter(parts, lambda p: p["n"] > 0), lambda p: F.struct(p["cls"].alias("cls"), p["n"].alias("n"), F.concat_ws("-", p["cls"], p["n"].cast("string")).alias("token")))
