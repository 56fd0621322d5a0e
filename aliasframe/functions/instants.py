"""Dates and timestamps written in many ways -> one UTC instant, as Column expressions only.

Every written form is one regular expression whose replacement puts the parts into a fixed order
``year|month|day|hour|minute|second|half|zone``; the parts then go through ``try_make_timestamp``,
so an impossible day or clock gives null instead of an error. No Python worker takes part.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,9})?))?"
_ZONE = r"(?:\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{1,2})|\s+([A-Za-z]{2,5}))?"

#: name -> (pattern, replacement). The order is that of frequency; the patterns exclude one another.
FORMS: tuple[tuple[str, str, str], ...] = (
    ("iso_day", r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$", "$1|$3|$4|||||"),
    ("us_day", r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4}|\d{2})$", "$4|$1|$3|||||"),
    ("iso_clock", r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})(?:[Tt]|\s+)" + _CLOCK + _ZONE + "$", "$1|$3|$4|$5|$6|$7||$8$9"),
    ("packed_day", r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3|||||"),
    ("packed_clock", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2}(?:\.\d{1,9})?)(?:\[([+-]?\d{1,2}(?:\.\d{1,2})?)(?::[A-Za-z]{1,5})?\])?$", "$1|$2|$3|$4|$5|$6||$7"),
    ("us_clock", r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4}|\d{2}),?\s+" + _CLOCK + r"(?:\s*([AaPp])\.?[Mm]\.?)?" + _ZONE + "$", "$4|$1|$3|$5|$6|$7|$8|$9$10"),
    ("dotted_day", r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$", "$3|$2|$1|||||"),
    ("dotted_clock", r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2}),?\s+" + _CLOCK + _ZONE + "$", "$3|$2|$1|$4|$5|$6||$7$8"),
    ("day_month_name", r"^(\d{1,2})[- ]([A-Za-z]{3,9})\.?[- ](\d{4}|\d{2})$", "$3|$2|$1|||||"),
    ("month_name_day", r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})$", "$3|$1|$2|||||"),
    ("epoch_seconds", r"^\d{10}$", "||||||||"),
    ("epoch_millis", r"^\d{13}$", "||||||||"),
)

#: Hours east of UTC of the clock names that statements carry.
ZONE_NAMES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 1, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "IST": 5.5,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _offset(hours: float) -> str:
    sign, minutes = ("-" if hours < 0 else "+"), round(abs(hours) * 60)
    return f"{sign}{minutes // 60:02d}:{minutes % 60:02d}"


def form_of(value: Column) -> Column:
    """Name of the written form of a trimmed value; null where none fits."""
    out = None
    for name, pattern, _ in FORMS:
        out = (F.when if out is None else out.when)(value.rlike(pattern), F.lit(name))
    return out


def _parts(value: Column, form: Column) -> Column:
    out = None
    for name, pattern, order in FORMS:
        now = F.lit(order) if name.startswith("epoch") else F.regexp_replace(value, pattern, order)
        out = (F.when if out is None else out.when)(form == name, now)
    return F.split(out, r"\|")


def _month(text: Column) -> Column:
    names = F.create_map(*[x for i, m in enumerate(_MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    return F.coalesce(text.try_cast("int"), F.try_element_at(names, F.lower(F.substring(text, 1, 3))))


def _zone_id(text: Column) -> Column:
    """Zone text of a value -> an id that the JVM knows; null for text that names no zone."""
    names = F.create_map(*[x for k, v in ZONE_NAMES.items() for x in (F.lit(k), F.lit(_offset(v)))])
    hours = text.try_cast("double")
    size = F.round(F.abs(hours) * 60).cast("int")
    from_hours = F.when(
        F.abs(hours) <= 18,
        F.format_string("%s%02d:%02d", F.when(hours < 0, "-").otherwise("+"), (size / 60).cast("int"), size % 60),
    )
    return (
        F.when(text.rlike(r"^[+-]\d{2}:\d{2}$"), text)
        .when(text.rlike(r"^[+-]\d{4}$"), F.concat(F.substring(text, 1, 3), F.lit(":"), F.substring(text, 4, 2)))
        .when(text.rlike(r"^[+-]?\d{1,2}(\.\d+)?$"), from_hours)
        .otherwise(F.try_element_at(names, F.upper(text)))
    )


def with_instant(df, value: str, zone: Column | None = None, prefix: str = ""):
    """Add ``{prefix}form``, ``{prefix}shown_day``, ``{prefix}instant``, ``{prefix}utc_day`` and ``{prefix}needs_zone``.

    ``zone`` is the zone of values that have a clock but state none (null there: UTC). Values with
    no clock keep their day, at midnight UTC. Null, blank and unreadable values, impossible days and
    clocks, and zone texts that name no zone give null in all but ``needs_zone``, which is then false.
    ``{prefix}shown_day`` is null for epoch numbers, which show no calendar day.
    """
    p = lambda name: f"{prefix}{name}"
    own = zone if zone is not None else F.lit(None).cast("string")
    nought = F.lit(0).cast("decimal(16,6)")

    def of_parts(text: Column, form: Column, parts: Column) -> Column:
        at = lambda i: F.nullif(parts[i], F.lit(""))
        year = at(0).try_cast("int")
        year = F.when(F.length(at(0)) > 2, year).when(year >= 69, year + 1900).otherwise(year + 2000)
        half, hour = F.upper(at(6)), at(3).try_cast("int")
        hour = F.when(half.isNull(), hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
        read = F.struct(
            year.alias("year"),
            _month(at(1)).alias("month"),
            at(2).try_cast("int").alias("day"),
            F.when(at(7).isNotNull(), _zone_id(at(7))).otherwise(F.coalesce(own, F.lit("UTC"))).alias("offset"),
        )
        clocked = at(3).isNotNull()
        number = text.try_cast("bigint")

        def of_day(r: Column) -> Column:
            midnight = F.try_make_timestamp(r["year"], r["month"], r["day"], F.lit(0), F.lit(0), nought, F.lit("UTC"))
            second = F.coalesce(at(5).try_cast("decimal(16,6)"), nought)
            clock = F.try_make_timestamp(r["year"], r["month"], r["day"], hour, at(4).try_cast("int"), second, r["offset"])
            instant = (
                F.when(form == "epoch_seconds", F.timestamp_seconds(number))
                .when(form == "epoch_millis", F.timestamp_millis(number))
                .when(clocked, clock)
                .otherwise(midnight)
            )
            return F.struct(instant.alias("instant"), midnight.alias("midnight"))

        def of_instant(r: Column) -> Column:
            good = r["instant"].isNotNull()
            return F.struct(
                F.when(good, form).alias(p("form")),
                r["instant"].alias(p("instant")),
                F.when(good & ~form.startswith("epoch"), utc_day(r["midnight"])).alias(p("shown_day")),
                utc_day(r["instant"]).alias(p("utc_day")),
                F.coalesce(good & clocked & at(7).isNull(), F.lit(False)).alias(p("needs_zone")),
            )

        return let(let(read, of_day), of_instant)

    text = F.trim(F.regexp_replace(F.col(value), r"[\t\r\n ]", " "))
    read = lambda t: let(form_of(t), lambda form: let(_parts(t, form), lambda parts: of_parts(t, form, parts)))
    day = F.col(value).try_cast("date")  # the commonest form has a short way
    plain = F.array(F.struct(
        F.when(day.isNotNull(), F.lit("iso_day")).alias(p("form")),
        F.timestamp_micros(F.unix_date(day) * F.lit(86_400_000_000)).alias(p("instant")),
        day.alias(p("shown_day")),
        day.alias(p("utc_day")),
        F.lit(False).alias(p("needs_zone")),
    ))
    is_plain = F.col(value).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return df.select("*", F.inline(F.when(is_plain, plain).otherwise(F.transform(F.array(text), read))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    The bound value also keeps a long chain of parts out of one generated method: beyond 8,000 bytes of
    bytecode the JVM would only interpret it.
    """
    return F.transform(F.array(value), body)[0]


def bind(df, columns: dict[str, Column]):
    """Add columns that are evaluated once: the optimizer neither copies nor pushes what a generator makes."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def utc_day(instant: Column) -> Column:
    """Calendar day in UTC, whatever the session's zone is."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(instant) / F.lit(86_400_000_000)).cast("int"))
