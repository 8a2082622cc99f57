"""Date expressions: parsing by shape or format, quarters, display."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import PlanError

# Shapes of the dates that are read without a stated format. The two usual ones, in ISO order and
# numeric with the year last, become ISO text and are cast.
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
YEAR_FIRST = rf"^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}([ T]{_CLOCK}Z?)?$"
YEAR_LAST = rf"^(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}})((?:[ T]{_CLOCK})?)$"
SHORTEST, LONGEST = len("1/1/00"), 64
# What every date looks like: it begins with a digit or a letter, and has a digit.
DATED = r"^[0-9A-Za-z].*[0-9]"

# The others are brought into the form year;month;day;clock;half of the day;zone.
_NAMES = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?"
)
_SEP = r"(?:,? |[-/.])"
_TAIL = rf"(?:(?:[ T]|, ?)({_CLOCK}) ?([ap]m)?)? ?(z|utc|gmt|[+-]\d{{2}}:?\d{{2}})?$"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
MONTH_FIRST = (rf"(?i)^({_NAMES})\.?[ -]{_DAY}{_SEP}(\d{{4}}|\d{{2}}){_TAIL}", "$3;$1;$2;$4;$5;$6")
DAY_FIRST = (rf"(?i)^{_DAY}[ .-]({_NAMES})\.?{_SEP}(\d{{4}}|\d{{2}}){_TAIL}", "$3;$2;$1;$4;$5;$6")
NUMERIC = (
    (rf"(?i)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TAIL}", "$1;$2;$3;$4;$5;$6"),
    (rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}}){_TAIL}", "$1;$2;$3;$4;$5;$6"),
    (r"(?i)^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2})(\d{2}(?:\.\d+)?) ?(z|utc|gmt|[+-]\d{2}:?\d{2})?$", "$1;$2;$3;$4:$5:$6;;$7"),
    (r"^(\d{4})[-/](\d{1,2})$", "$1;$2;1;;;"),
)
WEEKDAY = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? +"
NUMERIC_YEAR_LAST = rf"(?i)^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TAIL}"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
FIRST_YEAR = 69

# Strftime code -> Spark pattern letters, for output formats given in strftime notation.
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD",
    "%-m": "M", "%-d": "d", "%-H": "H", "%-I": "h", "%-M": "m", "%-S": "s", "%-j": "D",
    "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%D": "MM/dd/yy", "%R": "HH:mm",
}


def parse_date(c: Column, formats: tuple[str, ...] | None = None, dayfirst: bool = False) -> Column:
    """Text as a zone-free timestamp; null when it is no date. A time with a zone becomes UTC.

    ``formats`` are Spark patterns tried in order. Without them the shape of the text decides, so a
    text that is no date costs a few failed matches and no parser exception. Numeric dates with the
    year last have one reading per call: mixing both would turn 1/2 and 13/2 of a column around.
    Years of two digits lie between 1969 and 2068.
    """
    text = F.trim(c.cast("string"))
    if formats:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")
    iso = "$3-$2-$1$4" if dayfirst else "$3-$1-$2$4"
    numeric = "$3;$2;$1;$4;$5;$6" if dayfirst else "$3;$1;$2;$4;$5;$6"
    named = F.transform(
        F.array(F.regexp_replace(text, WEEKDAY, "")), lambda t: _from_parts(_parts(t, (MONTH_FIRST, DAY_FIRST, *NUMERIC)))
    )[0]
    out = (
        F.when(text.rlike(YEAR_FIRST), F.translate(text, "/Z", "-").try_cast("timestamp_ntz"))
        .when(text.rlike(YEAR_LAST), F.regexp_replace(text, YEAR_LAST, iso).try_cast("timestamp_ntz"))
        .when(text.rlike("^[A-Za-z]"), named)
        .otherwise(_from_parts(_parts(text, ((NUMERIC_YEAR_LAST, numeric), *NUMERIC, DAY_FIRST))))
    )
    return F.when(F.length(text).between(SHORTEST, LONGEST) & text.rlike(DATED), out)


def _parts(text: Column, shapes: tuple) -> Column:
    """``year;month;day;clock;half;zone`` by the first shape that fits."""
    parts = F.lit(None).cast("string")
    for shape, order in reversed(shapes):
        parts = F.when(text.rlike(shape), F.regexp_replace(text, shape, order)).otherwise(parts)
    return parts


def _from_parts(parts: Column) -> Column:
    """The time in UTC of ``year;month;day;clock;half;zone``, of which the last three may be empty."""

    def read(text: Column) -> Column:
        year, month, day, clock, half, zone = (F.split_part(text, F.lit(";"), F.lit(i)) for i in range(1, 7))
        century = F.when(year.cast("int") >= FIRST_YEAR, "19").otherwise("20")
        named = F.position(F.left(F.lower(month), F.lit(3)), F.lit(MONTHS))
        offset = F.when(zone.rlike(r"\d"), F.regexp_replace(zone, r"^(.\d\d):?", "$1:")).otherwise("+00:00")
        seconds = F.when(clock == "", "00:00:00").when(clock.rlike(r"^\d+:\d+$"), F.concat(clock, F.lit(":00"))).otherwise(clock)
        stamp = F.concat(
            F.when(F.length(year) == 2, F.concat(century, year)).otherwise(year), F.lit("-"),
            F.when(month.rlike(r"\d"), month).otherwise(((named + 2) / 3).cast("int").cast("string")), F.lit("-"), day,
            F.lit(" "), seconds, offset,
        ).try_cast("timestamp")
        utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), stamp.cast("timestamp_ntz"))
        hour = F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("int")
        shift = F.when(half.ilike("pm") & (hour < 12), 12).when(half.ilike("am") & (hour == 12), -12).otherwise(0)
        return F.when((half == "") | hour.between(1, 12), utc + F.make_dt_interval(hours=shift))

    return F.transform(F.array(parts), read)[0]


def as_timestamp(c: Column, data_type: T.DataType, dayfirst: bool = False) -> Column:
    """Dates and timestamps as they are, text parsed."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    return parse_date(c, dayfirst=dayfirst)


def strftime(c: Column, pattern: str) -> Column:
    """Format a timestamp by a strftime pattern; other characters stand for themselves."""
    out = []
    for piece in re.findall(r"%-?.|%$|[^%]+", pattern, re.DOTALL):
        if piece in STRFTIME:
            out.append(F.date_format(c, STRFTIME[piece]))
        elif piece == "%%" or not piece.startswith("%"):
            out.append(F.lit("%" if piece == "%%" else piece))
        else:
            raise PlanError(f"Unknown code {piece!r} in the date format {pattern!r}")
    return F.concat(*out) if out else F.lit("")


def quarter_label(c: Column) -> Column:
    """``2026Q1`` for a date or timestamp."""
    return F.concat(F.year(c).cast("string"), F.lit("Q"), F.quarter(c).cast("string"))


def quarter_start(c: Column) -> Column:
    """First day of the quarter as ISO text."""
    return F.date_format(F.trunc(c.cast("date"), "quarter"), "yyyy-MM-dd")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds from ``earlier`` to ``later`` as double, fractions kept."""
    micros = F.timestamp_diff("MICROSECOND", earlier.cast("timestamp_ntz"), later.cast("timestamp_ntz"))
    return micros.cast("double") / F.lit(1e6)


def local_clock(c: Column, zone: str = "Asia/Kolkata") -> Column:
    """``HH:mm`` in a display zone for a UTC time."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz")), "HH:mm")


def iso_text(c: Column) -> Column:
    """Timestamp as ISO 8601 text, with the fraction only where there is one."""
    c = c.cast("timestamp_ntz")
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))
