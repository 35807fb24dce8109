"""Moments in whatever notation a source used, read exhaustively and converted to one UTC instant.

Reading is a plain Python function over one string, run in Arrow batches and only over *distinct* strings
(see ``operators.timestamps``); the rest (dictionary, joins, formatting) is built-in column expressions.
"""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Month names in German, English and French, in full or as usually shortened, by number.
MONTHS = {
    1: "januar jänner jan january janvier janv",
    2: "februar feber feb february février fevrier fév",
    3: "märz maerz mrz mär mar march mars",
    4: "april apr avril avr",
    5: "mai may",
    6: "juni jun june juin",
    7: "juli jul july juillet juil",
    8: "august aug août aout",
    9: "september sept sep septembre",
    10: "oktober okt october oct octobre",
    11: "november nov novembre",
    12: "dezember dez december dec décembre decembre déc",
}

# Names of zones in their usual European or US meaning, in minutes east of UTC.
ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60,
    "cest": 120, "mesz": 120, "eet": 120, "oez": 120, "eest": 180, "oesz": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "jst": 540,
}

#: Marks that stand for "nothing given".
ABSENT = ("", "-", "--", "–", "null", "none", "n/a", "na", "k. a.", "k.a.", "nil")

_ZONE = r"(?: ?(?P<zone>z|utc?|gmt|[a-z]{3,4}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?))?(?: ?\[[a-z_/+-]+\])?(?: ?\([a-z ]+\))?"
_TIME = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,]\d+)?)?(?: ?(?P<half>[ap])\.?m\.?)?(?: ?uhr)?" + _ZONE
_DAYNAME = r"(?:[a-zäöüéèû]+(?:[.,]+ ?| ))?"

#: One anchored pattern per notation, over the lower-cased string with single blanks.
NOTATIONS = tuple(
    re.compile(p)
    for p in (
        # 2024-06-06T08:11:28.5+02:00, 2024-02-07, 2025-02-03 18:30:10 UTC
        r"(?P<y>\d{4})[-/.](?P<mo>\d{1,2})[-/.](?P<d>\d{1,2})(?:(?:t|,? um |,? | - )" + _TIME + ")?",
        # 20241027T024608Z
        r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:t?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,]\d+)?" + _ZONE + ")?",
        # Sun, 28 Jan 2024 02:53:29 +0100; 13. Januar 2024, 14:18; Wednesday, 10-Jan-24 14:55:25 GMT
        _DAYNAME + r"(?:den )?(?P<d>\d{1,2})(?:\.|st|nd|rd|th|er)?[ -]*(?:of |de )?(?P<mo>[a-zäéû]{3,})\.?,?[ -]*(?P<y>\d{4}|\d{2})(?:,?(?: -)? (?:um |at |à )?" + _TIME + ")?",
        # May 29, 2024 9:31 AM
        _DAYNAME + r"(?P<mo>[a-zäéû]{3,})\.? (?P<d>\d{1,2})(?:st|nd|rd|th)?,? (?P<y>\d{4})(?:,? (?:at )?" + _TIME + ")?",
        # Sun Jan 28 02:53:29 2024
        r"[a-z]{2,}\.?,? (?P<mo>[a-z]{3,})\.? (?P<d>\d{1,2}) (?P<h>\d{1,2}):(?P<mi>\d{2}):(?P<s>\d{2})(?: (?P<zone>[a-z]{1,4}))? (?P<y>\d{4})",
        # 29.09.24 18:22; 29/08/2024 17:07; 27.03.2022 - 02.07 Uhr
        _DAYNAME + r"(?P<d>\d{1,2})(?P<sep>[./-]) ?(?P<mo>\d{1,2})(?P=sep) ?(?P<y>\d{4}|\d{2})(?:,?(?: -)? (?:um |at )?" + _TIME + ")?",
    )
)

_MONTH = {name: number for number, names in MONTHS.items() for name in names.split()}
_IGNORED = dict.fromkeys(map(ord, "\ufeff\u200b\u200e\u200f\u2060"))


def tidy(raw: str) -> str:
    """Lower case, every run of blanks as one, none at the ends, no invisible characters."""
    return " ".join(raw.translate(_IGNORED).split()).lower()


def is_absent(raw: str | None) -> bool:
    """Whether a value is null, blank or one of the marks for nothing."""
    return raw is None or tidy(raw) in ABSENT


@lru_cache(4096)
def _zone(name: str) -> dt.tzinfo | None:
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


def zone_or(name: str | None, default: str) -> str:
    """``name`` if it is that of a zone, else ``default``."""
    return name.strip() if name and name.strip() and _zone(name.strip()) else default


def offset(name: str) -> int | None:
    """Minutes east of UTC of an abbreviation or a numeric offset; null if it means nothing."""
    m = re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?", name)
    if not m:
        return ZONES.get(name)
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    if minutes > 18 * 60:
        return None
    return -minutes if m[1] == "-" else minutes


def _matched(text: str) -> dict | None:
    return next((m.groupdict() for p in NOTATIONS if (m := p.fullmatch(text))), None)


def _date(m: dict) -> dt.date | None:
    month = _MONTH.get(m["mo"]) or (int(m["mo"]) if m["mo"].isdigit() else 0)
    year = int(m["y"]) + 2000 * (len(m["y"]) == 2)
    try:
        return dt.date(year, month, int(m["d"]))
    except ValueError:
        return None


def written_day(raw: str | None) -> dt.date | None:
    """The calendar day a value names, as it is written (no conversion between zones); else null."""
    m = None if raw is None else _matched(tidy(raw))
    return m and _date(m)


_EPOCH = dt.datetime(1970, 1, 1)


def seconds_utc(raw: str | None, zone: str) -> int | None:
    """Seconds since 1970 UTC of the moment that ``raw`` names, or null if it names none.

    ``zone``: the zone of a time that names none. A bare date is midnight UTC. A local time that occurs
    twice is the earlier instant; one that is skipped is read with the offset before the change. Impossible
    dates and times, bare years, words and null name no moment.
    """
    if raw is None:
        return None
    text = tidy(raw)
    if text.isascii() and text.isdigit() and len(text) in (10, 13):
        return int(text) // (1 if len(text) == 10 else 1000)
    m = _matched(text)
    day = m and _date(m)
    if not day:
        return None
    if m.get("h") is None:
        return (day - _EPOCH.date()).days * 86400
    hour = int(m["h"])
    if m.get("half"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (m["half"] == "p")
    try:
        local = dt.datetime(day.year, day.month, day.day, hour, int(m["mi"]), int(m.get("s") or 0))
        if m.get("zone"):
            minutes = offset(m["zone"])
            if minutes is None:
                return None
            east = dt.timedelta(minutes=minutes)
        else:
            east = local.replace(tzinfo=_zone(zone)).utcoffset()
    except (ValueError, OverflowError):
        return None
    return round((local - east - _EPOCH).total_seconds())


@F.pandas_udf(T.LongType())
def seconds_of(raw: pd.Series, zone: pd.Series) -> pd.Series:
    """``seconds_utc`` over columns."""
    return pd.Series([seconds_utc(r, z) for r, z in zip(raw, zone, strict=True)], dtype="Int64")


_RFC_2822 = re.compile(r"(?:(?P<wd>mon|tue|wed|thu|fri|sat|sun) ?, ?)?(?P<d>\d{1,2}) (?P<mo>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) (?P<y>\d{2,4}) (?P<h>\d{2}):(?P<mi>\d{2})(?::(?P<s>\d{2}))? (?P<zone>[+-]\d{4}|[a-z]+)(?: ?\([^()]*\))?")
_RFC_3339 = re.compile(r"(?P<y>\d{4})-(?P<mo>\d{2})-(?P<d>\d{2})[t ](?P<h>\d{2}):(?P<mi>\d{2}):(?P<s>\d{2})(?:\.\d+)?(?P<zone>z|[+-]\d{2}:\d{2})")


def feed_seconds(raw: str | None) -> int | None:
    """Seconds since 1970 UTC of a feed's date, written as in RFC 2822 or RFC 3339; null for any other form.

    Blanks around it are ignored. A day of the week must be that of the date, two-digit years are 1950 to 2049, three-digit
    ones count from 1900. A single letter is UTC, other names of zones have their usual meaning.
    """
    text = "" if raw is None else tidy(raw)
    m = _RFC_2822.fullmatch(text) or _RFC_3339.fullmatch(text)
    if not m:
        return None
    year = int(m["y"]) + (0 if len(m["y"]) == 4 else 2000 if len(m["y"]) == 2 and int(m["y"]) < 50 else 1900)
    month = _MONTH.get(m["mo"]) or int(m["mo"])
    minutes = 0 if len(m["zone"]) == 1 and m["zone"] != "j" else offset(m["zone"])
    second = int(m["s"] or 0)
    try:
        local = dt.datetime(year, month, int(m["d"]), int(m["h"]), int(m["mi"])) + dt.timedelta(seconds=second)
    except (ValueError, OverflowError):
        return None
    if minutes is None or second > 60 or m.groupdict().get("wd") and local.strftime("%a").lower() != m["wd"]:
        return None
    return round((local - _EPOCH).total_seconds()) - minutes * 60


@F.pandas_udf(T.LongType())
def feed_seconds_of(raw: pd.Series) -> pd.Series:
    """``feed_seconds`` over a column."""
    return pd.Series([feed_seconds(r) for r in raw], dtype="Int64")


@F.pandas_udf(T.StringType())
def day_or_raw(raw: pd.Series) -> pd.Series:
    """A day in any notation as ``YYYY-MM-DD``; null if absent; else the tidied string, so that nothing is lost."""
    known: dict[str, str | None] = {}

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        if x not in known:
            known[x] = None if is_absent(x) else str(written_day(x) or tidy(x))
        return known[x]

    return raw.map(one)


@F.pandas_udf(T.StringType())
def known_zone(zone: pd.Series, default: pd.Series) -> pd.Series:
    """``zone_or`` over columns."""
    return pd.Series([zone_or(z, d) for z, d in zip(zone, default, strict=True)], dtype="object")


def utc_text(seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ`` of seconds since 1970 UTC, whatever the session's zone."""
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400)).cast("int")
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(rest / 60) % 60), two(rest % 60))
    return F.when(seconds.isNotNull(), F.concat(day, F.lit("T"), clock, F.lit("Z")))
