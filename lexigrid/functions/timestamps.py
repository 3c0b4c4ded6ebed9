"""Problem 4: mixed timestamp formats and time zones to one UTC moment.

Method: a value is tokenised into a character-class shape mask (runs of digits keep their length, month and
weekday names become `M` and `W`, and so on). Each distinct mask is mapped to a parser (an ordered list of
field roles) once in a worker, and the values of a parser are converted together, with NumPy, through zone
transition tables of one tz version. A mask is never a key of a shuffle, so one that a third of all values
share does no harm, and the map of masks is bounded (least recently used ones are dropped and mapped again).

Reading rules: without a zone a value is local time of its site; a day alone means local midnight; a zone
abbreviation other than UTC and GMT is that of the site and only tells standard from summer time where the
local time occurs twice; all-figure dates follow the site's order unless a four-figure year leads;
two-figure years are 20xx; digits beyond microseconds are cut; a local time that occurs twice is its first
occurrence, a skipped one moves on by the gap. Values that name no real day give null.

Defined results: null, blank and relative values are null; an unknown site has no local time, so that only
values with a zone of their own (or an epoch number) are read there; days beyond years 1..9999 are null.
"""

from __future__ import annotations

import functools
import re
from datetime import datetime, timedelta, timezone
from importlib import metadata
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Month names, January to December, in the languages of the sites.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "nl": "januari februari maart april mei juni juli augustus september oktober november december",
    "pl": "stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
}
#: Further written forms of months.
MORE_MONTHS = {
    1: "jan jänner jaen janv ene gen styczeń январь", 2: "feb févr fev luty февраль", 3: "mar mär mrz mrt marzec март", 4: "apr avr abr kwiecień апрель", 5: "mag maj май maio",
    6: "jun czerwiec июнь giu", 7: "jul juil lug lipiec июль", 8: "aug août ago sierpień август", 9: "sep sept set wrzesień сентябрь", 10: "oct okt out ott październik октябрь",
    11: "nov listopad ноябрь", 12: "dec dez dic déc grudzień декабрь",
}
#: Weekday names and their short forms.
WEEKDAYS = (
    "monday tuesday wednesday thursday friday saturday sunday mon tue tues wed thu thur thurs fri sat sun montag dienstag mittwoch donnerstag freitag samstag sonnabend sonntag "
    "lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miércoles jueves viernes sábado domingo lunedì martedì mercoledì giovedì venerdì sabato domenica "
    "segunda terça quarta quinta sexta maandag dinsdag woensdag donderdag vrijdag zaterdag zondag poniedziałek wtorek środa czwartek piątek sobota niedziela "
    "понедельник вторник среда четверг пятница суббота воскресенье"
)


@functools.lru_cache(1)
def month_numbers() -> dict[str, int]:
    out = {}
    for names in MONTHS.values():
        for k, name in enumerate(names.split(), 1):
            out[name] = k
            if len(name) > 3:
                out.setdefault(name[:3], k)
    for k, names in MORE_MONTHS.items():
        for name in names.split():
            out[name] = k
    return out


# what follows runs on Spark columns

def mask(value):
    """The shape mask of a trimmed value: digits 9, month M, weekday W, am/pm P, other letters a."""
    v = F.lower(F.trim(F.regexp_replace(value, r"(?U)[\s​﻿]+", " ")))
    v = F.regexp_replace(v, r"[0-9]", "9")
    alt = lambda names: "|".join(sorted(names, key=lambda x: (-len(x), x)))
    v = F.regexp_replace(v, r"(?<=[0-9\s.])([ap])\.?m\.?(?![\p{L}])", "P")
    v = F.regexp_replace(v, rf"(?<![\p{{L}}])(?:{alt(month_numbers())})(?![\p{{L}}])", "M")
    v = F.regexp_replace(v, rf"(?<![\p{{L}}])(?:{alt(WEEKDAYS.split())})(?![\p{{L}}])", "W")
    return v


#: The token grammar of a value; the same for every value of one mask.
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+(?:\.(?=[^\W\d_])[^\W\d_]+)*|[^\w\s]|_|\s+")
ROLE = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
ZONE_WORD = re.compile(r"(?:[a-z]{1,5}t|utc|gmt|z|msk)")


@functools.lru_cache(100_000)
def parser_of(shape: str) -> str | None:
    """The regular expression (named groups are the fields' roles) that reads all values of a mask, or None.

    Groups: y, mon, d, name, H, M, S, f, p (am/pm), sign, oh, om (offset), zone, u (epoch digits),
    a1 a2 a3 (an all-figure date in site order).
    """
    s = shape
    if re.fullmatch(r"9{10}|9{13}|9{16}|9{10}\.9+", s):
        return r"(?P<u>\d+)(?:\.(?P<uf>\d+))?"
    zone = (
        r"\s*[(\[]?\s*(?:(?P<zone>z|utc|gmt|[a-z]{2,5})(?![a-z]))?\s*(?:(?P<sign>[+\-−])(?P<oh>\d{1,2}):?(?P<om>\d{2})?(?::?\d{2})?)?\s*[)\]]?"
    )
    clock = (
        r"(?P<H>\d{1,2})\s*[:h時时](?P<M>\d{2})\s*分?(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<p>[ap]\.?m\.?)?\s*(?:uhr)?"
    )
    dated = [
        r"(?P<y>\d{4})[-/.](?P<mon>\d{1,2})[-/.](?P<d>\d{1,2})\.?",
        r"(?P<y>\d{4})\s*[年년]\s*(?P<mon>\d{1,2})\s*[月월]\s*(?P<d>\d{1,2})\s*[日일]?",
        r"(?P<name>[^\W\d_]+)\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})",
        r"(?P<d>\d{1,2})(?:st|nd|rd|th|º|°|er)?\.?[\s\-]+(?:de\s+|of\s+)?(?P<name>[^\W\d_]+)\.?,?[\s\-]+(?:de\s+)?(?P<y>\d{4})(?:\s*г\.?)?",
        r"(?P<a1>\d{1,2})[-/.](?P<a2>\d{1,2})[-/.](?P<a3>\d{4}|\d{2})\.?",
    ]
    lead = r"(?:[^\W\d_]+:?\s+)?(?:[^\W\d_]+\.?,?\s+)?"
    link = r"(?:\s*,\s*|\s+-\s+|\s*t\s*|\s+)(?:at\s+|um\s+|à\s+|a las\s+|alle\s+|às\s+|om\s+|o\s+|в\s+)?"
    if re.fullmatch(r"9{8}t9{4}(?:9{2})?.*", s):
        return r"(?P<y>\d{4})(?P<mon>\d{2})(?P<d>\d{2})t(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?:[.,](?P<f>\d+))?" + zone
    if s == "9" * 8:
        return r"(?P<y>\d{4})(?P<mon>\d{2})(?P<d>\d{2})"
    sample = s.replace("M", "may").replace("W", "fri").replace("P", "pm").replace("9", "1")
    for date in dated:
        for expr in (lead + date, lead + date + link + clock + zone, clock + zone + r"\s*,?\s*" + lead + date):
            if ("name" not in date) != ("M" not in s):
                continue
            if re.fullmatch(expr, sample):
                return expr
    return None


# zone transition tables

def tz_version() -> str:
    """The version of the zone tables in use."""
    try:
        return metadata.version("tzdata")
    except metadata.PackageNotFoundError:
        return "system"


@functools.lru_cache(None)
def transitions(zone: str, first: int = 1900, last: int = 2100) -> tuple[np.ndarray, np.ndarray]:
    """(UTC seconds of each change, seconds east of UTC from each on); the first row holds before all changes.

    Found by bisection of the days between which the offset differs; beyond `last` the rules repeat every
    400 years' 28-year cycle is not assumed: such values are read with the last year's offsets.
    """
    tz = ZoneInfo(zone)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    offset = lambda s: int((epoch + timedelta(seconds=s)).astimezone(tz).utcoffset().total_seconds())
    lo, hi = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) for y in (first, last + 1))
    at, off, s, cur = [-(2**62)], [offset(lo)], lo, offset(lo)
    while s < hi:
        e = min(hi, s + 7 * 86400)
        nxt = offset(e)
        if nxt != cur:
            a, b = s, e
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if offset(m) == cur else (a, m)
            at.append(b)
            off.append(offset(b))
            cur = off[-1]
            s = b
            continue
        s = e
    return np.array(at, dtype=np.int64), np.array(off, dtype=np.int64)


def local_to_utc(seconds: np.ndarray, zone: str) -> np.ndarray:
    """UTC seconds of local seconds: the first of two, and past a gap by its length."""
    at, off = transitions(zone)
    before = np.concatenate([off[:1], off[:-1]])
    # a change at `at` shows the clock at+before just before and at+off just after; up to the later of both
    # (a gap) or the later (a repeat) the offset before the change holds
    edge = at + np.maximum(before, off)
    edge[0] = -(2**62)
    k = np.searchsorted(edge, seconds, side="right") - 1
    return seconds - off[k]


def second_occurrence(seconds: np.ndarray, zone: str) -> np.ndarray:
    """As local_to_utc, but the second of two."""
    at, off = transitions(zone)
    before = np.concatenate([off[:1], off[:-1]])
    edge = at + np.where(off < before, off, np.maximum(before, off))
    edge[0] = -(2**62)
    k = np.searchsorted(edge, seconds, side="right") - 1
    return seconds - off[k]


_DAYS = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days since 1970, is a real day)."""
    ok = (y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1)
    mm = np.where(ok, m, 1)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    ok &= d <= _DAYS[mm - 1] + ((mm == 2) & leap)
    months = (y - 1970) * 12 + mm - 1
    base = np.where(ok, months, 0).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return base + d - 1, ok


def convert(values: pd.Series, parser: str, zones: pd.Series, orders: pd.Series) -> pd.Series:
    """UTC microseconds of the values of one parser (vectorised); None where no day is named."""
    v = values.str.replace(r"[\s​﻿]+", " ", regex=True).str.strip().str.lower()
    got = v.str.extract(f"^(?:{parser})$", expand=True)
    n = len(v)
    none = pd.Series([None] * n, index=values.index, dtype=object)
    has = lambda c: c in got.columns
    num = lambda c, default=0: pd.to_numeric(got[c], errors="coerce").fillna(default).to_numpy(dtype=np.int64) if has(c) else np.full(n, default, dtype=np.int64)
    if has("u"):
        u = got["u"].fillna("")
        micros = [int((x + (f if isinstance(f, str) else "") + "0" * 16)[: 16]) if x else None for x, f in zip(u, got["uf"])]
        return pd.Series(micros, index=values.index, dtype=object)
    matched = got.notna().any(axis=1).to_numpy()
    zone_name = zones.where(zones.notna(), "").to_numpy()
    if has("a1"):
        a1, a2, a3 = num("a1"), num("a2"), num("a3")
        mdy = (orders == "MDY").to_numpy()
        ymd = (orders == "YMD").to_numpy() & (got["a3"].str.len().fillna(0) == 2).to_numpy()
        y, m, d = a3, np.where(mdy, a1, a2), np.where(mdy, a2, a1)
        y, m, d = np.where(ymd, a1, y), np.where(ymd, a2, m), np.where(ymd, a3, d)
        four = (got["a3"].str.len().fillna(0) == 4).to_numpy()
        # in a year-first site a date whose year stands last reads month first
        odd = (orders == "YMD").to_numpy() & four
        m, d = np.where(odd, a1, m), np.where(odd, a2, d)
        matched &= (orders.notna()).to_numpy()
        y = np.where(four, y, y + 2000)
    else:
        y, d = num("y"), num("d")
        if has("name"):
            names = month_numbers()
            m = got["name"].map(lambda x: names.get(x, 0) if isinstance(x, str) else 0).to_numpy(dtype=np.int64)
        else:
            m = num("mon")
    days, ok = _days(y, m, d)
    H, M, S = num("H"), num("M"), num("S")
    if has("p"):
        p = got["p"].fillna("").str[:1].to_numpy()
        half = (p == "a") | (p == "p")
        ok &= ~half | ((H >= 1) & (H <= 12))
        H = np.where(half, H % 12 + np.where(p == "p", 12, 0), H)
    ok &= (H <= 23) & (M <= 59) & (S <= 60) | (H == 24) & (M == 0) & (S == 0)
    frac = got["f"].fillna("").map(lambda x: int((x + "000000")[:6])).to_numpy(dtype=np.int64) if has("f") else np.zeros(n, dtype=np.int64)
    local = days * 86400 + H * 3600 + M * 60 + S
    utc = local.copy()
    fixed = np.zeros(n, dtype=bool)
    if has("sign"):
        sign = got["sign"].fillna("").to_numpy()
        fixed = sign != ""
        utc = np.where(fixed, local - np.where(sign == "+", 1, -1) * (num("oh") * 3600 + num("om") * 60), utc)
    letters = got["zone"].fillna("").to_numpy() if has("zone") else np.full(n, "")
    utc_word = np.isin(letters, ["z", "utc", "gmt"]) & ~fixed
    fixed |= utc_word
    for zone in np.unique(zone_name[~fixed]):
        here = ~fixed & (zone_name == zone)
        if zone == "":
            ok &= ~here
            continue
        first = local_to_utc(local[here], zone)
        second = second_occurrence(local[here], zone)
        word = letters[here]
        tell = (second != first) & (word != "")
        if tell.any():
            names = [ZoneInfo(zone).tzname(datetime.fromtimestamp(int(s), timezone.utc).astimezone(ZoneInfo(zone))) for s in second[tell]]
            first[tell] = np.where(np.array([str(x).lower() for x in names]) == word[tell], second[tell], first[tell])
        utc[here] = first
    ok &= matched
    out = none
    micros = utc * 1_000_000 + frac
    out[:] = [int(x) if o else None for x, o in zip(micros, ok)]
    return out


def to_utc_micros(df: DataFrame, value: str, zone: str, order: str, out: str = "utc_micros") -> DataFrame:
    """df with the column `out` (BIGINT): the moment that `value` names, by the site's zone and date order.

    Masks are built in the JVM; a worker maps each mask it meets to its parser once and converts the values of
    a parser together. No join, no shuffle, and no hot mask.
    """

    @F.pandas_udf(T.LongType())
    def run(v: pd.Series, m: pd.Series, z: pd.Series, o: pd.Series) -> pd.Series:
        res = pd.Series([None] * len(v), dtype=object, index=v.index)
        parsers = m.map({s: parser_of(s) for s in m.dropna().unique()})
        for expr, rows in parsers.groupby(parsers, sort=False).groups.items():
            res.loc[rows] = convert(v.loc[rows], expr, z.loc[rows], o.loc[rows])
        return res.astype("Int64")

    return df.withColumn(out, run(F.col(value), mask(F.col(value)), F.col(zone), F.col(order)))
