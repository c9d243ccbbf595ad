"""Dates and times: local-date anchors, interval arithmetic as Columns, and scanners for date mentions."""

from __future__ import annotations

import calendar
import datetime as dt
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: vocabularies, eras, digit zeros ---
MONTHS = "january february march april may june july august september october november december".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
COUNTS = dict(zip("one two three four five six seven eight nine ten eleven twelve".split(), range(1, 13), strict=True)) | {"a": 1, "an": 1, "couple": 2}
AR_MONTHS = [
    ["كانون الثاني", "يناير"], ["شباط", "فبراير"], ["آذار", "مارس"], ["نيسان", "أبريل"], ["أيار", "مايو"], ["حزيران", "يونيو"],
    ["تموز", "يوليو"], ["آب", "أغسطس"], ["أيلول", "سبتمبر"], ["تشرين الأول", "أكتوبر"], ["تشرين الثاني", "نوفمبر"], ["كانون الأول", "ديسمبر"],
]
AR_WEEKDAYS = ["الاثنين", "الثلاثاء", "الأربعاء", "الخميس", "الجمعة", "السبت", "الأحد"]
AR_COUNTS = {
    "واحد": 1, "واحدة": 1, "ثلاثة": 3, "ثلاث": 3, "أربعة": 4, "أربع": 4, "خمسة": 5, "خمس": 5, "ستة": 6, "ست": 6, "سبعة": 7, "سبع": 7,
    "ثمانية": 8, "ثماني": 8, "تسعة": 9, "تسع": 9, "عشرة": 10, "عشر": 10,
}
AR_UNITS = {
    "يوم": "day", "أيام": "day", "يوما": "day", "أسبوع": "week", "أسابيع": "week", "أسبوعا": "week", "شهر": "month", "أشهر": "month", "شهور": "month", "شهرا": "month",
    "سنة": "year", "سنوات": "year", "سنين": "year", "عام": "year", "أعوام": "year", "عاما": "year",
}
AR_DUALS = {"يومين": "day", "يومان": "day", "أسبوعين": "week", "شهرين": "month", "سنتين": "year", "عامين": "year"}
AR_DAYS = {"أمس": -1, "امس": -1, "البارحة": -1, "امبارح": -1, "مبارح": -1, "اليوم": 0, "غدا": 1, "غدًا": 1, "الغد": 1, "بكرة": 1, "بكره": 1}
AR_STEPS = {"الماضي": -1, "الماضية": -1, "الفائت": -1, "الحالي": 0, "الحالية": 0, "القادم": 1, "القادمة": 1, "المقبل": 1, "المقبلة": 1}
AR_AGO, AR_THIS = {"قبل", "منذ"}, {"هذا", "هذه"}
ERAS = {
    "พ.ศ": "buddhist", "พศ": "buddhist", "พุทธศักราช": "buddhist", "ค.ศ": "gregorian", "คศ": "gregorian", "คริสต์ศักราช": "gregorian", "هـ": "hijri", "هجري": "hijri", "هجرية": "hijri", "ميلادي": "gregorian", "ميلادية": "gregorian",
    "民國": "minguo", "民国": "minguo", "公元": "gregorian", "西元": "gregorian", "西暦": "gregorian", "令和": "reiwa", "平成": "heisei", "昭和": "showa", "大正": "taisho", "明治": "meiji",
}
SHIFTS = {"gregorian": 0, "buddhist": -543, "minguo": 1911, "reiwa": 2018, "heisei": 1988, "showa": 1925, "taisho": 1911, "meiji": 1867}
SPANS = {
    "reiwa": ("2019-05-01", "9999-12-31"), "heisei": ("1989-01-08", "2019-04-30"), "showa": ("1926-12-25", "1989-01-07"),
    "taisho": ("1912-07-30", "1926-12-24"), "meiji": ("1868-10-23", "1912-07-29"),
}
DIGIT_ZEROS = [0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0x1040, 0xFF10]
# --- End of fixed values ---
WEEK_STARTS = {"monday": 0, "sunday": 6, "saturday": 5}


@dataclass(frozen=True)
class Locale:
    """What a caller declares about dates; undeclared fields take their defaults."""

    language: str = "en"
    week_start: str = "monday"
    date_order: str | None = None
    calendar: str = "gregorian"

    def __post_init__(self):
        if self.language not in ("en", "ar") or self.week_start not in WEEK_STARTS or self.date_order not in (None, "day_first", "month_first"):
            raise ValueError(f"unknown locale: {self}")
        if self.calendar not in SHIFTS and self.calendar not in ("hijri", "jalali"):
            raise ValueError(f"unknown calendar: {self.calendar}")


def anchor(text: Column) -> Column:
    """The local date of an RFC 3339 instant or a bare date: its first ten characters."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def offset_minutes(text: Column) -> Column:
    """Minutes of an instant's UTC offset; null for a bare date."""
    sign, hours, minutes = (F.regexp_extract(text, r"T.*(?:([+-])(\d\d):(\d\d)|Z)$", i) for i in (1, 2, 3))
    value = F.when(sign == "", F.lit(0)).otherwise(F.when(sign == "-", -1).otherwise(1) * (F.nullif(hours, F.lit("")).cast("int") * 60 + F.nullif(minutes, F.lit("")).cast("int")))
    return F.when(F.rlike(text, F.lit(r"T.*(?:[+-]\d\d:\d\d|Z)$")), value)


def same_frame(a: Column, b: Column) -> Column:
    """Whether two instants carry one offset."""
    return F.coalesce(offset_minutes(a) == offset_minutes(b), F.lit(False))


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b."""
    return F.datediff(b, a)


def hours_between(a: Column, b: Column) -> Column:
    """Whole hours from a to b, toward zero."""
    return ((F.unix_timestamp(b) - F.unix_timestamp(a)) / 3600).cast("long")


def week_start(day: Column, start: str = "monday") -> Column:
    """First day of the day's week."""
    return F.date_sub(day, F.pmod(F.weekday(day) - WEEK_STARTS[start], F.lit(7)))


def weeks_between(a: Column, b: Column, start: str = "monday") -> Column:
    """Week boundaries from a to b."""
    return (F.datediff(week_start(b, start), week_start(a, start)) / 7).cast("int")


def months_between(a: Column, b: Column) -> Column:
    """Month boundaries from a to b."""
    return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a))


def describe_interval(a: Column, b: Column) -> Column:
    """In words, b from a: days below 14, calendar weeks below 180 days, months below 730, else years."""
    days = F.datediff(b, a)
    n, weeks, months = F.abs(days), F.abs(weeks_between(a, b)), F.abs(months_between(a, b))
    count = F.when(n < 14, n).when(n < 180, weeks).when(n < 730, months).otherwise((months / 12).cast("int"))
    unit = F.when(n < 14, "day").when(n < 180, "week").when(n < 730, "month").otherwise("year")
    said = F.concat(count.cast("string"), F.lit(" "), unit, F.when(count == 1, "").otherwise("s"), F.when(days < 0, " before").otherwise(" after"))
    return F.when(days == 0, "same day").otherwise(said)


def shift_months(day: Column, n: Column | int) -> Column:
    """The same day n months on, at most the month's last."""
    return F.add_months(day, n)


def previous_weekday(day: Column, weekday: int) -> Column:
    """The last such weekday (0 Monday) before the day."""
    return F.date_sub(day, F.pmod(F.weekday(day) - weekday - 1, F.lit(7)) + 1)


def following_weekday(day: Column, weekday: int) -> Column:
    """The next such weekday after the day."""
    return F.date_add(day, F.pmod(F.lit(weekday - 1) - F.weekday(day), F.lit(7)) + 1)


def ascii_digits(text: Column) -> Column:
    """Digits of other scripts as ASCII."""
    return F.translate(text, "".join(chr(z + d) for z in DIGIT_ZEROS for d in range(10)), "0123456789" * len(DIGIT_ZEROS))


def temporal_key(text: Column) -> Column:
    """Dates as the start of their day, so that keys compare as text."""
    return F.when(F.char_length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(text)


def valid_at(valid_from: Column, valid_to: Column, at: Column | None) -> Column:
    """Start inclusive, end exclusive; without an instant only what is still open."""
    return valid_to.isNull() if at is None else (F.coalesce(valid_from, F.lit("")) <= at) & (valid_to.isNull() | (valid_to > at))


CIVIL_YEARS = (1300, 1600)
_civil: list[int] = []


def civil_months() -> list[int]:
    """First days (as ordinals) of the lunar months of ``CIVIL_YEARS`` in the civil calendar that the JVM knows; read once
    a session. Nothing without a session."""
    session = SparkSession.getActiveSession()
    if not _civil and session is not None:
        date = session._jvm.java.time.chrono.HijrahDate
        _civil.extend(719_163 + date.of(y, m, 1).toEpochDay() for y in range(*CIVIL_YEARS) for m in range(1, 13))
    return _civil


def to_gregorian(name: str, y: int, m: int, d: int, civil: list[int] | tuple = ()) -> dt.date | None:
    """The Gregorian date of (y, m, d) in a calendar; Hijri by the civil months, by the tabular rule outside them, Jalali
    by the 33-year rule."""
    try:
        if name in SHIFTS:
            day = dt.date(y + SHIFTS[name], m, d)
            low, high = SPANS.get(name, ("0001-01-01", "9999-12-31"))
            return day if low <= day.isoformat() <= high else None
        if not 1 <= m <= 12 or not 1 <= d <= (30 if name == "hijri" else 31):
            return None
        if name == "hijri":
            month = (y - CIVIL_YEARS[0]) * 12 + m - 1
            if 0 <= month < len(civil) - 1:
                return dt.date.fromordinal(civil[month] + d - 1) if civil[month] + d - 1 < civil[month + 1] else None
            return dt.date.fromordinal(227014 + (y - 1) * 354 + (3 + 11 * y) // 30 + 29 * (m - 1) + m // 2 + d)
        return dt.date.fromordinal(226894 + 365 * (y - 1) + (8 * y + 21) // 33 + (31 * (m - 1) if m <= 7 else 30 * (m - 1) + 6) + d)
    except (ValueError, OverflowError):
        return None


def _digits(word: str) -> int | None:
    plain = "".join(str(unicodedata.digit(c, "x")) if unicodedata.digit(c, None) is not None else "x" for c in word)
    return int(plain) if plain.isdigit() else None


def _add_months(day: dt.date, n: int) -> dt.date | None:
    k = day.year * 12 + day.month - 1 + n
    if not 12 <= k < 120_000:
        return None
    return dt.date(k // 12, k % 12 + 1, min(day.day, calendar.monthrange(k // 12, k % 12 + 1)[1]))


def _period(day: dt.date, unit: str, n: int, start: int) -> tuple[dt.date, dt.date] | None:
    """The whole week, month or year n units from the day's; for a day, that day."""
    if unit == "day":
        moved = day + dt.timedelta(days=n)
        return moved, moved
    if unit == "week":
        first = day - dt.timedelta(days=(day.weekday() - start) % 7) + dt.timedelta(weeks=n)
        return first, first + dt.timedelta(days=6)
    moved = _add_months(day.replace(day=1), n * (12 if unit == "year" else 1))
    if moved is None:
        return None
    if unit == "year":
        return moved.replace(month=1), moved.replace(month=12, day=31)
    return moved, moved.replace(day=calendar.monthrange(moved.year, moved.month)[1])


def _point(day: dt.date, unit: str, n: int) -> dt.date | None:
    return day + dt.timedelta(days=n * (7 if unit == "week" else 1)) if unit in ("day", "week") else _add_months(day, n * (12 if unit == "year" else 1))


def _weekday(day: dt.date, target: int, step: int, start: int) -> dt.date:
    if step:
        return day + dt.timedelta(days=-((day.weekday() - target - 1) % 7) - 1 if step < 0 else (target - day.weekday() - 1) % 7 + 1)
    return day - dt.timedelta(days=(day.weekday() - start) % 7) + dt.timedelta(days=(target - start) % 7)


_TOKEN = re.compile(r"[\w\u0300-\u036F\u0640\u0E00-\u0E7F]+(?:[-/.][\w\u0640\u0E00-\u0E7F]+)*")
_NUMERIC = re.compile(r"(\d+)[-/.](\d+)[-/.](\d+)$")


# --- Fixed values: what requests may call things that a locale declares ---
ARABIC = ("ar", "arabic")
WEEK_NAMES = {"sunday": "sunday", "sun": "sunday", "saturday": "saturday", "sat": "saturday"}
ORDER_NAMES = {"month_first": "month_first", "mdy": "month_first", "us": "month_first", "day_first": "day_first", "dmy": "day_first"}
CALENDAR_NAMES = {
    "buddhist": "buddhist", "be": "buddhist", "thai": "buddhist", "minguo": "minguo", "roc": "minguo", "taiwan": "minguo", "hijri": "hijri", "islamic": "hijri", "umalqura": "hijri",
    "jalali": "jalali", "persian": "jalali", "solar_hijri": "jalali", "reiwa": "reiwa", "heisei": "heisei", "showa": "showa", "taisho": "taisho", "meiji": "meiji",
}
# --- End of fixed values ---


def declared(body: dict) -> Locale:
    """The locale of a request: what it doesn't declare, or calls by an unknown name, keeps its default (Arabic's week
    starts on Saturday and its dates put the day first); a given week start that isn't listed is Monday."""
    arabic = body.get("language") in ARABIC
    week = body.get("week_start")
    return Locale(
        "ar" if arabic else "en", WEEK_NAMES.get(week, "monday") if isinstance(week, str) else "saturday" if arabic else "monday",
        ORDER_NAMES.get(body.get("date_order"), "day_first" if arabic else None), CALENDAR_NAMES.get(body.get("calendar"), "gregorian"),
    )


def declared_locale(body: Column) -> Column:
    """``declared`` of JSON texts, as a struct of the locale's fields."""

    def named(field: str, names: dict[str, str], otherwise: Column) -> Column:
        return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.get_json_object(body, f"$.{field}")], otherwise)

    arabic = F.coalesce(F.get_json_object(body, "$.language").isin(*ARABIC), F.lit(False))
    week = F.when(F.get_json_object(body, "$.week_start").isNull() & arabic, "saturday").otherwise("monday")
    return F.struct(
        F.when(arabic, "ar").otherwise("en").alias("language"), named("week_start", WEEK_NAMES, week).alias("week_start"),
        named("date_order", ORDER_NAMES, F.when(arabic, "day_first")).alias("date_order"), named("calendar", CALENDAR_NAMES, F.lit("gregorian")).alias("calendar"),
    )


#: Words that an English mention without digits begins with.
EN_BEGINNINGS = {*MONTHS, *COUNTS, "yesterday", "today", "tonight", "tomorrow", "last", "this", "next"}


class Scanner:
    """Date mentions of one text: (text, kind, resolved, resolved_end, byte offset)."""

    def __init__(self, text: str, anchor_day: dt.date | None, locale: Locale, civil: list[int] | tuple = ()):
        self.text, self.day, self.locale, self.civil = text, anchor_day, locale, civil
        self.start = WEEK_STARTS[locale.week_start]
        self.tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
        self.low = [t[2].lower() for t in self.tokens]
        self.digits = [not w.isalpha() and any(map(str.isdigit, w)) for w in self.low]
        self.order = locale.date_order or self._demonstrated() or "day_first"

    def _fields(self, word: str) -> tuple[int, int, int] | None:
        plain = "".join(str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else c for c in word)
        m = _NUMERIC.match(plain)
        return (int(m[1]), int(m[2]), int(m[3])) if m else None

    def _demonstrated(self) -> str | None:
        seen = set()
        for word, digits in zip(self.low, self.digits, strict=True):
            f = self._fields(word) if digits else None
            if f and 12 < f[0] <= 31 and 1 <= f[1] <= 12:
                seen.add("day_first")
            elif f and 12 < f[1] <= 31 and 1 <= f[0] <= 12:
                seen.add("month_first")
        return seen.pop() if len(seen) == 1 else None

    def _read(self, cal: str, y: int, m: int, d: int) -> dt.date | None:
        return to_gregorian(cal, y, m, d, self.civil) if cal != "gregorian" or 1000 <= y <= 9999 else None

    def _numeric(self, i: int) -> tuple[int, int, tuple | None] | None:
        """(first token, last token, period or None) of a date in digits, or a year with an era."""
        word = self.low[i].rstrip(".")
        era_before = ERAS.get(self.low[i - 1].rstrip(".")) if i else None
        era_after = ERAS.get(self.low[i + 1].rstrip(".")) if i + 1 < len(self.low) else None
        cal = era_before or era_after or self.locale.calendar
        first, last = (i - 1 if era_before else i), (i + 1 if era_after and not era_before else i)
        f = self._fields(word)
        if f:
            a, b, c = f
            if len(re.split(r"[-/.]", word)[0]) >= 4 or (cal != "gregorian" and a > 31):
                day = self._read(cal, a, b, c)
                return (first, last, (day, day)) if day else None
            by_day, by_month = self._read(cal, c, b, a), self._read(cal, c, a, b)
            day = (by_month if self.order == "month_first" else by_day) if by_day and by_month else by_day or by_month
            return (first, last, (day, day)) if day else None
        year = _digits(word)
        if year is not None and (era_before or era_after):
            one = to_gregorian(cal, year, 7, 1, self.civil) or to_gregorian(cal, year, 1, 1, self.civil)
            if cal in ("hijri", "jalali"):
                lo, hi = to_gregorian(cal, year, 1, 1, self.civil), to_gregorian(cal, year + 1, 1, 1, self.civil)
                return first, last, (lo, hi - dt.timedelta(days=1)) if lo and hi else None
            return first, last, (one.replace(month=1, day=1), one.replace(month=12, day=31)) if one else None
        return None

    def _capital_chosen(self, i: int) -> bool:
        at = self.tokens[i][0]
        before = self.text[:at].rstrip(" \t")
        return self.text[at].isupper() and bool(before) and before[-1] not in ".!?\n\r"

    def _number(self, i: int, low: int, high: int) -> int | None:
        n = _digits(self.low[i]) if 0 <= i < len(self.low) else None
        return n if n is not None and low <= n <= high else None

    def _dated(self, month: int, day: int | None, year: int | None) -> tuple | None:
        try:
            if year and day:
                one = dt.date(year, month, day)
                return one, one
            return (dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])) if year else None
        except ValueError:
            return None

    def _english(self, i: int) -> tuple[int, int, str, tuple | None] | None:
        word, at = self.low[i], lambda k: self.low[k] if k < len(self.low) else ""
        if word in MONTHS:
            day = self._number(i + 1, 0, 255)
            year = self._number(i + 2 if day is not None else i + 1, 1000, 9999)
            if day is None and year is None and not self._capital_chosen(i):
                return None
            return i, i + (day is not None) + (year is not None), "absolute", self._dated(MONTHS.index(word) + 1, day, year)
        if self._number(i, 1, 31) and at(i + 1) in MONTHS:
            year = self._number(i + 2, 1000, 9999)
            if year is None and not self._capital_chosen(i + 1):
                return None
            return i, i + 1 + (year is not None), "absolute", self._dated(MONTHS.index(at(i + 1)) + 1, self._number(i, 1, 31), year) if year else None
        if word in ("yesterday", "today", "tonight", "tomorrow"):
            return i, i, "relative", self.day and _period(self.day, "day", {"yesterday": -1, "tomorrow": 1}.get(word, 0), self.start)
        if word in ("last", "this", "next"):
            step, unit = {"last": -1, "this": 0, "next": 1}[word], at(i + 1)
            if unit in ("night", "morning", "evening", "afternoon"):
                return i, i + 1, "relative", self.day and _period(self.day, "day", step, self.start)
            if unit in ("week", "month", "year"):
                return i, i + 1, "relative", self.day and _period(self.day, unit, step, self.start)
            if unit in WEEKDAYS:
                one = self.day and _weekday(self.day, WEEKDAYS.index(unit), step, self.start)
                return i, i + 1, "relative", one and (one, one)
            return None
        count, unit = COUNTS.get(word) or self._number(i, 1, 1 << 40), at(i + 1).rstrip("s")
        if count and unit in ("day", "week", "month", "year") and at(i + 2) == "ago":
            try:
                one = self.day and _point(self.day, unit, -count)
            except OverflowError:
                one = None
            return i, i + 2, "relative", one and (one, one)
        return None

    def _arabic(self, i: int) -> tuple[int, int, str, tuple | None] | None:
        nfc = lambda k: unicodedata.normalize("NFC", self.low[k]) if 0 <= k < len(self.low) else ""
        bare = lambda w: w[2:] if w.startswith("ال") else w
        unit_of = lambda w: AR_UNITS.get(w) or AR_UNITS.get(bare(w))
        moved = lambda unit, n: self.day and (p := _point(self.day, unit, n)) and (p, p)
        word, after = nfc(i), nfc(i + 1)
        for span in (2, 1):
            name = " ".join(nfc(i + k) for k in range(span))
            month = next((m for m, names in enumerate(AR_MONTHS, 1) if name in names), None)
            if month:
                year, day = self._number(i + span, 1000, 9999), self._number(i - 1, 1, 31)
                dated = self._dated(month, day, year)
                return (i - 1 if day and dated else i), i + span - 1 + (year is not None), "absolute", dated
        if word in AR_AGO:
            if after in AR_DUALS:
                return i, i + 1, "relative", moved(AR_DUALS[after], -2)
            count = AR_COUNTS.get(after) or self._number(i + 1, 1, 10**6)
            if count and unit_of(nfc(i + 2)):
                return i, i + 2, "relative", moved(unit_of(nfc(i + 2)), -count)
            if unit_of(after) and nfc(i + 2) not in AR_STEPS:
                return i, i + 1, "relative", moved(unit_of(after), -1)
            return None
        if word in AR_THIS and unit_of(after):
            return i, i + 1, "relative", self.day and _period(self.day, unit_of(after), 0, self.start)
        if after in AR_STEPS and unit_of(word):
            return i, i + 1, "relative", self.day and _period(self.day, unit_of(word), AR_STEPS[after], self.start)
        if after in AR_STEPS and word in AR_WEEKDAYS:
            one = self.day and _weekday(self.day, AR_WEEKDAYS.index(word), AR_STEPS[after], self.start)
            return i, i + 1, "relative", one and (one, one)
        return (i, i, "relative", self.day and _period(self.day, "day", AR_DAYS[word], self.start)) if word in AR_DAYS else None

    def mentions(self) -> list[tuple]:
        out, i = [], 0
        arabic = self.locale.language == "ar"
        scan = self._arabic if arabic else self._english
        while i < len(self.tokens):
            if not (arabic or self.digits[i] or self.low[i] in EN_BEGINNINGS):
                i += 1
                continue
            number = self._numeric(i) if self.digits[i] else None
            found = (number[0], number[1], "absolute", number[2]) if number else scan(i)
            if not found:
                i += 1
                continue
            first, last, kind, period = found
            begin, end = self.tokens[first][0], self.tokens[last][1]
            lo, hi = (period[0].isoformat(), period[1].isoformat()) if period else (None, None)
            out.append((self.text[begin:end], kind, lo, hi if hi != lo else None, len(self.text[:begin].encode())))
            i = last + 1
        return out


MENTION = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("text", T.StringType()), ("kind", T.StringType()), ("resolved", T.StringType()), ("resolved_end", T.StringType()), ("offset", T.LongType()))]))


def found_mentions(text: str, day: dt.date | None, locale: Locale, civil: list[int] | tuple = ()) -> list[dict]:
    """The date mentions of one text."""
    return [dict(zip(("text", "kind", "resolved", "resolved_end", "offset"), m, strict=True)) for m in Scanner(text, day, locale, civil).mentions()]


def mentions(locale: Locale = Locale()):
    """An Arrow UDF of (text, anchor date): the text's date mentions under a locale."""
    civil = list(civil_months())

    @F.pandas_udf(MENTION)
    def scan(text: pd.Series, day: pd.Series) -> pd.Series:
        return pd.Series([found_mentions(t, d if isinstance(d, dt.date) else None, locale, civil) if isinstance(t, str) else [] for t, d in zip(text, day, strict=True)])

    return scan


def claimed_span(claim: Column, text: Column, day: Column, locale: Locale = Locale()) -> Column:
    """The first date that a claim names, only if the claim stands literally in the text."""
    held = F.when((claim != "") & F.contains(text, claim), claim)
    return F.try_element_at(mentions(locale)(held, day), F.lit(1))
