"""Field parsers of tickets: date, time, price and seat, each abstaining rather than guessing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import bound

#: Month names.
MONTHS = (
    "jan january feb february mar march apr april may jun june jul july aug august "
    "sep sept september oct october nov november dec december"
).split()
MONTH_ALT = "|".join(sorted(MONTHS, key=len, reverse=True))
#: Seat grades, and words that are no block.
GRADES = ("시야제한석", "VVIP석", "BOX석", "VIP석", "회원석", "학생석", "초대석", "합창석", "제한석", "보류석", "자유석", "박스석", "R석", "S석", "A석", "B석", "C석", "D석", "E석", "P석")
NOT_A_BLOCK = ("층", "석", "열", "번", "관", "홀", "객석", "구역", "블록", "블럭", "존", "입장", "게이트")


def _group(s: Column, pattern: str, i: int = 1) -> Column:
    """A group as string, null where it is empty or nothing matches."""
    return F.nullif(F.regexp_extract(s, pattern, i), F.lit(""))


def _tidy(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[\u200B-\u200D\uFEFF]", ""), r"(?U)\s+", " "))


def _date(y: Column, m: Column, d: Column) -> Column:
    """ISO date of three digit strings if it is a real one from 1900 to 2200."""
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(y.try_cast("int").between(1900, 2200), F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))


def _month(name: Column) -> Column:
    """Number of a month name by its first three letters."""
    at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.substring(F.lower(name), 1, 3))
    return (F.floor((at - 1) / 3) + 1).cast("int").cast("string")


def parse_date(raw: Column) -> Column:
    """struct<value, confidence>: six forms in order of trust; without a year there is none."""
    # fixed values: the six forms
    ymd = r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일?"
    sep = r"(\d{4})\s*[.\-/]\s*(\d{1,2})\s*[.\-/]\s*(\d{1,2})"
    run = r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)"
    dmy = rf"(?i)(\d{{1,2}})\s*[-. ]?\s*({MONTH_ALT})\.?\s*[-,. ]?\s*(\d{{4}})"
    mdy = rf"(?i)({MONTH_ALT})\.?\s*(\d{{1,2}})\s*(?:st|nd|rd|th)?\s*,?\s*(\d{{4}})"
    late = r"(?<!\d)(\d{1,2})\s*[.\-/]\s*(\d{1,2})\s*[.\-/]\s*(\d{4})(?!\d)"
    hit = lambda value, confidence: bound(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("value"), confidence.cast("double").alias("confidence"))))

    def last(s: Column) -> Column:
        """Two numbers before the year: the day first only if the other order is impossible."""
        a, b = _group(s, late, 1).try_cast("int"), _group(s, late, 2).try_cast("int")

        def told(n: Column) -> Column:
            day_first = (n["a"] > 12) & (n["b"] <= 12)
            month, day = F.when(day_first, n["b"]).otherwise(n["a"]), F.when(day_first, n["a"]).otherwise(n["b"])
            return hit(_date(_group(s, late, 3), month.cast("string"), day.cast("string")), F.when((n["a"] <= 12) & (n["b"] <= 12), 0.5).otherwise(0.85))

        return bound(F.struct(a.alias("a"), b.alias("b")), told)

    def read(s: Column) -> Column:
        g = lambda p, i: _group(s, p, i)
        tries = [hit(_date(g(p, 1), g(p, 2), g(p, 3)), F.lit(c)) for p, c in ((ymd, 0.97), (sep, 0.95), (run, 0.8))]
        tries += [hit(_date(g(dmy, 3), _month(g(dmy, 2)), g(dmy, 1)), F.lit(0.92)), hit(_date(g(mdy, 3), _month(g(mdy, 1)), g(mdy, 2)), F.lit(0.92)), last(s)]
        return F.coalesce(*tries, F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence")))

    return bound(_tidy(raw), read)


def parse_time(raw: Column) -> Column:
    """struct<value, confidence>: HH:MM; afternoon only where it is said."""
    # fixed values: the form of a time, and words for halves of the day
    p = r"(?<!\d)(\d{1,2})\s*[:시]\s*(\d{1,2})?\s*분?"

    def read(s: Column) -> Column:
        h, m = _group(s, p).try_cast("int"), F.coalesce(_group(s, p, 2).try_cast("int"), F.lit(0))
        pm, am = s.rlike(r"(?i)오후|p\.?m\.?"), s.rlike(r"(?i)오전|a\.?m\.?")
        return bound(F.struct(h.alias("h"), m.alias("m"), pm.alias("pm"), am.alias("am")), told)

    def told(n: Column) -> Column:
        good = n["h"].between(0, 23) & n["m"].between(0, 59)
        later = F.when(n["pm"] & (n["h"] < 12), n["h"] + 12).otherwise(n["h"])
        hour = F.when(n["am"] & (later == 12), F.lit(0)).otherwise(later)
        value = F.when(good, F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), F.lpad(n["m"].cast("string"), 2, "0")))
        confidence = F.when(~F.coalesce(good, F.lit(False)), 0.0).when(n["pm"] | n["am"] | (hour >= 13), 0.9).otherwise(0.7)
        return F.struct(value.alias("value"), confidence.alias("confidence"))

    return bound(_tidy(raw), read)


def parse_price(raw: Column) -> Column:
    """Whole won: 0 for an invitation without digits, else the first run of 3 to 9 digits."""
    free = raw.rlike(r"(?i)초대|invitation|무료|complimentary") & ~raw.rlike(r"\d")
    return F.when(free, F.lit(0).cast("long")).otherwise(_group(F.regexp_replace(raw, r"(?U)[\s,]", ""), r"(\d{3,9})").try_cast("long"))


def strip_gates(s: Column) -> Column:
    """Removes gate numbers and captions before a seat is read."""
    # fixed values: what is removed, in order
    for p in (
        r"(?i)\d{1,2}\s*(?:층|F)\s*\d{1,3}\s*번?\s*(?:게이트|gate)", r"(?i)입장\s*(?:게이트)?\s*[:：]?\s*\d{1,2}\s*(?:층|F)\s*\d{1,3}\s*번?", r"(?i)\d{1,3}\s*번?\s*(?:게이트|gate)",
        r"(?i)(?:게이트|gate)\s*[:：]?\s*\d{1,3}\s*번?", r"(?i)입장\s*(?:게이트)?\s*[:：]", r"(?i)(?<![A-Za-z0-9_])(?:floor|block|row|seat|gate|grade|no)(?![A-Za-z0-9_])\.?", r"좌석\s*[:：]",
    ):
        s = F.regexp_replace(s, p, " ")
    return _tidy(s)


def _within(x: Column, lo: int, hi: int) -> Column:
    return bound(x.try_cast("int"), lambda n: F.when(n.between(lo, hi), n))


def parse_seat(raw: Column, grade_raw: Column | None = None) -> Column:
    """struct<floor, block, row, number, grade, confidence> of a seat line.

    Confidence is 0.4 and 0.15 for each part, 0.5 for a grade alone.
    """
    given = F.nullif(_tidy(grade_raw), F.lit("")) if grade_raw is not None else F.lit(None).cast("string")

    def read(line: Column) -> Column:
        listed = F.coalesce(*[F.when(F.contains(line, F.lit(g)), F.lit(g)) for g in sorted(GRADES, key=len, reverse=True)])
        letter = F.concat(_group(line, r"(?<![A-Za-z])(VVIP|VIP|[A-Z])석"), F.lit("석"))
        said = bound(given, lambda g: F.when(~g.rlike(r"(?i)^(없음|미지정|n/?a|none|null)$"), g))
        from_hall = lambda s: F.when(F.instr(s, "객석") > 0, F.substring(s, F.instr(s, "객석"), F.length(s))).otherwise(s)
        return bound(bound(strip_gates(line), from_hall), lambda s: bound(parts(s, F.coalesce(said, listed, letter)), told))

    def parts(s: Column, grade: Column) -> Column:
        first = lambda *ps: F.coalesce(*[_group(s, p) for p in ps])
        floor = _within(first(r"객석\s*(\d{1,2})\s*층", r"(\d{1,2})\s*층", r"(?i)(?:floor|fl)\.?\s*(\d{1,2})", r"(?<!\d)(\d{1,2})\s*F(?![A-Za-z])"), 1, 5)
        block = bound(
            first(r"([A-Za-z]{1,3}|[가-힣]{1,2})\s*(?:구역|블록|블럭|존)", r"(?i)(?:block|zone|section|sec)\.?\s*([A-Za-z]{1,3}|\d{1,2})"),
            lambda b: F.when(~b.isin(*NOT_A_BLOCK), F.when(b.rlike("^[A-Za-z]+$"), F.upper(b)).otherwise(b)),
        )
        row = _within(first(r"(\d{1,3})\s*열", r"(?i)row\s*(\d{1,3})"), 1, 200)
        number = _within(first(r"(\d{1,3})\s*번(?!호)", r"(?i)seat\s*(?:no\.?\s*)?(\d{1,3})", r"(?i)no\.?\s*(\d{1,3})(?!\d)"), 1, 500)
        return F.struct(floor.alias("floor"), block.alias("block"), row.alias("row"), number.alias("number"), grade.alias("grade"))

    def told(p: Column) -> Column:
        n = sum((p[x].isNotNull().cast("int") for x in ("floor", "block", "row", "number")), F.lit(0))
        confidence = F.when(n > 0, F.least(F.lit(1.0), 0.4 + 0.15 * n)).when(p["grade"].isNotNull(), 0.5).otherwise(0.0)
        return F.struct(*[p[x].alias(x) for x in ("floor", "block", "row", "number", "grade")], confidence.alias("confidence"))

    return bound(_tidy(F.coalesce(raw, F.lit(""))), read)


def play_dates(raw: Column) -> Column:
    """struct<first, last>: `2024.03.01 ~ 2024.03.05` at the start of a text as ISO dates; one date is both, none gives nulls."""
    p = r"^\s*(\d{4})\.(\d{2})\.(\d{2})(?:\s*~\s*(\d{4})\.(\d{2})\.(\d{2}))?"
    iso = lambda i: F.concat_ws("-", *[F.regexp_extract(raw, p, i + k) for k in range(3)])
    first = F.when(raw.rlike(p), iso(1))
    return F.struct(first.alias("first"), F.when(F.regexp_extract(raw, p, 4) != "", iso(4)).otherwise(first).alias("last"))


def fixed_date(raw: Column) -> Column:
    """`20240301` as `2024-03-01`; any other length gives ''."""
    return F.when(F.length(raw) == 8, F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))).otherwise("")
