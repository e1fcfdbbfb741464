"""Values as written -> comparable magnitudes, and back to canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.fixed_values import (
    FORMULA,
    NUMBER,
    REASON_EMPTY,
    REASON_FORMULA,
    REASON_UNREADABLE,
    UNIT_OF_TERM,
)
from concordat.functions.text import SPACE, col, none_if_empty, strip

MAGNITUDE = "decimal(18,6)"

_S = SPACE + "*"
_BARE = rf"{NUMBER}$"
_IN_WORDS = rf"(?i:[a-z\-,{SPACE[1:-1]}]*)\({_S}{NUMBER}{_S}\)$"


def _counted(unit: str) -> list[str]:
    """`12 months`, `12 (12) months`, then `(12) months`."""
    return [rf".*?{NUMBER}{_S}(?:\({_S}[0-9]+{_S}\))?{_S}(?i:{unit})", rf".*?\({_S}{NUMBER}{_S}\){_S}(?i:{unit})"]


# Ways to write a number, in the order in which they are tried.
_WAYS = {
    "USD": [rf".*?{NUMBER}"],
    "days": [rf".*?(?i:net){_S}{NUMBER}", *_counted("day"), _BARE, _IN_WORDS],
    "months": [*_counted("month"), rf".*?{NUMBER}{_S}(?i:year)", _BARE, _IN_WORDS],
    "percent": [rf".*?{NUMBER}{_S}%", r"([0-9.]*[0-9][0-9.]*)$", _IN_WORDS],
    "hours": [_BARE, rf".*?{NUMBER}{_S}(?i:hour)", _IN_WORDS],
}
_YEARS = 3  # the way of writing months that states years


def _number(text: Column, unit: str, groups: list[int]) -> Column:
    """The digits of the first way that fits, when it is one of `groups`; else empty.

    One pass: alternatives are tried from left to right at the start of the text, and the
    last one fits anything.  A value too fine for DECIMAL(18,6) counts as not stated.
    """
    fits = rf"(?s)^(?:{'|'.join(_WAYS[unit])}|).*$"
    digits = F.regexp_replace(text, fits, "".join(f"${g}" for g in groups))
    plain = F.replace(digits, F.lit(","), F.lit(""))
    return F.regexp_replace(plain, r"^.*\.[0-9]{6}[0-9]*[1-9]$", "").try_cast(MAGNITUDE)


def _of(unit: str, terms: dict[str, str] = UNIT_OF_TERM) -> list[str]:
    return [term for term, u in terms.items() if u == unit]


def is_formula(raw: Column | str) -> Column:
    raw = col(raw)
    folded = F.lower(raw)  # every formula has one of these, so few texts meet the pattern
    worded = folded.contains("of") | folded.contains("times") | folded.contains("multiplied")
    return F.coalesce(worded & raw.rlike(FORMULA.replace(r"\s", SPACE)), F.lit(False))


def unit_of(term: Column | str) -> Column:
    term = col(term)
    unit = F.lit(None).cast("string")
    for name in sorted(set(UNIT_OF_TERM.values())):
        unit = F.when(term.isin(_of(name)), F.lit(name)).otherwise(unit)
    return unit


def magnitude(term: Column | str, raw: Column | str) -> Column:
    """The number a value states, read the way its term says; NULL if it states none."""
    term, text = col(term), strip(raw)
    number = F.lit(None).cast(MAGNITUDE)
    for unit, ways in _WAYS.items():
        groups = list(range(1, len(ways) + 1))
        if unit == "months":
            groups.remove(_YEARS)
            years = (_number(text, unit, [_YEARS]) * F.lit(12)).try_cast(MAGNITUDE)
            value = F.coalesce(_number(text, unit, groups), years)
        else:
            value = _number(text, unit, groups)
        number = F.when(term.isin(_of(unit)), value).otherwise(number)
    return F.when(~is_formula(text), number)


def not_comparable_reason(raw: Column | str, number: Column | str) -> Column:
    raw, number = col(raw), col(number)
    return (
        F.when(F.coalesce(strip(raw), F.lit("")) == "", F.lit(REASON_EMPTY))
        .when(is_formula(raw), F.lit(REASON_FORMULA))
        .when(number.isNull(), F.lit(REASON_UNREADABLE))
    )


def number_text(number: Column | str) -> Column:
    """Plain notation, trailing zeros dropped."""
    number = col(number)
    digits = number.cast("string")
    return F.when(number == 0, F.lit("0")).otherwise(
        F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    )


def parse_date(text: Column | str) -> Column:
    """First `yyyy-mm-dd` in the text, else first `mm/dd/yyyy`; no second try if invalid."""
    text = col(text)
    iso = none_if_empty(F.regexp_extract(text, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
    slashed = F.regexp_extract(text, r"([0-9]{2}/[0-9]{2}/[0-9]{4})", 1)
    turned = F.concat_ws("-", F.right(slashed, F.lit(4)), F.left(slashed, F.lit(2)),
                         F.substring(slashed, 4, 2))
    chosen = F.coalesce(iso, F.when(slashed != "", turned))
    return F.when(~chosen.startswith("0000"), chosen.try_cast("date"))
