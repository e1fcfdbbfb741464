"""What a piece of prose claims about which of two values is the larger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.fixed_values import NEGATION_REACH, NEGATIONS, SAYS_HIGHER, SAYS_LOWER


def _asserts(text: Column, words: tuple[str, ...]) -> Column:
    """Any of the words, unless a negation stands shortly before it in the same clause."""
    negated = rf"(?<!\b(?:{NEGATIONS})\b[^.;]{{0,{NEGATION_REACH}}})"
    return text.rlike(rf"(?i){negated}\b(?:{'|'.join(words)})\b")


def claimed_sign(text: Column) -> Column:
    """1 or -1 as the text claims; NULL when it claims neither or both."""
    higher, lower = _asserts(text, SAYS_HIGHER), _asserts(text, SAYS_LOWER)
    return F.when(higher & ~lower, 1).when(lower & ~higher, -1)


def contradicts(text: Column, sign: Column) -> Column:
    return F.coalesce((sign != 0) & (claimed_sign(text) != sign), F.lit(False))
