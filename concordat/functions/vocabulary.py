"""Columns over the small fixed vocabularies (no join needed)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.fixed_values import (
    DEFAULT_PRECEDENCE,
    KIND_PRECEDENCE,
    NON_GOVERNING_KINDS,
    OBSERVES,
    TERMS_ONLY_FOR_KIND,
)
from concordat.functions.text import col


def lookup(key: Column, values: dict, default: Column | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def precedence(kind: Column | str) -> Column:
    return lookup(col(kind), KIND_PRECEDENCE, F.lit(DEFAULT_PRECEDENCE))


def governs(kind: Column | str) -> Column:
    return ~col(kind).isin(*NON_GOVERNING_KINDS)


def governed_term(term: Column | str) -> Column:
    """The term a statement speaks to: billed rates speak to the agreed rate."""
    return lookup(col(term), OBSERVES, col(term))


def term_allowed(term: Column | str, kind: Column | str) -> Column:
    """Whether a document of this kind may state the term; unknown kinds may."""
    term, kind = col(term), col(kind)
    refused = F.lit(False)
    for name, kinds in TERMS_ONLY_FOR_KIND.items():
        refused = refused | ((term == name) & ~kind.isin(*kinds))
    return F.coalesce(~refused, F.lit(True))
