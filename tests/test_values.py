"""Values, dates and names as written."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concordat.functions import text as T
from concordat.functions import values as V

CASES = [
    ("hourly_rate", "$180.00 per hour", "180"), ("hourly_rate", "180 USD/hr", "180"),
    ("hourly_rate", "£17,628.72", "17628.72"), ("hourly_rate", "($21,750.00)", "21750"),
    ("annual_fees", "$5 million", "5"), ("hourly_rate", "per hour", None), ("hourly_rate", "", None),
    ("payment_terms_days", "net 45 days", "45"), ("payment_terms_days", "NET45", "45"),
    ("payment_terms_days", "45", "45"), ("payment_terms_days", "forty-five (45)", "45"),
    ("payment_terms_days", "within thirty (30) days of receipt", "30"), ("payment_terms_days", "30 (30) days", "30"),
    ("payment_terms_days", "60 days, or net 30 for early payers", "30"), ("payment_terms_days", "(6O)", None),
    ("payment_terms_days", "to be agreed", None), ("termination_notice_days", "90 days' notice", "90"),
    ("auto_renew_months", "twenty-four (24) months", "24"), ("auto_renew_months", "2 years", "24"),
    ("auto_renew_months", "12", "12"), ("auto_renew_months", "1 year (12 months)", "12"),
    ("sla_credit_percent", "10%", "10"), ("sla_credit_percent", "7.5", "7.5"), ("sla_credit_percent", "1.2.3", None),
    ("sla_credit_percent", "ten (10)", "10"), ("sla_credit_percent", "1,000", None),
    ("invoice_hours", "0", "0"), ("invoice_hours", "7.5 hours", "7.5"), ("invoice_hours", "eight (8)", "8"),
    ("governing_law", "3 states", None), ("unheard_of", "3", None),
    ("liability_cap", "the lesser of three (3) times the fees and $5,000,000", None),
    ("liability_cap", "150% of annual fees", None), ("liability_cap", "fees multiplied by 2", None),
    ("liability_cap", "$1.1234567", None), ("liability_cap", "$1.1234560", "1.123456"),
]


def test_magnitudes(spark):
    rows = spark.createDataFrame([(i, p, r) for i, (p, r, _) in enumerate(CASES)], "i int, p string, r string")
    got = {r.i: r for r in rows.select("i", V.number_text(V.magnitude("p", "r")).alias("n")).collect()}
    assert [(c[0], c[1], got[i].n) for i, c in enumerate(CASES)] == [tuple(c) for c in CASES]


def test_reasons(spark):
    rows = spark.createDataFrame([("liability_cap", " "), ("liability_cap", "percent of fees"),
                                  ("liability_cap", "much"), ("liability_cap", "$5")], "p string, r string")
    got = [r[0] for r in rows.withColumn("m", V.magnitude("p", "r")).select(
        V.not_comparable_reason("r", "m")).collect()]
    assert got == ["empty", "a formula rather than an amount, so it has no magnitude to compare",
                   "not in a form that can be read as a number", None]


@pytest.mark.parametrize("text, expected", [
    ("effective 2024-06-01 or 2025-01-01", datetime.date(2024, 6, 1)),
    ("03/04/2025", datetime.date(2025, 3, 4)), ("2024-02-30, else 2024-03-01", None), ("13/45/2024", None),
    ("1 June 2024", None), ("0000-01-01", None), (None, None),
])
def test_dates(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(V.parse_date("t")).first()[0] == expected


def test_number_text(spark):
    rows = spark.createDataFrame([(Decimal(x),) for x in ("0", "19500", "0.5", "-20", "100.1")], "n decimal(18,6)")
    assert [r[0] for r in rows.select(V.number_text("n")).collect()] == ["0", "19500", "0.5", "-20", "100.1"]


def test_identity_and_names(spark):
    rows = spark.createDataFrame([
        (" ACME\u00a0 Ltd\n", "Out-of-Hours", "C:\\in\\a-b.md/"), ("Straße", "All trades — standard", "/in/x.tar.gz"),
        ("x", " — ", "plain"), ("y", None, ""),
    ], "s string, k string, u string")
    got = [tuple(r) for r in rows.select(T.subject_key("s"), T.scope_key("k"), T.basename("u"), T.suffix("u")).collect()]
    assert got == [("acme ltd", "out of hours", "a-b.md", ".md"), ("strasse", "all trades standard", "x.tar.gz", ".gz"),
                   ("x", None, "plain", ""), ("y", None, "", "")]


def test_quotes_and_hash_text(spark):
    rows = spark.createDataFrame([("it's",), ('say "it\'s"',), ("a\\b\n",), ("plain",)], "s string")
    assert [r[0] for r in rows.select(T.quoted("s")).collect()] == [repr(r.s) for r in rows.collect()]
    odd = spark.createDataFrame([("a \t\r\nb\u00a0\rc\n\n",)], "s string")
    assert odd.select(T.content_text("s")).first()[0] == "a\nb\nc"


def test_markdown_fold_keeps_length(spark):
    text = "  >> a | **b**\n# c > d\n> > e"
    got = spark.createDataFrame([(text,)], "s string").select(T.fold_markdown("s")).first()[0]
    assert got == "     a     b  \n  c > d\n  > e" and len(got) == len(text)
