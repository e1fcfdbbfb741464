"""What governs, at all times and on a date."""

from pyspark.sql import functions as F

from concordat.operators import reconcile as R
from frames import day, views


def governing(frame):
    return {(r.subject_key, r.predicate, r.scope_key): (r.governing.fact_id if r.governing else None)
            for r in R.reconcile(frame).collect()}


def test_latest_amendment_governs_and_the_rest_is_kept(spark):
    v = views(spark, ("hourly_rate", "$100", "2024-01-01", "msa"), ("hourly_rate", "$120", "2024-06-01", "amendment"),
              ("hourly_rate", "$110", "2024-03-01", "amendment"), ("hourly_rate", "$90", None, "amendment"))
    r = R.reconcile(v).first()
    assert (r.governing.fact_id, r.status, r.n_superseded) == ("f1", "agreed", 3)
    assert {x.superseded_fact_id for x in R.supersession(v, R.reconcile(v)).collect()} == {"f0", "f2", "f3"}


def test_kind_breaks_a_tie_of_dates_and_order_breaks_the_rest(spark):
    v = views(spark, ("hourly_rate", "$1", "2024-01-01", "amendment"), ("hourly_rate", "$2", "2024-01-01", "msa"),
              ("annual_fees", "$1", "2024-01-01", "msa"), ("annual_fees", "$2", "2024-01-01", "msa"))
    assert governing(v) == {("acme", "hourly_rate", None): "f0", ("acme", "annual_fees", None): "f3"}


def test_observations_never_govern(spark):
    v = views(spark, ("payment_terms_days", "net 45", "2025-01-01", "renewal_notice"),
              ("payment_terms_days", "net 30", "2024-01-01", "msa"), ("invoice_rate", "$9", "2025-01-01", "invoice"))
    assert governing(v) == {("acme", "payment_terms_days", None): "f1", ("acme", "invoice_rate", None): None}
    rows = {r.predicate: r for r in R.reconcile(v).collect()}
    assert rows["invoice_rate"].status == "unsupported" and rows["payment_terms_days"].n_observed == 1


def test_spellings_and_scopes_meet(spark):
    v = views(spark, ("hourly_rate", "$1", "2024-01-01", "msa", None, "Out-of-Hours", "Acme  Ltd"),
              ("hourly_rate", "$2", "2024-02-01", "amendment", None, "out of hours", "ACME LTD"),
              ("hourly_rate", "$3", "2024-02-01", "amendment", None, "Grade 3", "Acme Ltd"),
              ("hourly_rate", "$4", "2024-02-01", "amendment", None, "Grade 4", "Acme Ltd"))
    assert governing(v) == {("acme ltd", "hourly_rate", "out of hours"): "f1",
                            ("acme ltd", "hourly_rate", "grade 3"): "f2", ("acme ltd", "hourly_rate", "grade 4"): "f3"}
    assert {r.vendor for r in R.reconcile(v).collect()} == {"Acme Ltd"}


def test_display_name_prefers_the_calm_spelling_on_equal_weight(spark):
    v = views(spark, ("hourly_rate", "$1", None, "msa", None, None, "ACME"), ("hourly_rate", "$1", None, "msa", None, None, "Acme"))
    assert R.display_names(v).first().vendor == "Acme"
    v = views(spark, ("hourly_rate", "$1", None, "msa", None, None, "ACME"), ("hourly_rate", "$1", None, "invoice", None, None, "Acme"))
    assert R.display_names(v).first().vendor == "ACME"


def test_value_in_force_on_a_date(spark):
    v = views(spark, ("hourly_rate", "$1", "2024-01-01", "msa"), ("hourly_rate", "$2", "2024-06-01", "amendment"),
              ("hourly_rate", "$3", "2024-06-01", "msa"), ("hourly_rate", "$9", None, "amendment"))
    probes = spark.createDataFrame([(day(d),) for d in ("2023-12-31", "2024-01-01", "2024-05-31", "2024-06-01", "2030-01-01")],
                                   "probe_date date").withColumns({
        "subject_key": F.lit("acme"), "predicate": F.lit("hourly_rate"), "scope_id": F.lit("")})
    got = {str(r.probe_date): r.in_force and r.in_force.fact_id for r in R.governing_at(v, probes).collect()}
    assert got == {"2023-12-31": None, "2024-01-01": "f0", "2024-05-31": "f0", "2024-06-01": "f1", "2030-01-01": "f1"}


def test_document_context(spark):
    facts = spark.createDataFrame(
        [("a", 1, "d1", "hourly_rate", "said", "$1", " Partner ", None), ("b", 2, "d2", "hourly_rate", "said", "$1", None, None),
         ("c", 3, "dx", "hourly_rate", "said", "$1", None, None)],
        "fact_id string, fact_seq int, document_id string, predicate string, subject string, value_raw string, "
        "qualifier string, effective_date date")
    docs = spark.createDataFrame(
        [("d1", "/in/alpha_one-two.md", "sow", "Acme", day("2024-01-01")), ("d2", "/in/b.md", None, "", None)],
        "document_id string, uri string, kind string, vendor string, document_date date")
    got = {r.fact_id: (r.subject, r.document_kind, r.scope, r.scope_key, str(r.effective_date)) for r in R.fact_views(facts, docs).collect()}
    assert got == {"a": ("Acme", "sow", "alpha one two::partner", "alpha one two partner", "2024-01-01"),
                   "b": ("said", "unknown", None, None, "None"), "c": ("said", "unknown", None, None, "None")}
