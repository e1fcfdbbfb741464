"""Sections: content, parts, and what is copied instead of derived."""

import hashlib
import json

from pyspark.sql import functions as F

from concordat.operators import compose as C
from concordat.operators import publish as P
from concordat.operators import reconcile as R
from frames import views

VERSIONS = ("version_id string, section_key string, content string, content_hash string, fact_digest string, "
            "composer_version string, carried_forward boolean")


def history(n=9):
    return [("hourly_rate", f"${i}", f"2024-01-{1 + i % 5:02d}", "msa") for i in range(n)] + [
        ("hourly_rate", f"${100 + i}", f"2024-02-{1 + i % 3:02d}", "renewal_notice") for i in range(n)]


def plans(v):
    return C.section_plans(v, R.reconcile(v))


def next_run(v, before, run="r2"):
    r = R.reconcile(v)
    plan = C.plan_recomposition(r, before)
    return C.apply_plan(plan, C.section_plans(v, C.rederived(r, plan)), run)


def first_run(v):
    return next_run(v, v.sparkSession.createDataFrame([], VERSIONS), "r1")


def bag(frame, *columns):
    return sorted(map(str, frame.select(*columns).collect()))


def test_content_is_canonical_json_with_its_hash(spark):
    v = views(spark, ("hourly_rate", "$1", "2024-01-01", "msa"), ("hourly_rate", "$2", "2024-02-01", "amendment"),
              ("hourly_rate", "$3 é", None, "renewal_notice"))
    row = plans(v).first()
    expected = json.dumps({
        "vendor": "Acme", "term": "hourly_rate", "scope": None, "value": "$2", "normalized": "USD",
        "effective_date": "2024-02-01", "governing_source": "amendment", "status": "agreed"}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert row.content == expected
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    parts = [(p.part, p.content) for p in C.section_parts(v, R.reconcile(v)).orderBy("part").collect()]
    assert parts == [("observed/" + "2".zfill(20), "$3 é"), ("superseded/2024-01-01/011/" + "0".zfill(20), "$1")]
    halves = [[int(digest(f"{p} {digest(c)}")[a:a + 15], 16) for p, c in parts] for a in (0, 15)]
    assert row.content_hash == digest(f"{digest(expected)} 2:{sum(halves[0])}:{sum(halves[1])}")
    assert row.governing_fact_id == "f1" and row.n_facts == 3


def test_parts_list_every_value_in_reading_order(spark):
    v = views(spark, *history())
    parts = [(p.part.split("/")[0], p.content) for p in C.section_parts(v, R.reconcile(v)).orderBy("part").collect()]
    order = sorted(range(9), key=lambda i: (1 + i % 5, i))
    assert [c for role, c in parts if role == "superseded"] == [f"${i}" for i in order[:-1]]
    assert [c for role, c in parts if role == "observed"] == [f"${100 + i}" for i in range(9)]


def test_hash_of_a_section_sees_every_entry(spark):
    one, other = history(), history()
    other[3] = ("hourly_rate", "$33", *other[3][2:])
    a, b = (plans(views(spark, *f)).first() for f in (one, other))
    again = plans(views(spark, *one).repartition(7)).first()
    assert a.content == b.content and a.content_hash != b.content_hash and a.content_hash == again.content_hash


def test_sections_of_any_size_are_laid_out_alike(spark):
    for n in (1, 2, 300):
        v = views(spark, *history(n))
        row = plans(v).first()
        assert row.n_facts == 2 * n and "superseded" not in row.content
        assert C.section_parts(v, R.reconcile(v)).count() == 2 * n - 1


def test_rows_render_to_the_whole_section(spark):
    v = views(spark, *history(4))
    rows = P.render_sections(first_run(v), C.section_parts(v, R.reconcile(v))).orderBy("part").collect()
    text = "".join(x.text for x in rows)
    assert text.endswith("*") and "is **$3**, effective 2024-01-04, per the msa.\n\nThis supersedes $0, $1, $2. " in text
    assert len(rows) == 2 + 3


def test_unchanged_facts_carry_and_new_ones_rederive(spark):
    base = [("hourly_rate", "$1", "2024-01-01", "msa"), ("annual_fees", "$9", "2024-01-01", "msa")]
    before = first_run(views(spark, *base))
    after = C.plan_recomposition(R.reconcile(views(spark, *base, ("hourly_rate", "$2", "2024-02-01", "amendment"),
                                                   ("governing_law", "Norway", None, "msa"))), before)
    assert {r.section_key: r.reason for r in after.collect()} == {
        "acme::hourly_rate": "facts changed", "acme::annual_fees": None, "acme::governing_law": "new"}


def test_carried_sections_are_copied_not_derived(spark):
    v = views(spark, ("hourly_rate", "$1", "2024-01-01", "msa"))
    odd = first_run(v).withColumn("content", F.lit("written long ago")).withColumn("content_hash", F.lit("h"))
    row = next_run(v, odd).first()
    assert (row.content, row.content_hash, row.carried_forward) == ("written long ago", "h", True)
    assert row.prev_version_id == odd.first().version_id


def test_new_logic_rederives_once(spark):
    v = views(spark, ("hourly_rate", "$1", "2024-01-01", "msa"))
    before = first_run(v)
    for old in (F.lit(None).cast("string"), F.lit("0")):
        older = before.withColumn("composer_version", old)
        assert C.plan_recomposition(R.reconcile(v), older).first().reason == "logic changed"
    assert C.plan_recomposition(R.reconcile(v), next_run(v, older)).first().reason is None


def test_no_section_is_rederived_to_the_bytes_it_had(spark):
    base = [("hourly_rate", "$1", "2024-01-01", "msa"), ("annual_fees", "$9", "2024-01-01", "msa"),
            ("auto_renew_months", "12", None, "sow")]
    before = first_run(views(spark, *base))
    v = views(spark, *base, ("annual_fees", "$10", "2025-01-01", "amendment")).repartition(5)
    after = next_run(v, before)
    both = after.join(before.select("section_key", F.col("content_hash").alias("old")), "section_key")
    assert both.filter("NOT carried_forward AND content_hash = old").count() == 0
    assert both.filter("carried_forward AND content_hash <> old").count() == 0


def test_claims_and_citations(spark):
    v = views(spark, ("hourly_rate", "$1", "2024-01-01", "msa"), ("hourly_rate", "$2", None, "invoice"),
              ("annual_fees", "$3", None, "msa"), ("invoice_hours", "7", "2024-01-01", "invoice"))
    r = R.reconcile(v)
    versions = first_run(v)
    none = spark.createDataFrame([], "section_key string, text string, status string")
    claims = C.claims_for(versions, none)
    assert {x.section_key: (x.text, x.status) for x in claims.collect()} == {
        "acme::hourly_rate": ("Acme: hourly_rate is $1, per the msa, effective 2024-01-01.", "supported"),
        "acme::annual_fees": ("Acme: annual_fees is $3, per the msa.", "supported"),
        "acme::invoice_hours": ("Acme: no supported value for invoice_hours.", "unsupported")}
    cited = C.citations_for(claims, versions, C.section_facts(v, r), spark.createDataFrame([], "section_key string, fact_id string"))
    assert bag(cited, "section_key", "fact_id") == bag(C.section_facts(v, r), "section_key", "fact_id")


def test_order_of_input_does_not_matter(spark):
    v = views(spark, *history(20))
    assert bag(plans(v), "content_hash") == bag(plans(v.orderBy(F.rand(1)).repartition(6)), "content_hash")
