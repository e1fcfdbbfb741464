"""What keeps the register's cost in proportion to its facts."""

import pytest
from pyspark.sql import functions as F

from concordat.fixed_values import WHITESPACE
from concordat.functions import text as T
from concordat.functions import values as V
from concordat.operators import conflicts as C
from concordat.plans import catalogue
from concordat.session import WIDE, settle
from frames import views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def fresh(monkeypatch):
    monkeypatch.setattr(catalogue, "_STORED", {})


def test_groups_are_resolved_once_a_run(spark, fresh, monkeypatch):
    calls, real = [], catalogue.reconcile.reconcile
    monkeypatch.setattr(catalogue.reconcile, "reconcile", lambda v: calls.append(v) or real(v))
    assert catalogue.versions(spark, FOLDER, 2).count() > 0
    assert catalogue.citations_of(spark, FOLDER, 2).count() > 0
    assert len(calls) == 2


def test_stored_stages_are_dealt_to_partitions_by_size(spark, fresh, monkeypatch):
    settings = {}
    monkeypatch.setattr(catalogue, "settle", lambda rows, name, given=None: settings.update({name: given}) or rows)
    catalogue.fact_table(spark, FOLDER)
    assert settings == {"fact_table": WIDE}


def test_settings_hold_for_one_write(spark):
    before = {key: spark.conf.get(key, None) for key in WIDE}
    assert settle(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "few", WIDE).count() == 7
    assert {key: spark.conf.get(key, None) for key in WIDE} == before


def _plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def _disputed(spark):
    return views(spark, ("hourly_rate", "$1", "2024-01-01", "msa"), ("hourly_rate", "$2", "2024-01-01", "msa"),
                 ("annual_fees", "$3", "2024-01-01", "msa"), ("invoice_rate", "$9", "2024-07-01", "invoice", "b"))


def test_facts_of_uncontested_groups_do_not_move(spark):
    contested = C._contested(_disputed(spark))
    assert sorted(r.fact_id for r in contested.collect()) == ["f0", "f1"]
    assert "Window" not in _plan(C.equal_rank(_disputed(spark)))


def test_own_comparators_need_no_grouping_by_pair(spark):
    v = _disputed(spark)
    once, twice = C.detect(v), C.detect(v, (*C.COMPARATORS, C.equal_rank))
    assert "_order#" not in _plan(once) and "_order#" in _plan(twice)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.count() == 2
    assert "_order#" not in _plan(C.detect(v, C.one_by_one()))


def test_texts_that_need_no_pattern_come_out_the_same(spark):
    texts = ["", "a", " a ", "a  b", "a b", "a\tb", "\u00a0a", "a\u3000 b", "a\x7fb", "a\u0085", "a \r\n b", "a \n", "\x1ca", "x\u2028", "é  è", None]
    texts += [f"a{ch}b{ch}" for ch in WHITESPACE]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", T.squash("t").alias("s"), T.content_text("t").alias("c")).collect()
    for r in got:
        if r.t is not None:
            words = "".join(" " if ch in WHITESPACE else ch for ch in r.t).split(" ")
            assert r.s == " ".join(w for w in words if w)
            lines = r.t.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            assert r.c == "\n".join(line.rstrip(WHITESPACE) for line in lines).strip(WHITESPACE)
    assert (got[15].s, got[15].c) == (None, None)


def test_formulas_in_any_case(spark):
    texts = ["3 TIMES  the fees", "Multiplied By 2", "a MULTIPLE of it", "the Lesser OF", "5 % OF", "5%of", "percent\tof fees",
             "in aggregate", "sometimes they", "offer", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(V.is_formula(F.col("t"))).collect()] == [True] * 7 + [False] * 4


def test_comparators_are_dealt_by_size(spark):
    """E1 and E2 are written with partitions by size, not with as many as the session has."""
    from concordat.plans.catalogue import QUERIES

    for name in ("e1_equal_rank", "e2_temporal_violations"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_settled_files_are_packed(spark):
    """Hashes in hex digits take half the place."""
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    files = settle(rows, "hashes").inputFiles()
    assert files and all(".zstd." in f for f in files)


def test_causes_and_failures_leave_no_shuffle_files(spark, fresh):
    for name in ("j2_change_causes", "i1_verify_whole_run"):
        plan = catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_a_claim_moves_once_for_all_its_citations(spark):
    of = lambda text, *rows: spark.createDataFrame(list(rows), text)
    failures = catalogue.verify.verify_run(
        of("claim_id string, section_key string, text string, status string", ("c", "s", "t", "supported"), ("d", "s2", "t", "supported")),
        of("claim_id string, section_key string, fact_id string", ("c", "s", "f"), ("c", "s", "g")),
        of("fact_id string, predicate string, value_raw string, chunk_id string, document_id string", ("f", "p", "1", "k", "x")),
        of("chunk_id string, text string", ("k", "1")), of("document_id string, uri string", ("x", "u")))
    anti = _plan(failures).split("LeftAnti")[1].split("Join")[0]
    assert "Aggregate [claim_id" in anti
    assert sorted((r.reason, r.fact_id) for r in failures.collect()) == [("dangling_citation", "g"), ("uncited_claim", None)]


def test_a_citation_moves_once(spark):
    """Facts meet their passages and documents by themselves; a citation meets only what was found wrong with its fact."""
    of = lambda text, *rows: spark.createDataFrame(list(rows), text)
    failures = catalogue.verify.verify_run(
        of("claim_id string, section_key string, text string, status string", ("c", "s", "t", "supported")),
        of("claim_id string, section_key string, fact_id string", ("c", "s", "f"), ("c", "s", "g"), ("c", "s", "h"), ("c", "s", None)),
        of("fact_id string, predicate string, value_raw string, chunk_id string, document_id string",
           ("f", "p", "1", "k", "x"), ("g", "p", "1", None, "x"), ("h", "p", "2", "k", "gone")),
        of("chunk_id string, text string", ("k", "1")), of("document_id string, uri string", ("x", "u")))
    assert _plan(failures).count("Join LeftOuter") == 1
    assert sorted((str(r.fact_id), r.reason, str(r.detail)) for r in failures.collect()) == [
        ("None", "dangling_citation", "None"),
        ("g", "unverifiable_citation", "Fact p='1' has no chunk recorded, so its citation cannot be re-checked against the source."),
        ("h", "dangling_citation", "Fact p='2' cites a chunk or document that no longer exists.")]


def test_published_lines_are_sectioned_once(spark, fresh, monkeypatch):
    """M2 to M5 look at the same lines in their sections, and at the same edits."""
    calls, real = [], catalogue.publish.sectioned_lines
    monkeypatch.setattr(catalogue.publish, "sectioned_lines", lambda *given: calls.append(given) or real(*given))
    for name in ("m2_parse_published", "m3_publication_counts", "m5_verify_published", "m5_publication_verified"):
        assert catalogue.QUERIES[name](spark, FOLDER).count() > 0
    assert len(calls) == 1


def test_sections_are_drawn_once(spark):
    """A section's JSON is read once for its head and its end, and not for its parts."""
    versions = spark.createDataFrame([("s", '{"vendor": "V", "term": "hourly_rate", "value": "$1", "status": "agreed"}', "0123456789")],
                                     "section_key string, content string, content_hash string")
    parts = spark.createDataFrame([("s", "superseded/1", "$2"), ("s", "superseded/2", "$3")], "section_key string, part string, content string")
    rendered = catalogue.publish.render_sections(versions, parts).select("section_key", "part", "text")
    assert _plan(rendered).count("from_json") == 1
    head, *between, end = [r.text for r in sorted(rendered.collect(), key=lambda r: r.part)]
    assert head.startswith("### V — Hourly Rate [ref:") and head.endswith("The governing **Hourly Rate** for V is **$1**.")
    assert between == ["\n\nThis supersedes $2", ", $3"] and end.endswith("this one governs.\n\n*Status: agreed. · rev 01234567*")


def test_a_rule_and_a_vendor_meet_as_two_numbers(spark):
    """Only rules with an expression need a vendor's other terms; all others compare numbers as they are stored."""
    v = views(spark, ("hourly_rate", "$3", "2024-01-01", "msa"), ("annual_fees", "no fee", "2024-01-01", "msa"))
    playbook = spark.createDataFrame([
        ("r", 0, "A", "numeric_max", "hourly_rate", "", 2, None, None, "high"), ("r", 1, "B", "numeric_min", "hourly_rate", "", None, 2, None, "high"),
        ("r", 2, "C", "numeric_max", "annual_fees", "", 2, None, None, "high"), ("r", 3, "D", "numeric_min", "hourly_rate", "", 9, None, None, "high"),
        ("r", 4, "E", "numeric_bound", "hourly_rate", "", None, None, "2 * hourly_rate - 4", "high"), ("r", 5, "F", "presence_required", "audit_rights", "", None, None, None, "high")],
        catalogue.rules.RULES.replace("decimal(18,6)", "int")).selectExpr("* EXCEPT (max, min)", "CAST(max AS DECIMAL(18,6)) AS max", "CAST(min AS DECIMAL(18,6)) AS min")
    found = catalogue.rules.evaluate_rules(catalogue.reconcile.reconcile(v), playbook).select("code", "subject", "fact_id", "checked", "severity")
    terms = spark.range(1).selectExpr("'k' AS subject_key", "'V' AS vendor", "'p' AS predicate", "1 AS fact_id", "'$1' AS value_raw", "CAST(id AS DECIMAL(18,6)) AS magnitude")
    pair = _plan(catalogue.rules._against_limits(terms, playbook, 1).filter("outcome IS NOT NULL").select("code", "fact_id"))
    assert "Join Inner" in pair and "decimal(38,12)" not in pair and "aggregate(" not in pair
    assert sorted(map(tuple, found.collect())) == [
        ("A", "Acme", "f0", True, "high"), ("C", "Acme", "f1", False, "low"), ("D", "Acme", "f0", False, "low"),
        ("E", "Acme", "f0", True, "high"), ("F", "Acme", None, True, "high")]


def test_the_plan_is_summed_up_without_composing(spark, fresh, monkeypatch):
    want = catalogue.compose.plan_summary(catalogue.versions(spark, FOLDER, 2)).first()
    reasons = {r.section_key: r.reason for r in catalogue.recomposition(spark, FOLDER, catalogue.versions(spark, FOLDER, 1)).collect()}
    monkeypatch.setattr(catalogue, "_STORED", {})
    monkeypatch.setattr(catalogue, "fact_table", None)
    monkeypatch.setattr(catalogue.compose, "section_plans", None)
    assert catalogue.QUERIES["g5_plan_summary"](spark, FOLDER).first() == want
    assert {r.section_key: r.reason for r in catalogue.QUERIES["g2_plan_recomposition"](spark, FOLDER).collect()} == reasons
