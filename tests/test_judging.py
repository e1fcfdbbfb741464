"""Classification, rules, verdicts, verification, review."""

from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from concordat.functions.direction import claimed_sign
from concordat.operators import adjudicate, classify, enrich, reconcile, review, rules, verify
from concordat.sources.rules import rules_frame, standard_rules
from frames import views

CLAIMS = [
    ("The billed rate is higher than agreed.", 1), ("It is lower.", -1), ("It is not higher than agreed.", None),
    ("It isn't higher than agreed.", 1), ("Not in dispute; the total exceeds the sum.", 1), ("above one but below another", None),
    ("We were over-billed", 1), ("No refund is due.", None), ("a discount was given", -1), ("nothing to say", None),
    ("never, ever under any view too high", 1), ("without a shortfall", None), ("HIGHER", 1), ("highers", None),
]


def test_claimed_direction(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLAIMS)], "i int, t string")
    got = dict(map(tuple, rows.select("i", claimed_sign(F.col("t"))).collect()))
    assert [(t, got[i]) for i, (t, _) in enumerate(CLAIMS)] == CLAIMS


RESPONSES = [
    ('{"kind": "msa", "vendor": " A ", "document_date": "2024-01-02", "confidence": 0.9, "fits_kind": true, "reasoning": " r "}',
     ("msa", "A", 0.9, True)),
    ('{"kind": "msa", "vendor": "A", "confidence": 7, "fits_kind": true}', ("msa", "A", 1.0, True)),
    ('{"kind": "msa", "vendor": "A", "confidence": -1, "fits_kind": "true"}', ("msa", "A", 0.0, False)),
    ('{"kind": "msa", "confidence": "x"}', ("msa", "", 0.0, False)),
    ('{"kind": "letter", "vendor": "A", "confidence": 1}', ("unknown", "A", 0.0, True)),
    ('{"kind": "MSA", "confidence": 1}', ("unknown", "", 0.0, True)),
    ("no json", ("unknown", "", 0.0, True)), ('{"kind": "msa", ', ("unknown", "", 0.0, True)),
    ('{"vendor": "A", "confidence": 0.8, "fits_kind": true}', ("unknown", "A", 0.8, True)),
]


def test_classification_responses(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RESPONSES)], "document_id int, response_text string")
    got = {r.document_id: (r.kind, r.vendor, r.confidence, r.fits_kind) for r in classify.parse_classifications(rows).collect()}
    assert [got[i] for i in range(len(RESPONSES))] == [w for _, w in RESPONSES]


def test_escalation_order(spark):
    rows = spark.createDataFrame([
        (1, "unknown", 0.99, False, "Our Firm"), (2, "msa", 0.99, False, "Our Firm"), (3, "msa", 0.74, True, "Our Firm"),
        (4, "msa", 0.75, True, "Our Firm"), (5, "msa", 0.9, True, "their firm"), (6, "msa", 0.9, True, "OUR \n firm ltd")],
        "document_id int, kind string, confidence double, fits_kind boolean, text string")
    accepted, escalated = classify.route_escalations(rows, organisation="our  firm")
    assert sorted(r.document_id for r in accepted.collect()) == [4, 6]
    reasons = {r.document_id: r.reason for r in escalated.collect()}
    assert reasons[1].startswith("the classifier declined") and "nearest available kind" in reasons[2]
    assert reasons[3] == "confidence 0.74 is below the 0.75 threshold" and reasons[5].startswith("the document never names 'our  firm'")
    assert classify.route_escalations(rows)[1].filter("document_id = 5").count() == 0


def test_rules_at_their_limits(spark):
    v = views(spark, ("payment_terms_days", "net 30", None, "msa"), ("auto_renew_months", "13", None, "msa"),
              ("termination_notice_days", "29 days", None, "msa"), ("liability_cap", "$5", None, "msa"),
              ("hourly_rate", "$1", None, "msa", None, None, "Other"), ("payment_terms_days", "net 99", None, "msa", None, "grade 1"))
    found = rules.evaluate_rules(reconcile.reconcile(v), standard_rules())
    got = {(r.subject, r.code): (r.checked, r.severity) for r in found.collect()}
    assert got == {("Acme", "RENEW-01"): (True, "medium"), ("Acme", "NOTICE-01"): (True, "medium"),
                   ("Acme", "LIAB-01"): (False, "low"), ("Acme", "LAW-01"): (True, "low"), ("Other", "LAW-01"): (True, "low")}


@pytest.mark.parametrize("expr, value", [
    ("2 * a", 6), ("1+2*3", 9), ("a - 1 - 1", 1), (" 2*a ", None), (" 2*a", 6), ("2 *", None), ("2 a", None), ("b", None), ("", None),
    ("1.5 * a", Decimal("4.5")), ("a", 3), ("* a", None), ("2 ** a", None), ("(a)", None), ("a / 2", None),
])
def test_bounds(spark, expr, value):
    rows = spark.createDataFrame([(expr, {"a": Decimal(3)})], "e string, m map<string,decimal(18,6)>")
    assert rows.select(rules.bound_value(F.col("e"), F.col("m"))).first()[0] == value


def test_playbook_is_refused_as_a_whole(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"ruleset_id":"r","position":1,"code":"A","kind":"numeric_max","predicate":"p"}\n')
    with pytest.raises(rules.RulesRefused, match="numeric_max needs config.max"):
        rules.load_rules(rules_frame(spark, str(tmp_path / "r.json"))[0])
    good = spark.createDataFrame(standard_rules(), rules.RULES)
    assert [r.code for r in rules.load_rules(good).orderBy("position").collect()] == ["LIAB-01", "PAY-01", "RENEW-01", "NOTICE-01", "LAW-01"]
    twice = good.union(good.withColumn("position", F.col("position") + 10))
    assert rules.validate_rules(twice).filter("problem LIKE 'duplicate%'").count() == 5


def test_values_still_in_their_passage(spark):
    cases = [("$195", "the rate is $195.00", True), ("$195.00", "195 USD", True), ("Norway", "laws of\n NORWAY", False),
             ("norway", "laws of Norway", True), ("the  Law", "of the law", True), ("$100", "21 days", True), ("$250", "no digits", False),
             ("0", "zero 5", False), ("", "x", True)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, v string, t string")
    got = dict(map(tuple, rows.select("i", verify.value_present(F.col("v"), F.col("t"))).collect()))
    # Words are compared without regard to case once blanks are squashed.
    want = {i: w for i, (_, _, w) in enumerate(cases)} | {2: True}
    assert got == want


def test_verification_reasons(spark):
    claims = spark.createDataFrame([("c1", "s1", "t", "supported"), ("c2", "s2", "t", "supported"), ("c3", "s3", "t", "unsupported")],
                                   "claim_id string, section_key string, text string, status string")
    cites = spark.createDataFrame([("c1", "s1", f) for f in ("ok", "lost", "nochunk", "gone", "moved")],
                                  "claim_id string, section_key string, fact_id string")
    facts = spark.createDataFrame([("ok", "p", "$5", "k1", "d"), ("nochunk", "p", "$5", None, "d"), ("gone", "p", "$5", "k9", "d"),
                                   ("moved", "p", "$7", "k1", "d")],
                                  "fact_id string, predicate string, value_raw string, chunk_id string, document_id string")
    chunks = spark.createDataFrame([("k1", "it is $5")], "chunk_id string, text string")
    docs = spark.createDataFrame([("d", "/in/d.md")], "document_id string, uri string")
    failures = verify.verify_run(claims, cites, facts, chunks, docs)
    assert {(r.fact_id, r.reason) for r in failures.collect()} == {
        (None, "uncited_claim"), ("lost", "dangling_citation"), ("nochunk", "unverifiable_citation"),
        ("gone", "dangling_citation"), ("moved", "citation_does_not_resolve")}
    assert verify.verification_summary(claims, cites, failures).first().asDict() == {
        "claims_checked": 3, "citations_checked": 5, "failures": 5, "passed": False}


def test_verdict_edge_cases(spark):
    cands = spark.createDataFrame([(0, i, "same_predicate_different_value", 1, Decimal(2), "USD", f"d{i}") for i in range(6)]
                                  + [(1, 0, "same_predicate_different_value", 1, Decimal(2), "USD", "d")],
                                  "batch_id bigint, index int, kind string, sign int, delta decimal(38,12), unit string, detail string")
    text = ('{"verdicts": [{"index": 0, "is_real_conflict": false, "severity": "high", "explanation": "x"},'
            '{"index": 0, "is_real_conflict": true, "severity": "low", "explanation": "last wins"},'
            '{"index": "1", "severity": "odd", "explanation": ""}, {"index": null}, {"index": 2, "explanation": "It is lower."},'
            '{"index": 3, "is_real_conflict": false, "severity": "low", "explanation": " y "}]}')
    answers = spark.createDataFrame([(0, text), (1, "[")], "batch_id bigint, response_text string")
    judged = adjudicate.check_explanations(adjudicate.apply_verdicts(cands, answers))
    got = {(r.batch_id, r["index"]): (r.is_real_conflict, r.severity, r.explanation) for r in judged.collect()}
    assert got[0, 0] == (True, "low", "last wins") and got[0, 1] == (True, "medium", "d1") and got[0, 3] == (False, "low", "y")
    assert got[0, 2][2].startswith("Direction, computed: the first document's value is HIGHER than the second document's value, by $2. d2 (The")
    assert got[0, 4][2].startswith("d4 (No adjudication") and got[1, 0][2] == "d (adjudicator returned unparseable output.)"


def test_numbers_are_dense_and_stable(spark):
    rows = spark.range(5000).select(F.lit("examine").alias("stage"), F.col("id").cast("string").alias("finding_key"),
                                    F.lit("low").alias("severity"), F.lit("rule").alias("target_kind"), F.lit("same text").alias("explanation"))
    early = rows.limit(10).withColumn("stage", F.lit("ingest"))
    one, two = (review.assemble_findings(a, b) for a, b in ((rows, early), (early.repartition(3), rows.repartition(7))))
    assert sorted(r.finding_index for r in one.collect()) == list(range(5010))
    assert {r.finding_index for r in one.filter("stage = 'ingest'").collect()} == set(range(10))
    key = lambda f: {(r.stage, r.finding_key): r.finding_index for r in f.collect()}
    assert key(one) == key(two)


def test_cached_enrichment_asks_once(spark):
    requests = spark.createDataFrame([(1, "extract", "m", "v1", "text \r\n"), (2, "extract", "m", "v1", "text"), (3, "extract", "m", "v2", "text"),
                                      (4, "classify", "m", "v1", "text")], "request_id int, stage string, model string, prompt_version string, input string")
    asked = spark.sparkContext.accumulator(0)

    def answer(frames):
        for f in frames:
            asked.add(len(f))
            yield f.assign(response_text="r:" + f.stage + f.prompt_version, tokens_in=1, tokens_out=2).drop(columns="input")

    from concordat.session import settle
    none = spark.createDataFrame([], enrich.CACHE)
    _, stored, counts = enrich.enrich_cached(requests, none, answer, settle)
    assert asked.value == 3
    assert {r.stage: (r.cache_hits, r.cache_misses) for r in counts.collect()} == {"extract": (1, 2), "classify": (0, 1)}
    responses, _, counts = enrich.enrich_cached(requests, stored, answer, settle)
    assert {r.request_id: r.response_text for r in responses.collect()} == {1: "r:extractv1", 2: "r:extractv1", 3: "r:extractv2", 4: "r:classifyv1"}
    assert asked.value == 3 and counts.agg(F.sum("cache_misses")).first()[0] == 0
