"""A run over a corpus, and the commit of what a reviewer decided.

Every stage is a lazy DataFrame step; results are written where several later stages
read them.  The driver looks at counts only: unreadable kinds, candidates, failures.
Writing a run again replaces its own rows, so a run that broke off is simply started
once more under the same id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.fixed_values import CLASSIFY_THRESHOLD, DOCUMENT_KINDS
from concordat.functions import text as T
from concordat.functions.numbering import with_index
from concordat.functions.values import parse_date
from concordat.functions.vocabulary import governed_term
from concordat.operators import adjudicate, changes, classify, compose, conflicts, enrich, extract
from concordat.operators import ingest, maintain, reconcile, reports, review, rules, verify
from concordat.plans.run_metrics import RunMetrics, Spent
from concordat.session import settle
from concordat.sources.rules import standard_rules
from concordat.sources.tables import RUN, Tables

Responder = Callable[[DataFrame], DataFrame]
FACTS_PER_DOCUMENT = 1 << 20


@dataclass(frozen=True)
class RunResult:
    run_id: str
    status: str
    plan: dict = field(default_factory=dict)
    verification: dict = field(default_factory=dict)
    skipped: tuple = ()


def _no_findings(spark) -> DataFrame:
    return spark.createDataFrame([], "severity string, target_kind string, explanation string")


def _record(tables: Tables, corpus: str, run_id: str, **columns) -> None:
    row = {"parent_run_id": None, "ended_at": None, "current_stage": None, "stage_detail": None, **columns}
    names = ["parent_run_id", "status", "started_at", "ended_at", "current_stage", "stage_detail"]
    schema = "parent_run_id string, status string, started_at timestamp, ended_at timestamp, current_stage string, stage_detail string"
    frame = tables.spark.createDataFrame([tuple(row.get(n) for n in names)], schema).coalesce(1)
    tables.write_run(frame, "runs", corpus, run_id)


def _of_corpus(tables: Tables, name: str, corpus: str) -> DataFrame:
    return tables.read(name, corpus)


# --- stages ------------------------------------------------------------------------


def ingest_documents(tables: Tables, corpus: str, arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store unseen documents and their chunks; (ids of all arrived ones, findings).

    Arrivals are settled without their texts; only texts of unseen content are written.
    """
    readable, findings = ingest.partition_readable(arrived)
    readable = readable.withColumn("corpus", F.lit(corpus))
    light = settle(readable.drop("text"), "arrived")
    known = _of_corpus(tables, "documents", corpus)
    fresh = settle(ingest.dedupe_documents(light, known), "fresh")
    ids = light.select("uri", ingest.document_id("corpus", "sha256").alias("document_id"))
    if not fresh.isEmpty():
        texts = settle(readable.select("arrival", "text").join(fresh, "arrival"), "fresh_texts")
        # Chunks first: a document counts as ingested only once its chunks are there.
        chunks = ingest.chunk_documents(texts).withColumn("corpus", F.lit(corpus))
        tables.append_new(chunks, "chunks", ["corpus", "chunk_id"], "chunk_id", corpus)
        offset = known.agg(F.coalesce(F.max("doc_seq") + 1, F.lit(0))).first()[0]
        numbered = with_index(fresh, [], F.col("arrival"), "doc_seq").withColumn(
            "doc_seq", F.col("doc_seq") + F.lit(offset))
        tables.append_new(numbered, "documents", ["corpus", "sha256"], "arrival", corpus)
    seen = _of_corpus(tables, "arrivals", corpus).select("uri", "document_id")
    held = ids.distinct().join(seen, ["uri", "document_id"], "left_anti")
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    tables.append(held.withColumns({"arrived_at": F.lit(now).cast("timestamp"), "corpus": F.lit(corpus)}), "arrivals", "corpus")
    return ids.select("document_id").distinct(), findings


def documents_at(tables: Tables, corpus: str, paths: DataFrame) -> DataFrame:
    """Ids of the documents that some paths (uri) held when they last arrived."""
    first = _of_corpus(tables, "documents", corpus).select("uri", "document_id", F.lit("1970-01-01").cast("timestamp").alias("arrived_at"))
    seen = _of_corpus(tables, "arrivals", corpus).select("uri", "document_id", "arrived_at").unionByName(first)
    latest = seen.groupBy("uri").agg(
        F.max_by("document_id", F.struct("arrived_at", "document_id")).alias("document_id"))
    return latest.join(paths.select("uri"), "uri", "left_semi").select("document_id").distinct()


def decided_kinds(tables: Tables, corpus: str) -> DataFrame:
    """What each document is: a human's answer, else the classifier's."""
    rows = _of_corpus(tables, "document_kinds", corpus)
    human = F.col("decided_by") == "human"
    pick = lambda c, when: F.max(F.when(when, F.col(c)))
    return rows.groupBy("document_id").agg(
        F.coalesce(pick("kind", human), pick("kind", ~human)).alias("kind"),
        F.coalesce(pick("kind_confidence", human), pick("kind_confidence", ~human)).alias("kind_confidence"),
        pick("vendor", ~human).alias("vendor"), pick("document_date", ~human).alias("document_date"),
    )


def documents_with_kinds(tables: Tables, corpus: str) -> DataFrame:
    return _of_corpus(tables, "documents", corpus).join(decided_kinds(tables, corpus), "document_id", "left")


def _texts(tables: Tables, corpus: str, documents: DataFrame) -> DataFrame:
    chunks = _of_corpus(tables, "chunks", corpus).join(documents.select("document_id"), "document_id", "left_semi")
    return documents.select("document_id", "uri").join(ingest.document_text(chunks), "document_id")


def ask(tables: Tables, corpus: str, spent: Spent, asked: DataFrame, by: str, answer: Responder,
        model: str, prompt_version: str) -> DataFrame:
    """(`by`, response_text) for every request; only what the stored cache does not have is asked."""
    asked = settle(asked, "asked")
    keys = settle(enrich.keyed_requests(asked, by, spent.stage, model, prompt_version), "keys")

    def keep(answers: DataFrame) -> None:
        observed, seen = spent.observed(answers.withColumns({"corpus": F.lit(corpus), "prefix": enrich.key_prefix()}))
        tables.append(observed, "response_cache", "corpus", "prefix")
        spent.add(seen)

    answers, requests, calls = enrich.ask_once(
        asked, keys, by, answer, lambda prefixes: _of_corpus(tables, "response_cache", corpus).filter(F.col("prefix").isin(prefixes)),
        keep, {"stage": spent.stage, "model": model, "prompt_version": prompt_version})
    spent.model = model
    spent.cache_hits, spent.cache_misses = spent.cache_hits + requests - calls, spent.cache_misses + calls
    return answers


def _keep_findings(tables: Tables, corpus: str, run_id: str, staged: DataFrame) -> None:
    rows = staged.withColumn("seen_in_run", F.lit(run_id)).withColumn("corpus", F.lit(corpus))
    tables.append_new(rows, "document_findings", ["corpus", "seen_in_run", "stage", "finding_key"], "finding_key", corpus)


def classify_documents(tables: Tables, corpus: str, run_id: str, ids: DataFrame, answer: Responder,
                       threshold: float, organisation: str | None, spent: Spent, model: str, prompt_version: str) -> None:
    """Classify documents seen for the first time; doubtful ones stay without a kind."""
    documents = _of_corpus(tables, "documents", corpus).join(ids, "document_id", "left_semi")
    todo = documents.join(_of_corpus(tables, "document_kinds", corpus), "document_id", "left_anti")
    texts = settle(_texts(tables, corpus, todo), "texts")
    answers = ask(tables, corpus, spent, texts, "document_id", answer, model, prompt_version)
    parsed = classify.parse_classifications(answers).join(texts, "document_id")
    judged = settle(parsed.withColumn(
        "reason", classify.escalation_reason(threshold, organisation)).drop("text", "text_at_offsets"), "classified")
    rows = judged.select(
        "document_id", F.lit("classifier").alias("decided_by"),
        F.when(F.col("reason").isNull(), F.col("kind")).alias("kind"),
        F.col("confidence").alias("kind_confidence"), T.none_if_empty("vendor").alias("vendor"),
        "document_date", F.lit(corpus).alias("corpus"),
    )
    doubtful = classify.escalation_findings(judged.filter(F.col("reason").isNotNull()))
    _keep_findings(tables, corpus, run_id, review.staged(doubtful, "classify", "document_id"))
    tables.append_new(rows, "document_kinds", ["corpus", "document_id", "decided_by"], "document_id", corpus)


def answer_escalations(tables: Tables, corpus: str, answers: DataFrame) -> None:
    """Store what a human said a document is (document_id, answer)."""
    kind = F.lower(T.strip("answer"))
    rows = answers.select(
        "document_id", F.lit("human").alias("decided_by"), kind.alias("kind"),
        F.lit(1.0).alias("kind_confidence"), F.lit(None).cast("string").alias("vendor"),
        F.lit(None).cast("date").alias("document_date"), F.lit(corpus).alias("corpus"),
    ).filter(F.col("kind").isin(*DOCUMENT_KINDS))
    tables.append_new(rows, "document_kinds", ["corpus", "document_id", "decided_by"], "document_id", corpus)


def extract_facts(tables: Tables, corpus: str, run_id: str, ids: DataFrame, answer: Responder,
                  version: str, spent: Spent, model: str, prompt_version: str) -> tuple[DataFrame, DataFrame]:
    """Store the facts of documents not yet read by this extractor, and the findings on them: (documents read now, their facts)."""
    documents = documents_with_kinds(tables, corpus).join(ids, "document_id", "left_semi")
    pending, _ = extract.pending_documents(documents, _of_corpus(tables, "facts", corpus), version)
    pending = settle(pending, "pending")
    texts = _texts(tables, corpus, pending).drop("text").withColumnRenamed("text_at_offsets", "text")
    answers = ask(tables, corpus, spent, texts, "document_id", answer, model, f"{version}/{prompt_version}")
    responses = settle(extract.read_extractions(answers), "responses")
    facts, unquoted, spans, failed = extract.split_extractions(responses)
    chunks = _of_corpus(tables, "chunks", corpus).join(pending.select("document_id"), "document_id", "left_semi")
    cited, unresolved = extract.split_located(settle(extract.locate_quotes(facts, chunks), "located"))
    kept, gated = extract.gate_terms(cited, pending)
    rows = settle(
        extract.normalize_facts(kept.withColumn("effective_date", parse_date("date_text")))
        .join(pending.select("document_id", "doc_seq"), "document_id")
        .withColumns({
            "fact_seq": F.col("doc_seq") * FACTS_PER_DOCUMENT + F.col("position"),
            "fact_id": F.sha2(F.concat_ws("\n", "document_id", F.lit(version), F.col("position").cast("string")), 256),
            "chunk_id": F.when(F.col("chunk_ordinal").isNotNull(), F.concat_ws(
                "#", "document_id", F.col("chunk_ordinal").cast("string"))),
            "extractor_version": F.lit(version), "corpus": F.lit(corpus),
        }), "facts")
    rejected = unquoted.select("document_id", "position", "predicate", "value_raw", "reason").unionByName(
        unresolved.select("document_id", "position", "predicate", F.col("value_as_given").alias("value_raw"), "reason"))
    found = [extract.failure_findings(failed, pending), gated, extract.unnormalised_findings(rows, pending),
             extract.rejection_findings(rejected, pending), extract.span_findings(spans, pending)]
    staged = [review.staged(part.distinct(), "extract", *[k for k in ("document_id", "position") if k in part.columns])
              for part in found]
    _keep_findings(tables, corpus, run_id, reduce(DataFrame.unionByName, staged))
    tables.append_new(rows, "facts", ["corpus", "fact_id"], "fact_id", corpus)
    return pending, rows


@dataclass(frozen=True)
class Maintained:
    """The register's facts after a batch; touched holds the facts of the groups it touched, groups their keys."""

    resolutions: DataFrame
    candidates: DataFrame
    touched: DataFrame
    groups: DataFrame
    present: DataFrame


def _facts_of(tables: Tables, corpus: str, documents: DataFrame, version: str, read_now: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Facts of documents: those this run has read are at hand; stored ones are looked up only for the rest."""
    pending, rows = read_now
    at_hand = rows.select(*[f.name for f in tables.schema("facts")]).join(documents.select("document_id"), "document_id", "left_semi")
    others = documents.select("document_id").join(pending.select("document_id"), "document_id", "left_anti")
    if others.isEmpty():
        return at_hand
    stored = _of_corpus(tables, "facts", corpus).filter(F.col("extractor_version") == version)
    return at_hand.unionByName(stored.join(others, "document_id", "left_semi"))


def maintain_register(tables: Tables, corpus: str, run_id: str, parent: str | None, documents: DataFrame,
                      version: str, read_now: tuple[DataFrame, DataFrame]) -> Maintained:
    """What the parent run knew of groups and contradictions, brought up to date with the documents of this run.

    A document counts anew when what is known about it (kind, vendor, date, name, extractor) differs from
    the parent run.  A run without parent finds every document new, so it is the same work.
    """
    before = lambda name: (tables.read(name, corpus, parent) if parent
                           else tables.spark.createDataFrame([], tables.schema(name)))
    about = F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("\t")) for c in ("kind", "vendor", "document_date", "uri")], F.lit(version))
    now, earlier = documents.select("document_id", F.sha2(about, 256).alias("signature")), before("run_documents")
    if parent and earlier.isEmpty():
        return maintain_register(tables, corpus, run_id, None, documents, version, read_now)
    changed = settle(maintain.document_changes(now, earlier), "changes")
    of_state = lambda state: changed.filter(F.col("state") == state).select("document_id")
    batch = f"{run_id}-{uuid.uuid4().hex[:8]}"  # a run that is repeated leaves alone what others refer to
    arrived = settle(documents.join(of_state("came"), "document_id", "left_semi"), "came_documents")
    views = reconcile.fact_views(_facts_of(tables, corpus, arrived, version, read_now).drop("unit"), arrived)
    came = tables.write_batch(views.select(*maintain.VIEW).withColumn("bucket", maintain.bucket()), "fact_views", corpus, batch, "bucket")
    standing = earlier.join(of_state("standing"), "document_id", "left_semi").select("document_id", "signature", "batch")
    fresh = now.join(of_state("came"), "document_id", "left_semi").withColumn("batch", F.lit(batch))
    present = tables.write_run(standing.unionByName(fresh), "run_documents", corpus, run_id).select("document_id", "batch")

    stored = _of_corpus(tables, "fact_views", corpus)
    left = earlier.join(of_state("gone"), "document_id", "left_semi").select("document_id", "batch")
    gone = None if left.isEmpty() else settle(stored.join(left, ["document_id", "batch"], "left_semi"), "gone")
    groups = settle(maintain.touched_groups(came, *([] if gone is None else [gone])), "groups")
    touched = settle(maintain.facts_of_groups(stored, groups).join(present, ["document_id", "batch"], "left_semi"), "touched")
    states = tables.write_run(maintain.maintain_states(before("group_states"), came, gone, touched).filter("n_governing + n_observed > 0"),
                              "group_states", corpus, run_id)
    names = tables.write_run(maintain.maintain_spellings(before("vendor_spellings"), came, gone), "vendor_spellings", corpus, run_id)
    return Maintained(
        settle(reconcile.resolve(states, names), "resolutions"),
        maintain.maintain_candidates(before("candidates"), groups, touched, came, gone), touched, groups, present)


def _facts_to_compose(tables: Tables, corpus: str, due: DataFrame, known: Maintained) -> DataFrame:
    """Facts of the sections to compose: those of touched groups, unless older logic made other sections due too."""
    of_due = due.select("subject_key", governed_term("predicate").alias("governed_predicate"), "scope_id").distinct()
    if of_due.join(known.groups, reconcile.TERM_GROUP, "left_anti").isEmpty():
        return known.touched
    wanted = settle(of_due.withColumn("bucket", maintain.bucket()), "due_groups")
    facts = maintain.facts_of_groups(_of_corpus(tables, "fact_views", corpus), wanted)
    return facts.join(known.present, ["document_id", "batch"], "left_semi")


def compose_register(tables: Tables, corpus: str, run_id: str, parent: str | None, known: Maintained, version: str) -> DataFrame:
    """Write this run's versions, parts, claims and citations."""
    before = lambda name: (tables.read(name, corpus, parent) if parent
                           else tables.spark.createDataFrame([], tables.schema(name)))
    plan = settle(compose.plan_recomposition(known.resolutions, before("section_versions"), version), "plan")
    due = settle(compose.rederived(known.resolutions, plan), "due")
    views = _facts_to_compose(tables, corpus, due, known)
    versions = tables.write_run(compose.apply_plan(plan, compose.section_plans(views, due), run_id, version),
                                "section_versions", corpus, run_id)
    carried = versions.filter("carried_forward")
    parts = compose.section_parts(views, due)
    kept = before("section_parts").select("section_key", "part", "content").join(
        carried.select("section_key"), "section_key", "left_semi")
    tables.write_run(parts.unionByName(kept), "section_parts", corpus, run_id)
    claims = tables.write_run(compose.claims_for(versions, before("claims")), "claims", corpus, run_id)
    cited = compose.citations_for(
        claims, versions, compose.section_facts(views, due), before("citations"))
    tables.write_run(cited, "citations", corpus, run_id)
    return versions


# --- the run -------------------------------------------------------------------------


def previous_run_of(tables: Tables, corpus: str, other_than: str = "") -> str | None:
    completed = tables.read("runs", corpus).filter((F.col("status") == "completed") & (F.col("run_id") != other_than))
    row = reports.list_runs(completed, 1).select("run_id").first()
    return row.run_id if row else None


def start_run(tables: Tables, corpus: str, run_id: str, arrived: DataFrame,
              classifier: Responder, extractor: Responder, judge: Responder | None = None,
              playbook: list | None = None, threshold: float = CLASSIFY_THRESHOLD,
              organisation: str | None = None, include_retained: bool = False,
              extractor_version: str = extract.EXTRACTOR_VERSION,
              composer_version: str = compose.COMPOSER_VERSION,
              model: str = "", prompt_version: str = "1", present: DataFrame | None = None) -> RunResult:
    """Bring the register of a corpus up to date with the documents that are there.

    `arrived` holds all documents present (uri, sha256, text, arrival); where `present` names all paths
    there are (uri), only those that have not been ingested before.  The responders
    map (document_id, uri, text) to (document_id, response_text), and candidates to
    (batch_id, response_text).  Documents known by content are neither classified nor
    extracted again, and sections whose facts stand are copied.  All three are asked through
    the stored cache: ``model`` and ``prompt_version`` say when an answer no longer holds.
    """
    spark = tables.spark
    started = datetime.now(timezone.utc).replace(tzinfo=None)
    parent = previous_run_of(tables, corpus, run_id)
    note = lambda status, **more: _record(tables, corpus, run_id, parent_run_id=parent, status=status,
                                          started_at=started, **more)
    metrics = RunMetrics(tables, corpus, run_id)
    note("running", current_stage="ingest")
    with metrics.stage("ingest"):
        ids, skipped_files = ingest_documents(tables, corpus, arrived)
        if present is not None:
            ids = ids.unionByName(documents_at(tables, corpus, present)).distinct()
        ids = settle(ids, "ids")

    note("running", current_stage="classify")
    with metrics.stage("classify") as spent:
        classify_documents(tables, corpus, run_id, ids, classifier, threshold, organisation, spent, model, prompt_version)
    open_questions = documents_with_kinds(tables, corpus).join(ids, "document_id", "left_semi").filter(
        F.col("kind").isNull())
    if not open_questions.isEmpty():
        note("awaiting_review", current_stage="classify", stage_detail="documents need a human to say what they are")
        return RunResult(run_id, "awaiting_classification")

    note("running", current_stage="extract")
    with metrics.stage("extract") as spent:
        read_now = extract_facts(tables, corpus, run_id, ids, extractor, extractor_version, spent, model, prompt_version)

    documents = documents_with_kinds(tables, corpus)
    counted = documents if include_retained else documents.join(ids, "document_id", "left_semi")
    note("running", current_stage="detect")
    with metrics.stage("detect"):
        known = maintain_register(tables, corpus, run_id, parent, counted, extractor_version, read_now)
        found = tables.write_run(adjudicate.batch_candidates(known.candidates), "candidates", corpus, run_id)
    skipped, judged_findings = (), _no_findings(spark).withColumn("a_fact_id", F.lit("")).withColumn(
        "b_fact_id", F.lit("")).withColumn("kind", F.lit(""))
    if found.isEmpty():
        skipped = ("adjudicate",)
        tables.write_run(spark.createDataFrame([], tables.schema("conflicts")), "conflicts", corpus, run_id)
    else:
        with metrics.stage("adjudicate") as spent:
            asked = conflicts.with_direction(found).drop(*RUN)
            answers = (ask(tables, corpus, spent, asked, "batch_id", judge, model, prompt_version) if judge
                       else spark.createDataFrame([], "batch_id bigint, response_text string"))
            judged = settle(adjudicate.check_explanations(adjudicate.apply_verdicts(found, answers)), "judged")
            settled = _of_corpus(tables, "conflicts", corpus).filter(F.col("run_id") != run_id)
            new, judged_findings, _ = adjudicate.merge_conflicts(judged, settled)
            judged_findings = settle(judged_findings, "judged_findings")
            tables.write_run(new, "conflicts", corpus, run_id)

    note("running", current_stage="compose")
    with metrics.stage("compose"):
        versions = compose_register(tables, corpus, run_id, parent, known, composer_version)

    note("running", current_stage="examine")
    with metrics.stage("examine"):
        try:
            applied = rules.load_rules(spark.createDataFrame(playbook, rules.RULES)) if playbook is not None \
                else standard_rules()
            broken = settle(rules.rule_findings(rules.link_sections(rules.evaluate_rules(known.resolutions, applied), versions)), "broken")
        except rules.RulesRefused as refused:
            broken = rules.refused_finding(spark, str(refused)).withColumn("code", F.lit("")).withColumn(
                "subject_key", F.lit(""))

    note("running", current_stage="verify")
    with metrics.stage("verify"):
        claims, citations = tables.read("claims", corpus, run_id), tables.read("citations", corpus, run_id)
        failures = settle(verify.verify_run(claims, citations, _of_corpus(tables, "facts", corpus),
                                            _of_corpus(tables, "chunks", corpus), documents), "failures")
        summary = verify.verification_summary(claims, citations, failures).first().asDict()

    stages = [
        review.staged(skipped_files, "ingest", "uri"),
        _of_corpus(tables, "document_findings", corpus).filter(F.col("seen_in_run") == run_id),
        review.staged(judged_findings, "adjudicate", "kind", "a_fact_id", "b_fact_id"),
        review.staged(broken, "examine", "code", "subject_key"),
        review.staged(verify.verification_findings(failures), "verify", "claim_id", "fact_id"),
    ]
    findings = review.assemble_findings(*stages).withColumn(
        "finding_id", F.sha2(F.concat_ws("\n", F.lit(run_id), "stage", "finding_key"), 256)
    ).withColumn("status", F.lit("open"))
    stored = tables.write_run(_with_prior_verdicts(tables, corpus, findings), "findings", corpus, run_id)
    plan = compose.plan_summary(versions).first().asDict()
    # A stage that had nothing to do must not look like one that is missing.
    detail = "skipped, nothing to judge: adjudicate" if skipped else None
    if not summary["passed"]:
        status = "failed"
        note(status, ended_at=datetime.now(timezone.utc).replace(tzinfo=None))
        return RunResult(run_id, "blocked_by_verification", plan, summary, skipped)
    if stored.isEmpty():
        note("completed", ended_at=datetime.now(timezone.utc).replace(tzinfo=None), stage_detail=detail)
        return RunResult(run_id, "completed", plan, summary, skipped)
    note("awaiting_review", stage_detail=detail)
    return RunResult(run_id, "awaiting_review", plan, summary, skipped)


def _with_prior_verdicts(tables: Tables, corpus: str, findings: DataFrame) -> DataFrame:
    """Findings with the newest verdict on the same words; only the index partitions of their hashes are read."""
    found = settle(findings, "found")
    prefixes = [r[0] for r in found.select(F.left(review.explanation_hash(), F.lit(2))).distinct().collect()]  # 256 at most
    return review.indexed_verdicts(found, _of_corpus(tables, "verdict_index", corpus).filter(F.col("prefix").isin(prefixes)))


def review_run(tables: Tables, corpus: str, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a reviewer sees of a run: (queue with fresh findings before carried ones, counts, what the parent raised and this run does not)."""
    queue = review.review_queue(tables.read("findings", corpus, run_id))
    parent = tables.read("runs", corpus, run_id).first().parent_run_id
    before = tables.read("findings", corpus, parent) if parent else tables.spark.createDataFrame([], tables.schema("findings"))
    return queue, review.queue_counts(queue), review.resolved_findings(before, tables.read("findings", corpus, run_id))


def sweep_runs(tables: Tables, corpus: str) -> list[str]:
    """L5 over stored runs, before new ones start: those still marked running were cut off; their ids."""
    cut = reports.mark_interrupted(tables.read("runs", corpus).filter(F.col("status") == "running"))
    runs = cut.collect()  # one row per process that died, not per document
    for run in runs:
        _record(tables, corpus, run.run_id, parent_run_id=run.parent_run_id, status=run.status, started_at=run.started_at,
                ended_at=run.ended_at, current_stage=run.current_stage, stage_detail=run.stage_detail)
    return sorted(run.run_id for run in runs)


def run_states(tables: Tables, corpus: str) -> DataFrame:
    """L6 over stored runs: blocked, awaiting review or classification, else what the run says of itself."""
    runs, findings = tables.read("runs", corpus), tables.read("findings", corpus)
    broken = findings.filter(F.col("stage") == "verify").select("run_id", F.lit(False).alias("passed"))
    asked = runs.filter((F.col("status") == "awaiting_review") & (F.col("current_stage") == "classify"))
    return reports.run_status(runs, broken, asked.select("run_id"), findings.filter(F.col("status") == "open").select("run_id"))


def commit_run(tables: Tables, corpus: str, run_id: str, decisions: DataFrame, actor: str = "human") -> RunResult:
    """Close a run with a reviewer's verdicts (finding_index, verdict)."""
    run = tables.read("runs", corpus, run_id).first()
    if run is None or run.status != "awaiting_review" or run.current_stage is not None:
        raise ValueError(f"run {run_id} is not awaiting review")
    # Read to a copy first: the findings partition is about to be replaced.
    findings = settle(tables.read("findings", corpus, run_id), "findings")
    closed, log = review.commit_decisions(findings, review.carried_decisions(findings, decisions), actor)
    ended = datetime.now(timezone.utc).replace(tzinfo=None)
    log = log.join(findings.select("finding_index", "finding_id"), "finding_index").withColumns({
        "decision_id": F.sha2(F.concat_ws("\n", F.lit("decision"), "finding_id"), 256),
        "created_at": F.lit(ended).cast("timestamp"),
    })
    log = tables.write_run(log, "decisions", corpus, run_id)
    tables.append(review.verdict_rows(findings, log).withColumn("corpus", F.lit(corpus)), "verdict_index", "corpus", "prefix")
    tables.write_run(closed, "findings", corpus, run_id)
    _record(tables, corpus, run_id, parent_run_id=run.parent_run_id, status="completed",
            started_at=run.started_at, ended_at=ended, stage_detail=run.stage_detail)
    return RunResult(run_id, "completed")


def run_changes(tables: Tables, corpus: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(change log, causes) of a run against its parent."""
    parent = tables.read("runs", corpus, run_id).first().parent_run_id
    before = lambda name: (tables.read(name, corpus, parent) if parent
                           else tables.spark.createDataFrame([], tables.schema(name)))
    facts, documents = _of_corpus(tables, "facts", corpus), _of_corpus(tables, "documents", corpus)
    log = settle(changes.build_changes(tables.read("section_versions", corpus, run_id), before("section_versions")), "changes")
    moved = changes.moved_sections(log)
    causes = changes.change_causes(
        log, changes.citing_documents(tables.read("citations", corpus, run_id), facts, documents, moved),
        changes.citing_documents(before("citations"), facts, documents, moved))
    return log, causes
