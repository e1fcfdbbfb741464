"""The stored cache in front of responders, and what a run meters of itself."""

import json

import pytest
from pyspark.sql import functions as F

from concordat.operators import enrich, reports
from concordat.plans import register_run as R
from concordat.plans.run_metrics import STAGES, Spent
from concordat.sources.inbox import scan_documents
from concordat.sources.tables import Tables
from letters import LETTERS, Counter, responder, write


def shout(counter, fails=()):
    def respond(asked):
        def batches(frames):
            for frame in frames:
                if set(frame["text"]) & set(fails):
                    raise ConnectionError("gone")
                counter.seen.add(len(frame))
                yield frame.assign(response_text=[None if t == "mute" else t.upper() for t in frame["text"]])[["document_id", "response_text"]]
        return asked.mapInPandas(batches, "document_id string, response_text string")
    return respond


def through(tables, asked, answer, spent=None, at_once=10_000, version="1"):
    spent = spent or Spent("classify")
    keys = enrich.keyed_requests(asked, "document_id", "classify", "m", version)

    def keep(rows):
        observed, seen = spent.observed(rows.withColumns({"corpus": F.lit("c"), "prefix": enrich.key_prefix()}))
        tables.append(observed, "response_cache", "corpus", "prefix")
        spent.add(seen)

    answers, requests, calls = enrich.ask_once(
        asked, keys, "document_id", answer, lambda prefixes: tables.read("response_cache", "c").filter(F.col("prefix").isin(prefixes)),
        keep, {"stage": "classify", "model": "m", "prompt_version": version}, at_once)
    return {r.document_id: r.response_text for r in answers.collect()}, requests, calls


def test_rounds_that_were_kept_are_not_asked_again(spark, tmp_path):
    tables, counter = Tables(spark, str(tmp_path)), Counter(spark)
    asked = spark.createDataFrame([(f"d{i}", f"text {i % 8}") for i in range(12)] + [("quiet", "mute")], "document_id string, text string")
    with pytest.raises(Exception, match="gone"):
        through(tables, asked, shout(counter, fails={"text 7"}), at_once=2)
    kept = tables.read("response_cache", "c").count()
    answers, requests, calls = through(tables, asked, shout(counter), at_once=2)
    assert (requests, calls) == (13, 9 - kept) and answers == {f"d{i}": f"TEXT {i % 8}" for i in range(12)} | {"quiet": None}
    stored = tables.read("response_cache", "c")
    assert stored.count() == stored.select("cache_key").distinct().count() == 8
    # Only what had no answer is asked again; another prompt version asks everything.
    assert through(tables, asked, shout(counter))[1:] == (13, 1)
    assert through(tables, asked, shout(counter), version="2")[2] == 9
    assert through(tables, asked.limit(0), shout(counter)) == ({}, 0, 0)


def test_only_partitions_of_asked_keys_are_read(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    asked = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(40)], "document_id string, text string")
    through(tables, asked, shout(Counter(spark)))
    one = enrich.keyed_requests(asked.limit(1), "document_id", "classify", "m", "1").select(enrich.key_prefix()).first()[0]
    read = tables.read("response_cache", "c").filter(F.col("prefix").isin([one]))
    assert len(read.inputFiles()) and "prefix" in read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_unchanged_run_with_a_judge_asks_nothing(spark, tmp_path):
    tables, inbox = Tables(spark, str(tmp_path / "tables")), write(tmp_path / "inbox", LETTERS)
    classified, extracted, judged = Counter(spark), Counter(spark), Counter(spark)

    def judge(candidates):
        def batches(frames):
            for frame in frames:
                judged.seen.add(len(frame))
                for batch, rows in frame.groupby("batch_id"):
                    verdicts = [{"index": int(i), "is_real_conflict": True, "severity": "high", "explanation": "It differs."} for i in rows["index"]]
                    yield rows.head(1).assign(response_text=json.dumps({"verdicts": verdicts}), tokens_in=7, tokens_out=3)[["batch_id", "response_text", "tokens_in", "tokens_out"]]
        return candidates.mapInPandas(batches, "batch_id bigint, response_text string, tokens_in int, tokens_out int")

    asked = []
    for run in ("r1", "r2"):
        R.start_run(tables, "c", run, scan_documents(spark, inbox), judge=judge, model="m",
                    classifier=responder("classify", classified), extractor=responder("extract", extracted))
        R.commit_run(tables, "c", run, spark.createDataFrame([], "finding_index bigint, verdict string"))
        asked.append((classified.seen.value, extracted.seen.value, judged.seen.value))
    assert asked[0] == asked[1] and min(asked[0]) > 0
    metrics = {r: {m.stage: m for m in tables.read("stage_metrics", "c", r).collect()} for r in ("r1", "r2")}
    assert all(set(m) == set(STAGES) for m in metrics.values())
    first, second = metrics["r1"], metrics["r2"]
    assert (first["classify"].cache_misses, first["extract"].cache_misses, first["adjudicate"].cache_misses) == (3, 3, 1)
    assert (first["adjudicate"].tokens_in, first["adjudicate"].tokens_out) == (7, 3)
    assert (second["adjudicate"].cache_hits, second["adjudicate"].cache_misses, second["adjudicate"].tokens_in) == (1, 0, 0)
    assert not first["adjudicate"].skipped and all(m.seconds > 0 for m in first.values())
    costs = {(r.run_id, r.stage): r for r in reports.run_costs(tables.read("stage_metrics", "c")).collect()}
    assert costs["r1", "adjudicate"].tokens_in == 7 and costs["r2", None].tokens_in == 0 and costs["r1", None].cache_misses == 7
    findings = tables.read("findings", "c", "r2").filter("stage = 'adjudicate'").collect()
    assert findings and all(f.severity == "high" and "It differs." in f.explanation for f in findings)
