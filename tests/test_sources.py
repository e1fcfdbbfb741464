"""Files in, tables, files out."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from concordat.operators import publish as P
from concordat.sources import inbox
from concordat.sources.lines import numbered_lines
from concordat.sources.register_file import register_rows, write_register
from concordat.sources.rules import NOT_A_RULE, rules_frame
from concordat.sources.tables import Tables
from letters import write


def test_scan_reads_supported_files_only(spark, tmp_path):
    write(tmp_path / "in", {"a.md": "x", "B.TXT": "y", "c.docx": "z", ".DS_Store": "q"})
    (tmp_path / "in" / "bad.txt").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "in" / "p.pdf").write_bytes(b"%PDF")
    got = {r.uri.rsplit("/", 1)[-1]: (r.mime, r.text) for r in inbox.scan_documents(spark, str(tmp_path / "in")).collect()}
    assert got["a.md"] == ("text/markdown", "x") and got["B.TXT"] == ("text/plain", "y") and got["p.pdf"] == ("application/pdf", None)
    assert got["bad.txt"][1] == "ok �� end" and set(got) == {"a.md", "B.TXT", "p.pdf", "bad.txt"}


def test_diff_by_content(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "name string, sha256 string")
    now, seen = frame({"a": "1", "b": "2", "c": "3"}), frame({"a": "1", "b": "9", "d": "4"})
    states = inbox.diff_snapshot(now, seen)
    assert dict(map(tuple, states.collect())) == {"b": "modified", "c": "added", "d": "removed"}
    assert inbox.is_triggered(states).first()[0] is True
    assert inbox.is_triggered(inbox.diff_snapshot(frame({"a": "1"}), frame({"a": "1", "z": "0"}))).first()[0] is False
    two = seen.union(frame({"b": "2"}))  # both contents of b were ingested
    assert dict(map(tuple, inbox.diff_snapshot(now, two).collect())).get("b") is None


def test_runs_are_partitions(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    rows = lambda *keys: spark.createDataFrame([(k, "p", "c") for k in keys], "section_key string, part string, content string")
    tables.write_run(rows("a"), "section_parts", "c", "r1")
    tables.write_run(rows("b", "c"), "section_parts", "c", "r2")
    tables.write_run(rows("d"), "section_parts", "c", "r2")
    assert sorted((r.run_id, r.section_key) for r in tables.read("section_parts").collect()) == [("r1", "a"), ("r2", "d")]
    tables.write_run(rows("x").filter("false"), "section_parts", "c", "r2")
    tables.write_run(rows("y"), "section_parts", "c/d: e=f", "r 9")
    assert sorted((r.corpus, r.run_id, r.section_key) for r in tables.read("section_parts").collect()) == [
        ("c", "r1", "a"), ("c/d: e=f", "r 9", "y")]
    plan = tables.read("section_parts", "c", "r1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(corpus" in plan and "run_id" in plan.split("PartitionFilters")[1][:120]


def test_append_keeps_one_row_per_key(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    row = lambda k, a: (k, a, 0, "/in/x", "h" + k, "m", "c")
    frame = lambda *r: spark.createDataFrame(list(r), "document_id string, arrival string, doc_seq bigint, uri string, sha256 string, mime string, corpus string")
    for _ in range(2):
        tables.append_new(frame(row("1", "b"), row("1", "a"), row("2", "c")), "documents", ["corpus", "sha256"], "arrival", "c")
    assert sorted((r.document_id, r.arrival) for r in tables.read("documents", "c").collect()) == [("1", "a"), ("2", "c")]


def test_register_file_reads_in_order(spark, tmp_path):
    rendered = spark.createDataFrame([(f"k{i:03d}", "", f"### {i}\n\n*Status: agreed.*") for i in range(50)],
                                     "section_key string, part string, text string").repartition(5)
    write_register(register_rows(rendered, "corpus x", "0123456789"), str(tmp_path / "out"))
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    text = "".join(p.read_text(encoding="utf-8") for p in files)
    assert text.startswith("# Vendor Obligation & Exposure Register\n\nCorpus **corpus x** · run `01234567` · 50 obligations.\n\nEvery value")
    assert [int(line[4:]) for line in text.splitlines() if line.startswith("### ")] == list(range(50))


def test_published_document_is_read_back(spark):
    text = ("# Register\r\n· rev aaaa\n### A [ref:00000001]\nx · rev 11111111*\n· rev 22222222 · rev 33333333\n"
            "## no ref\n· rev 44444444\n  ### B \\[ref:00000002\\] [ref:00000003]\nnothing\n### A again [ref:00000001]\nold\n")
    docs = spark.createDataFrame([("c", text)], "corpus string, text string")
    assert sorted((r.ref, r.rev) for r in P.parse_published(P.document_lines(docs)).collect()) == [("00000001", "22222222"), ("00000002", "")]


def test_edits_cannot_be_addressed_from_inside(spark):
    hostile = "a [ REF: 1] ```\n# head\r\n  ## two"
    got = spark.createDataFrame([(hostile,)], "t string").select(P.neutralise(F.col("t"))).first()[0]
    assert got == "a [ref- 1] '''\n​# head\n​  ## two"


def test_terms_are_labelled_for_people(spark):
    terms = ["payment_terms_days", "sla_credit_percent", "hourly_rate", "days", "msa_id", "", "a__b"]
    rows = spark.createDataFrame([(t,) for t in terms], "t string")
    assert [r[0] for r in rows.select(P.humanise_term(F.col("t"))).collect()] == [
        "Payment Terms (days)", "SLA Credit (%)", "Hourly Rate", "Days", "MSA ID", "", "A B"]


def plainly_published(text):
    """ref -> (rev of the last marked line, bodies in order), line by line."""
    refs, ref = {}, None
    for line in re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", text.replace("\\", "")):
        if line.lstrip().startswith("#"):
            ref = (re.findall(r"\[ref:([0-9a-f]{8})\]", line) or [None])[0]
            if ref:
                refs.setdefault(ref, ["", []])[1].append(line)
        elif ref:
            mark = re.search(r"·[ \t]*rev[ \t]+([0-9a-f]{4,})", line)
            refs[ref] = [mark[1] if mark else refs[ref][0], [*refs[ref][1][:-1], refs[ref][1][-1] + "\n" + line]]
    return refs


def test_lines_of_long_documents(spark, monkeypatch):
    """Headings carry over any number of lines and blocks; blocks of one document go to several tasks."""
    monkeypatch.setattr(P, "LINES", 16)
    rng = random.Random(4)
    keys = [f"vendor {i}::term" for i in range(6)]
    refs = [hashlib.sha256(k.encode()).hexdigest()[:8] for k in keys]
    texts = {}
    for corpus in ("a", "b", "c"):
        lines = []
        for _ in range(400):
            lines.append(rng.choice(["text", "", f"### T [ref:{rng.choice(refs)}]", " ## no marker", "x · rev abcd12 · rev ffff", "*Status: agreed. · rev 12ab\\_*", "value 7 of", "two lines"])
                         if rng.random() < 0.4 else "plain")
        texts[corpus] = rng.choice(["\n", "\r\n", "\u2028"]).join(lines)
    texts["none"] = ""
    lines = P.document_lines(spark.createDataFrame([*texts.items(), ("null", None)], "corpus string, text string"))
    want = {c: plainly_published(t) for c, t in texts.items()}
    got = {(r.corpus, r.ref): r.rev for r in P.parse_published(lines).collect()}
    assert got == {(c, ref): rev for c, refs_ in want.items() for ref, (rev, _) in refs_.items()}
    assert lines.filter("corpus = 'a'").select("block").distinct().count() == 25
    values = ["value 7", "value 7 of\ntwo lines", "absent", "plain\nplain", None]
    edited = [(c, k, values[(i + j) % 5]) for i, c in enumerate(texts) for j, k in enumerate(keys)] + [("a", "gone::term", "x")]
    errors = {(r.corpus, r.section_key): r.error for r in P.verify_published(spark.createDataFrame(edited, "corpus string, section_key string, value string"), lines).collect()}
    for c, k, v in edited:
        body = want[c].get(hashlib.sha256(k.encode()).hexdigest()[:8])
        told = errors.get((c, k), "")
        assert ("no heading" in told) == (body is None) and ("does not contain" in told) == (body is not None and v is not None and v not in body[1][0])


def test_sections_that_share_a_marker_are_told_apart(spark, monkeypatch):
    """Two keys whose hashes start alike give a row each; a third one is not taken for them."""
    monkeypatch.setattr(P, "section_ref", lambda key: F.lit("0000000a"))
    content = '{"vendor": "%s", "term": "hourly_rate", "scope": null, "value": "%s", "status": "agreed"}'
    keys = {"a": content % ("A_x", "$1"), "b": content % ("B", "$2"), "c": content % ("C", "$3")}
    sections = spark.createDataFrame([("k", key, text) for key, text in keys.items()], "corpus string, section_key string, content string")
    text = ("### A\\_x — Hourly Rate [ref:0000000a]\n\nis **$1**\n\n· rev aaaa1111\n"
            "### B — Hourly Rate [ref:0000000a]\n\nis **$2**\n\n· rev bbbb2222\n")
    lines = P.document_lines(spark.createDataFrame([("k", text)], "corpus string, text string"))
    shared = P.sharing(sections)
    assert sorted(map(tuple, P.parse_published(lines, shared).collect())) == [("k", "0000000a", "aaaa1111"), ("k", "0000000a", "bbbb2222")]
    edited = spark.createDataFrame([("k", "a", "$1"), ("k", "b", "$2"), ("k", "c", "$3")], "corpus string, section_key string, value string")
    errors = {r.section_key: r.error for r in P.verify_published(edited, lines, shared).collect()}
    assert errors == {"c": "no heading carrying [ref:0000000a] in the document"}
    assert P.sharing(sections.filter("section_key = 'a'")).count() == 0


def test_lines_are_numbered_over_files_and_ranges(spark, tmp_path):
    texts = [["a", "", "ünï", "x" * 500, "last"], ["one"], [f"line {i}" for i in range(700)]]
    for i, lines in enumerate(texts):
        (tmp_path / f"part-{i}.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(before, ("300", "0")):
            spark.conf.set(k, v)
        got = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r.line for r in sorted(got, key=lambda r: r.number)] == sum(texts, []) and {r.number for r in got} == set(range(1, 707))


def test_playbook_tells_its_bad_lines(spark, tmp_path):
    good = '{"ruleset_id":"r","code":"A","kind":"presence_required","predicate":"p"}'
    (tmp_path / "rules.json").write_text("\n".join([good, "", "{oops", good, "[1]", good.replace('"A"', '"B"').replace("presence_required", "numeric_max")]) + "\n")
    rules, defects = rules_frame(spark, str(tmp_path / "rules.json"))
    assert {(r.number, r.code) for r in rules.collect()} >= {(1, "A"), (4, "A"), (6, "B")}
    told = {(d.number, d.problem) for d in defects.collect()}
    assert {(3, NOT_A_RULE), (4, "duplicate code 'A'"), (6, "B: numeric_max needs config.max")} <= told and {n for n, _ in told} == {3, 4, 5, 6}
