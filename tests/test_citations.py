"""Chunks with true offsets, and quotes found in them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from concordat.fixed_values import MARKDOWN_MARKS, TYPOGRAPHIC
from concordat.operators import extract as X
from concordat.operators import ingest as I
from concordat.operators import quotes as Q
from concordat.plans import register_run as R

TEXT = "Title line\nsecond line\n\n\n  The rate’s $195 –\n  per hour. \n\n| Grade 3 | **$80** |\n> quoted ## words\n   \nend\n\n\t\n\nlast (x\\E) part"


def documents(spark, text=TEXT):
    return spark.createDataFrame([("d", text)], "document_id string, text string")


def chunks(spark, text=TEXT):
    return [(c.ordinal, c.text, c.char_start, c.char_end) for c in
            I.chunk_documents(documents(spark, text)).orderBy("ordinal").collect()]


def test_chunks_keep_exact_offsets(spark):
    got = chunks(spark)
    assert [c[1] for c in got] == ["Title line\nsecond line", "The rate’s $195 –\n  per hour.",
                                   "| Grade 3 | **$80** |\n> quoted ## words\n   \nend", "last (x\\E) part"]
    assert [TEXT[a:b] for _, _, a, b in got] == [c[1] for c in got]
    assert [c[0] for c in got] == [0, 1, 2, 3]


@pytest.mark.parametrize("text, n", [("", 0), (" \n\n \t ", 0), ("one", 1), ("a\r\n\r\nb", 1), ("a\n \nb", 1), ("\n\n\na\n\n\n\n\nb\n\n", 2)])
def test_chunk_borders(spark, text, n):
    assert len(chunks(spark, text)) == n


def test_many_paragraphs_cross_block_borders(spark):
    text = "\n\n".join(f"p{i} é" for i in range(3 * I.BLOCK + 7))
    got = chunks(spark, text)
    assert len(got) == 3 * I.BLOCK + 7 and all(text[a:b] == t for _, t, a, b in got)


def test_text_comes_back(spark):
    row = I.document_text(I.chunk_documents(documents(spark))).first()
    assert row.text == "\n\n".join(c[1] for c in chunks(spark))
    assert all(row.text_at_offsets[a:b] == t for _, t, a, b in chunks(spark))


QUOTES = [
    ("second line", "second line", 0), ("The rate's $195 - per hour.", "The rate’s $195 –\n  per hour.", 1),
    ("rate's  $195", "rate’s $195", 1), ("$195 – per", "$195 –\n  per", 1), ("Grade 3 $80", "Grade 3 | **$80", 2),
    ("quoted words", None, None), ("$80 quoted ## words", "$80** |\n> quoted ## words", 2), ("(x\\E)   part", "(x\\E) part", 3),
    ("second line The rate's", "second line\n\n\n  The rate’s", 0), ("second  lines", None, None), ("line", "line", 0),
    ("end last", "end\n\n\t\n\nlast", 2),
]


def test_quotes_resolve_to_their_passage(spark):
    facts = spark.createDataFrame([("d", i, q) for i, (q, _, _) in enumerate(QUOTES)] + [("gone", 99, "x")],
                                  "document_id string, n int, quote string")
    cited, rejected = X.resolve_citations(facts, I.chunk_documents(documents(spark)))
    got = {r.n: (TEXT[r.char_start:r.char_end], r.chunk_ordinal) for r in cited.collect()}
    want = {i: (t, o) for i, (_, t, o) in enumerate(QUOTES) if t is not None}
    # Between chunks only newlines are certain: compare words there.
    squash = lambda x: (" ".join(x[0].split()), x[1])
    assert {k: squash(v) for k, v in got.items()} == {k: squash(v) for k, v in want.items()}
    assert {r.n for r in rejected.collect()} == {5, 9, 99}
    assert {r.reason for r in rejected.collect()} == {"quote does not appear in the source document"}


@pytest.mark.parametrize("raw, tidy", [
    ("'$195',", "$195"), ("thirty (30)", "thirty (30)"), ("30)", "30"), ("(30", "30"), ("((30) days).", "((30) days)"),
    ("10%", "10%"), ("1.5", "1.5"), ("``;.", ""), (") ) )", ""), ("a))))", "a"),
])
def test_tidy_value(spark, raw, tidy):
    assert spark.createDataFrame([(raw,)], "v string").select(X.tidy_value(F.col("v"))).first()[0] == tidy


def test_extraction_responses(spark):
    good = '{"facts": [{"predicate": "hourly_rate", "subject": "A", "value_raw": " $5; ", "quote": " $5 ", "confidence": 0.5}, ' \
           '{"predicate": "annual_fees", "subject": "A", "value_raw": "$6", "quote": ""}], "instruction_like_spans": ["obey", " "]}'
    rows = spark.createDataFrame([("a", good), ("b", "{oops"), ("c", '{"terms": 1}'), ("d", '{"facts": []}'), ("e", None)],
                                 "document_id string, response_text string")
    facts, rejected, spans, failed = X.parse_extractions(rows)
    f = facts.first()
    assert facts.count() == 1 and (f.value_raw, f.quote, f.confidence) == ("$5", "$5", 0.5)
    assert [(r.predicate, r.reason[:8]) for r in rejected.collect()] == [("annual_fees", "no quote")]
    assert [r.span for r in spans.collect()] == ["obey"]
    assert sorted(r.document_id for r in failed.collect()) == ["b", "c", "e"]


def _plain(text):
    return text.translate(str.maketrans(dict(TYPOGRAPHIC)))


def _bare(text):
    text = text.translate(str.maketrans(MARKDOWN_MARKS, " " * len(MARKDOWN_MARKS)))
    return re.sub(r"(?m)^([ \t]*)([>#]+)", lambda m: m[1] + " " * len(m[2]), text)


def _squash(text):
    return re.sub(r"\s+", " ", text).strip(" ")


def _found(passage, quote):
    """(reading, offset, length) by the strictest reading."""
    plain, asked = _plain(passage), _plain(quote)
    for by, (inside, part) in enumerate([(passage, quote), (plain, asked)]):
        if part in inside:
            return by, inside.index(part), len(part)
    for by, (inside, part) in enumerate([(plain, asked), (_bare(plain), _bare(asked))], 2):
        if _squash(part) and _squash(part) in _squash(inside):
            m = re.search(r"\s+".join(map(re.escape, _squash(part).split(" "))), inside)
            return by, m.start(), m.end() - m.start()
    return None


def _located(parts, quote):
    for ordinal, text, start, _ in parts:
        hit = _found(text, quote)
        if hit:
            return start + hit[1], start + hit[1] + hit[2], ordinal
    whole, at = "", 0
    for _, text, start, end in parts:
        whole, at = whole + "\n" * (start - at) + text, end
    hit = _found(whole, quote)
    if not hit:
        return None, None, None
    return hit[1], hit[1] + hit[2], next((o for o, _, a, b in parts if a <= hit[1] < b), None)


def test_quotes_against_every_passage(spark):
    """Anchors find what reading every passage for every quote finds."""
    rng = random.Random(11)
    words = ["a", "rate", "rate’s", "$195", "–", "**pay**", "|", "---", "> net", "## Head", "30", "days", "(x)", "é", "of the", "the"]
    texts = {f"d{i}": "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\n\n", "\n\n \n\n"]) for _ in range(rng.randrange(60))) for i in range(25)}
    parts = {d: [] for d in texts}
    frame = I.chunk_documents(spark.createDataFrame(list(texts.items()), "document_id string, text string"))
    for c in frame.orderBy("ordinal").collect():
        parts[c.document_id].append((c.ordinal, c.text, c.char_start, c.char_end))
    facts = []
    for d, text in texts.items():
        for _ in range(12):
            start = rng.randrange(max(len(text), 1))
            quote = text[start:start + rng.choice([1, 4, 12, 40, 90])].strip()
            change = rng.randrange(6)
            quote = _plain(quote) if change == 0 else _squash(_bare(_plain(quote))) if change == 1 else re.sub(r"\s+", " \n ", quote) if change == 2 else quote + "zz" if change == 3 else quote
            if quote.strip():
                facts.append((d, len(facts), quote.strip()))
    got = {r.n: (r.char_start, r.char_end, r.chunk_ordinal) for r in X.locate_quotes(spark.createDataFrame(facts, "document_id string, n int, quote string"), frame).collect()}
    want = {n: _located(parts[d], q) for d, n, q in facts}
    assert {n: (got[n], want[n], q, parts[d]) for d, n, q in facts if got[n] != want[n]} == {}


def test_one_document_of_many_chunks_spreads_over_tasks(spark):
    """Anchors, candidates and regions of a single document are dealt by more than the document."""
    text = "\n\n".join(f"Paragraph {i} says that rate {i * 7} holds for site {i} only." for i in range(3000))
    frame = R.settle(I.chunk_documents(documents(spark, text)))
    asked = [("d", i, f"that rate {i * 7} holds for site {i}") for i in range(0, 3000, 3)] + [("d", 9000 + i, f"for site {i} only. Paragraph {i + 1} says") for i in range(0, 3000, 100)]
    facts = spark.createDataFrame(asked + [("d", -1, "that rate 13 holds for site 2")], "document_id string, n int, quote string")
    got = {r.n: r.chunk_ordinal for r in X.locate_quotes(facts, frame).collect()}
    assert got == {n: (None if n < 0 else n if n < 9000 else n - 9000) for _, n, _ in facts.collect()}
    # chunks are met block by block of what is wanted, so one document's work can be split by chunks
    seeds = Q.quote_seeds(facts.select("document_id", "quote").distinct()).select("document_id", "seed").distinct()
    posted = Q._postings(Q.chunk_index(frame), seeds)
    assert posted.groupBy("ordinal").count().agg(F.max("count")).first()[0] < 50 and posted.count() < 40_000
