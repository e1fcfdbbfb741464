"""A small corpus of our own, and responders that answer the way a model would."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = {
    "agreement.md": (
        "MASTER AGREEMENT with Harbour Works Ltd\n\n"
        "kind=msa vendor=Harbour Works Ltd date=2024-01-01\n\n"
        "The hourly rate is $100.00 per hour.\n\nInvoices are due net 45 days.\n\n"
        "The liability cap is $900,000 in aggregate.\n\nThe annual fees are $300,000.\n\n"
        "This agreement is governed by the laws of Norway."
    ),
    "change-1.md": (
        "AMENDMENT\n\nkind=amendment vendor=HARBOUR WORKS LTD date=2024-06-01\n\n"
        "The hourly rate is $120 per hour."
    ),
    "bill-july.txt": (
        "INVOICE\n\nkind=invoice vendor=Harbour Works Ltd date=2024-07-15\n\n"
        "Billed rate $100 for 10 hours, amount $1,100.00."
    ),
    "notes.docx": "not readable here",
}
AMENDMENT_2 = (
    "AMENDMENT TWO\n\nkind=amendment vendor=Harbour Works Ltd date=2024-09-01\n\n"
    "Invoices are due net 30 days."
)

PATTERNS = {
    "hourly_rate": r"hourly rate is (\$[\d.]+ per hour)",
    "payment_terms_days": r"due (net \d+ days)",
    "liability_cap": r"liability cap is (\$[\d,]+ in aggregate)",
    "annual_fees": r"annual fees are (\$[\d,]+)",
    "governing_law": r"laws of (\w+)",
    "invoice_rate": r"rate (\$\d+) for",
    "invoice_hours": r"for (\d+ hours)",
    "invoice_amount": r"amount (\$[\d,.]+)",
}


def write(folder: Path, letters: dict[str, str]) -> str:
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in letters.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


class Counter:
    """Counts the documents a responder was asked about."""

    def __init__(self, spark):
        self.seen = spark.sparkContext.accumulator(0)


def _classify(text: str) -> str:
    kind, vendor, date = re.search(r"kind=(\w+) vendor=(.+) date=([\d-]+)", text).groups()
    return json.dumps({"kind": kind, "vendor": vendor, "document_date": date, "confidence": 0.95,
                       "fits_kind": True, "reasoning": "says so"})


def _extract(text: str) -> str:
    facts = []
    for predicate, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            facts.append({"predicate": predicate, "subject": "x", "value_raw": m.group(1),
                          "confidence": 0.9, "quote": m.group(0)})
    return json.dumps({"facts": facts, "instruction_like_spans": []})


def responder(kind: str, counter: Counter | None = None):
    answer = {"classify": _classify, "extract": _extract}[kind]

    def respond(documents: DataFrame) -> DataFrame:
        def batches(frames):
            for frame in frames:
                if counter is not None:
                    counter.seen.add(len(frame))
                yield frame.assign(response_text=frame["text"].map(answer))[["document_id", "response_text"]]
        return documents.select("document_id", F.col("text")).mapInPandas(
            batches, "document_id string, response_text string")
    return respond
