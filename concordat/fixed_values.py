"""Fixed values.

The vocabularies, constants, patterns and text templates below are part of the
data contract: results only match when they are exactly these.
"""

# --- fixed values: terms and their units ------------------------------------
TERMS = (
    "hourly_rate",
    "payment_terms_days",
    "liability_cap",
    "auto_renew_months",
    "termination_notice_days",
    "sla_credit_percent",
    "governing_law",
    "annual_fees",
    "invoice_amount",
    "invoice_rate",
    "invoice_hours",
)
UNIT_OF_TERM = {
    "hourly_rate": "USD",
    "liability_cap": "USD",
    "annual_fees": "USD",
    "invoice_amount": "USD",
    "invoice_rate": "USD",
    "invoice_hours": "hours",
    "payment_terms_days": "days",
    "termination_notice_days": "days",
    "auto_renew_months": "months",
    "sla_credit_percent": "percent",
}
FREE_TEXT_TERMS = ("governing_law",)

# --- fixed values: document kinds -------------------------------------------
DOCUMENT_KINDS = ("msa", "amendment", "sow", "invoice", "renewal_notice", "unknown")
KIND_PRECEDENCE = {
    "msa": 10,
    "sow": 20,
    "amendment": 30,
    "renewal_notice": 5,
    "invoice": 0,
    "unknown": -1,
}
DEFAULT_PRECEDENCE = -1
NON_GOVERNING_KINDS = ("invoice", "unknown", "renewal_notice")
ENGAGEMENT_KINDS = ("sow",)
KIND_DESCRIPTIONS = {
    "msa": "a master agreement establishing base terms",
    "amendment": "modifies an existing agreement, and outranks it where they disagree",
    "sow": "a statement of work, binding its own engagement only",
    "invoice": "a bill for work done — it records what was charged",
    "renewal_notice": "a notice about renewal or termination timing, which restates "
                      "terms the agreement already set",
    "unknown": "none of these kinds fits the document",
}
EFFECT_GOVERNS = "Sets terms in the register, and can supersede earlier documents."
EFFECT_OBSERVES = (
    "Recorded and reported, but governs nothing — its values cannot set or supersede a "
    "term, and will be treated as an observation that may contradict the agreement."
)

# --- fixed values: relations between terms ----------------------------------
OBSERVES = {"invoice_rate": "hourly_rate"}
ARITHMETIC_RELATIONS = (("invoice_amount", ("invoice_rate", "invoice_hours")),)
TERMS_ONLY_FOR_KIND = {
    "invoice_amount": ("invoice",),
    "invoice_rate": ("invoice",),
    "invoice_hours": ("invoice",),
}

# --- fixed values: documents and chunks -------------------------------------
MIME_OF_SUFFIX = {
    ".md": "text/markdown",
    ".txt": "text/plain",
    ".pdf": "application/pdf",
}
CLASSIFY_THRESHOLD = 0.75
EXTRACT_ATTEMPTS = 3
INSTRUCTION_MARKERS = (
    "ignore previous",
    "ignore all previous",
    "disregard the above",
    "system prompt",
    "approve all",
    "you are an ai",
    "new instructions",
)

# --- fixed values: characters -----------------------------------------------
# What counts as whitespace (Unicode, including the four ASCII separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Typographic characters and the ASCII ones they stand for, one for one.
TYPOGRAPHIC = {
    "‘": "'",
    "’": "'",
    "‚": "'",
    "‛": "'",
    "“": '"',
    "”": '"',
    "„": '"',
    "′": "'",
    "″": '"',
    "‐": "-",
    "‑": "-",
    "‒": "-",
    "–": "-",
    "—": "-",
    "―": "-",
    "−": "-",
    "\u00a0": " ",  # no-break space
    "\u2007": " ",  # figure space
    "\u202f": " ",  # narrow no-break space
    "\u200b": " ",  # zero-width space
}
MARKDOWN_MARKS = "|*_`~"
DANGLING = " \t\n\r'\"`,;:."

# --- fixed values: number and date patterns ---------------------------------
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
FORMULA = (
    r"(?i)\btimes\s+the\b|\bmultiplied\s+by\b|\bmultiple\s+of\b"
    r"|\b(?:greater|lesser|lower|higher)\s+of\b|\baggregate\s+of\b"
    r"|\bpercent\s+of\b|%\s*of\b"
)
REASON_EMPTY = "empty"
REASON_FORMULA = "a formula rather than an amount, so it has no magnitude to compare"
REASON_UNREADABLE = "not in a form that can be read as a number"

# --- fixed values: conflicts and their direction ----------------------------
EQUAL_RANK = "same_predicate_different_value"
AS_OF = "temporal_precedence"
ARITHMETIC = "arithmetic_mismatch"
CONFLICT_KINDS = (EQUAL_RANK, AS_OF, ARITHMETIC)
SIDES = {
    AS_OF: ("the value the document used", "the value that governed"),
    EQUAL_RANK: ("the first document's value", "the second document's value"),
    ARITHMETIC: ("the stated total", "its own components multiplied out"),
}
MONEY_HIGHER = " Money may be recoverable."
MONEY_LOWER = (
    " The vendor charged us less than agreed, so nothing is owed to us — a refund, "
    "credit or recovery is not the remedy here."
)
SAYS_HIGHER = (
    "higher", "greater", "exceed(?:s|ed|ing)?", "above", "more than", "in excess",
    "over-?bill(?:s|ed|ing)?", "over-?charg(?:e|es|ed|ing)",
    "over-?stat(?:e|es|ed|ing)", "over-?paid", "refund(?:s|ed)?",
    "recover(?:s|ed|y)?", "recoup(?:s|ed)?", "claw-?back", "too high", "inflated",
)
SAYS_LOWER = (
    "lower", "less than", "below", "under-?bill(?:s|ed|ing)?",
    "under-?charg(?:e|es|ed|ing)", "under-?stat(?:e|es|ed|ing)",
    "discount(?:s|ed)?", "too low", "shortfall", "short-?paid",
)
NEGATIONS = "not|never|no|nor|n't|without"
NEGATION_REACH = 12

# --- fixed values: judging ---------------------------------------------------
SEVERITIES = ("low", "medium", "high")
NOTE_NO_VERDICT = (
    "(No adjudication was returned for this candidate, so it is reported as found.)"
)
NOTE_WITHHELD = (
    "(The adjudicator described this difference in the opposite direction, so its "
    "wording was withheld and the computed one shown instead.)"
)
NOTE_UNPARSEABLE = "adjudicator returned unparseable output"

# --- fixed values: rules -----------------------------------------------------
RULE_KINDS = ("numeric_max", "numeric_min", "numeric_bound", "presence_required")

# --- fixed values: rendering -------------------------------------------------
ACRONYMS = ("sla", "msa", "sow", "kpi", "vat", "id", "sos")
UNIT_LABELS = {"days": "days", "months": "months", "years": "years", "percent": "%"}
REGISTER_TITLE = "# Vendor Obligation & Exposure Register"
REGISTER_PREFACE = (
    "Every value below was extracted from a source document and carries a citation back "
    "to the passage it came from. Values that could not be supported are stated as "
    "unsupported rather than omitted."
)
RETAINED = "The superseded values are retained as the evidence for why this one governs."

# --- fixed values: list prices, USD per million tokens (in, out) --------------
PRICES = {
    "gemini-3.6-flash": (0.30, 2.50),
    "gemini-3.1-flash-lite": (0.10, 0.40),
}
