"""Inputs for the operators, derived from the given tables.

Each text below is one SELECT that reads the same in Spark SQL and in other engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# What FACTS is made of: a line with its names, and what it states.
LINE_COLUMNS = """  SELECT l.l_orderkey AS ok, l.l_partkey AS pk, CAST(l.l_quantity AS BIGINT) AS qty,
         p.p_brand AS brand, s.s_name AS vendor, CAST(o.o_orderdate AS DATE) AS odate,
         CAST(round(p.p_retailprice * 100) AS BIGINT) AS cents,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey,
           l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_shipdate) AS ln,
         CASE o.o_orderpriority WHEN '1-URGENT' THEN 'amendment' WHEN '2-HIGH' THEN 'msa'
           WHEN '3-MEDIUM' THEN 'sow' WHEN '5-LOW' THEN 'invoice'
           ELSE CASE WHEN o.o_orderkey % 2 = 0 THEN 'renewal_notice' ELSE 'unknown' END END AS kind
"""
NAMED_LINES = """named AS (
  SELECT *, ok * 1000 + ln * 10 AS fid,
    CASE WHEN ok % 5 = 0 THEN upper(vendor) WHEN ok % 7 = 0 THEN '  ' || vendor || ' ' ELSE vendor END AS subject,
    CASE WHEN pk % 3 = 0 THEN CASE WHEN ok % 2 = 0 THEN brand ELSE upper(replace(brand, '#', ' - ')) END END AS qualifier,
    '$' || CAST(CAST(floor(cents / 100) AS BIGINT) AS STRING) || '.' || lpad(CAST(cents % 100 AS STRING), 2, '0') AS money
  FROM base)
"""
STATED_DATE = """CASE WHEN ok % 11 = 0 THEN CAST(NULL AS DATE) ELSE odate END"""
STATED_TERM = """CASE pk % 7 WHEN 0 THEN 'hourly_rate' WHEN 1 THEN 'payment_terms_days' WHEN 2 THEN 'liability_cap'
    WHEN 3 THEN 'auto_renew_months' WHEN 4 THEN 'termination_notice_days' WHEN 5 THEN 'annual_fees'
    ELSE 'governing_law' END"""
STATED_VALUE = """CASE pk % 7 WHEN 0 THEN money || CASE WHEN ok % 2 = 0 THEN ' per hour' ELSE '' END
    WHEN 1 THEN CASE ok % 4 WHEN 0 THEN 'net ' || CAST(qty AS STRING) || ' days' WHEN 1 THEN CAST(qty AS STRING)
      WHEN 2 THEN 'forty-five (45)' ELSE 'to be agreed' END
    WHEN 2 THEN CASE WHEN ok % 9 = 0 THEN 'the lesser of three (3) times the fees and $5,000,000'
      ELSE '$' || CAST(qty AS STRING) || ',000,000 in aggregate' END
    WHEN 3 THEN CASE WHEN ok % 3 = 0 THEN CAST(1 + qty % 4 AS STRING) || ' years' ELSE CAST(qty AS STRING) || ' months' END
    WHEN 4 THEN CAST(qty AS STRING) || ' days written notice'
    WHEN 5 THEN '$' || CAST(100 + qty * 25 AS STRING) || ',000'
    ELSE CASE WHEN ok % 2 = 0 THEN 'State of ' || substr(brand, 1, 6) ELSE 'state  of ' || brand END END"""
INVOICE_AMOUNT = """'$' || CAST(CAST(floor((cents * qty + CASE WHEN ln % 5 = 0 THEN 10000 ELSE 0 END) / 100) AS BIGINT) AS STRING)
      || '.' || lpad(CAST((cents * qty) % 100 AS STRING), 2, '0')"""

FACTS = f"""
WITH base AS (
{LINE_COLUMNS}  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
       JOIN part p ON p.p_partkey = l.l_partkey
       JOIN supplier s ON s.s_suppkey = l.l_suppkey),
{NAMED_LINES}SELECT fid AS fact_id, ok AS document_id, kind AS document_kind, subject, qualifier,
  {STATED_DATE} AS effective_date, fid AS fact_seq,
  {STATED_TERM} AS predicate,
  {STATED_VALUE} AS value_raw
FROM named WHERE kind <> 'invoice'
UNION ALL
SELECT fid + 1, ok, kind, subject, 'line ' || CAST(ln AS STRING), odate, fid + 1, 'invoice_rate', money FROM named WHERE kind = 'invoice'
UNION ALL
SELECT fid + 2, ok, kind, subject, 'line ' || CAST(ln AS STRING), odate, fid + 2, 'invoice_hours', CAST(qty AS STRING) FROM named WHERE kind = 'invoice'
UNION ALL
SELECT fid + 3, ok, kind, subject, 'line ' || CAST(ln AS STRING), odate, fid + 3, 'invoice_amount',
  {INVOICE_AMOUNT} FROM named WHERE kind = 'invoice'
UNION ALL
SELECT fid + 4, ok, kind, subject, qualifier, odate, fid + 4, 'invoice_rate', money FROM named WHERE kind = 'invoice'
"""

# The same rows in one pass: lines are numbered once, and each gives its facts as a list.  The small tables
# are met first, so that the lines are dealt by order once for the orders and the numbers.
FACTS_AT_ONCE = f"""
WITH base AS (
{LINE_COLUMNS}  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
       JOIN supplier s ON s.s_suppkey = l.l_suppkey
       JOIN orders o ON o.o_orderkey = l.l_orderkey),
{NAMED_LINES}SELECT fact.fact_id, document_id, document_kind, subject, fact.qualifier, fact.effective_date, fact.fact_id AS fact_seq,
  fact.predicate, fact.value_raw
FROM (SELECT ok AS document_id, kind AS document_kind, subject, explode(CASE WHEN kind <> 'invoice' THEN array(
    named_struct('fact_id', fid, 'qualifier', qualifier, 'effective_date', {STATED_DATE}, 'predicate', {STATED_TERM}, 'value_raw', {STATED_VALUE}))
  ELSE array(
    named_struct('fact_id', fid + 1, 'qualifier', 'line ' || CAST(ln AS STRING), 'effective_date', odate, 'predicate', 'invoice_rate', 'value_raw', money),
    named_struct('fact_id', fid + 2, 'qualifier', 'line ' || CAST(ln AS STRING), 'effective_date', odate, 'predicate', 'invoice_hours', 'value_raw', CAST(qty AS STRING)),
    named_struct('fact_id', fid + 3, 'qualifier', 'line ' || CAST(ln AS STRING), 'effective_date', odate, 'predicate', 'invoice_amount', 'value_raw', {INVOICE_AMOUNT}),
    named_struct('fact_id', fid + 4, 'qualifier', qualifier, 'effective_date', odate, 'predicate', 'invoice_rate', 'value_raw', money)) END) AS fact
  FROM named) stated
"""

# Where a document's quotes start, anywhere in its text, and how long they are (k is 0, 1 or 2).
QUOTE_START = "CAST(1 + (document_id * 7919 + 11 + k * 104729) % greatest(length(text) - 39, 1) AS INT)"
QUOTE_LENGTH = "CAST(10 + k * 30 AS INT)"

# Facts as they are, but for a governing law that three of four vendors lack: stated by no
# governing document, only for scopes, or not at all.
LAWLESS = """predicate <> 'governing_law' OR CASE CAST(right(subject_key, 3) AS INT) % 4
  WHEN 0 THEN document_kind NOT IN ('msa', 'sow', 'amendment') WHEN 1 THEN qualifier IS NOT NULL WHEN 2 THEN false ELSE true END"""

# A rule for every part.
PART_RULES = """
SELECT 'parts' AS ruleset_id, CAST(p_partkey AS INT) AS position, 'P-' || CAST(p_partkey AS STRING) AS code,
  CASE p_partkey % 3 WHEN 0 THEN 'numeric_max' WHEN 1 THEN 'numeric_min' ELSE 'presence_required' END AS kind,
  CASE p_partkey % 7 WHEN 0 THEN 'hourly_rate' WHEN 1 THEN 'payment_terms_days' WHEN 2 THEN 'liability_cap'
    WHEN 3 THEN 'auto_renew_months' WHEN 4 THEN 'termination_notice_days' WHEN 5 THEN 'annual_fees' ELSE 'audit_rights' END AS predicate,
  'Rule of a part' AS description, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DECIMAL(18,6)) END AS max,
  CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size AS DECIMAL(18,6)) END AS min, CAST(NULL AS STRING) AS expr, 'medium' AS severity
FROM part
"""

# One contract document per order; paths written on two kinds of system.
CONTRACTS = """
SELECT o_orderkey AS document_id,
  CASE WHEN o_orderkey % 2 = 1 THEN 'C:' || chr(92) || 'in' || chr(92) || 'order-' || CAST(o_orderkey AS STRING) || '.md'
    ELSE '/in/order_' || CAST(o_orderkey AS STRING) || '.txt' END AS uri,
  CASE WHEN o_orderkey % 19 = 0 THEN 'amendment' ELSE
    CASE o_orderpriority WHEN '1-URGENT' THEN 'amendment' WHEN '2-HIGH' THEN 'msa'
      WHEN '3-MEDIUM' THEN 'sow' WHEN '5-LOW' THEN 'invoice'
      ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'renewal_notice' END END END AS kind,
  CASE WHEN o_orderkey % 13 = 0 THEN 'House ' || CAST(o_orderkey % 50 AS STRING)
    WHEN o_orderkey % 13 = 1 THEN '' END AS vendor,
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) END AS document_date
FROM orders
"""

# A letter per conversation; turns are paragraphs, some with blanks around them.
LETTER_TURNS = """
SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '  ' || text || chr(10) ELSE text END AS text
FROM conversations
"""
LETTER_URI = """
CASE WHEN conv_id % 10 = 0 THEN '/in/conv-' || CAST(conv_id AS STRING) || '.docx'
  WHEN conv_id % 2 = 1 THEN 'C:' || chr(92) || 'in' || chr(92) || 'conv-' || CAST(conv_id AS STRING) || '.md'
  ELSE '/in/conv-' || CAST(conv_id AS STRING) || '.txt' END
"""

CLASS_RESPONSES = """
SELECT o_orderkey AS document_id,
  CASE WHEN o_orderkey % 50 = 0 THEN '{"kind": "msa", "vendor"'
    ELSE '{"kind": "' ||
      CASE o_orderpriority WHEN '1-URGENT' THEN 'amendment' WHEN '2-HIGH' THEN 'msa' WHEN '3-MEDIUM' THEN 'sow'
        WHEN '5-LOW' THEN 'invoice' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'letter' ELSE 'unknown' END END
      || '", "vendor": " Customer ' || CAST(o_custkey AS STRING) || ' ", "document_date": "' ||
      CASE WHEN o_orderkey % 6 = 0 THEN 'dated 2024-02-30' WHEN o_orderkey % 6 = 1 THEN ''
        WHEN o_orderkey % 6 = 2 THEN '03/04/2024' ELSE 'as of ' || CAST(CAST(o_orderdate AS DATE) AS STRING) END
      || '", "confidence": ' || CAST(CAST(floor((o_orderkey % 140) / 100) AS BIGINT) AS STRING) || '.'
      || lpad(CAST(o_orderkey % 140 % 100 AS STRING), 2, '0')
      || ', "fits_kind": ' || CASE WHEN o_orderkey % 9 = 0 THEN 'false' WHEN o_orderkey % 9 = 1 THEN '"true"' ELSE 'true' END
      || ', "reasoning": " status ' || o_orderstatus || '"}' END AS response_text
FROM orders
"""

FACT_RESPONSES = """
SELECT document_id, CASE
  WHEN document_id % 50 = 0 THEN '{"facts": [{"predicate": '
  WHEN document_id % 50 = 1 THEN '{"terms": []}'
  ELSE '{"facts": [{"predicate": "hourly_rate", "subject": "' || s_name || '", "value_raw": "' ||
    CASE WHEN document_id % 4 = 0 THEN '($' || price || ' per hour);' WHEN document_id % 4 = 1 THEN '`$' || price || ').`'
      WHEN document_id % 4 = 2 THEN 'thirty (30)' ELSE ' $' || price || ', ' END
    || '", "effective_date": "' || CAST(CAST(l_shipdate AS DATE) AS STRING) || '", "confidence": 0.9, "qualifier": " ' ||
    CASE WHEN document_id % 3 = 0 THEN 'Partner' ELSE '' END || ' ", "quote": "rate of $' || price || '"}, '
    || '{"predicate": "annual_fees", "subject": "' || s_name || '", "value_raw": "$' || CAST(qty AS STRING) ||
    ',000", "confidence": "high", "quote": "' || CASE WHEN document_id % 7 = 0 THEN '  ' ELSE 'fees' END || '"}], '
    || '"instruction_like_spans": [' || CASE WHEN document_id % 31 = 0 THEN '"ignore previous rules", " "' ELSE '' END || ']}'
  END AS response_text
FROM (
  SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
      l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS document_id,
    s_name, l_shipdate, CAST(l_quantity AS BIGINT) AS qty,
    CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) AS price
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) x
"""

REQUESTS = """
SELECT event_id AS request_id, event_type AS stage, 'model-' || CAST(user_id % 2 AS STRING) AS model,
  'v1' AS prompt_version, props || '  ' || chr(13) || chr(10) || 'user ' || CAST(user_id AS STRING) || chr(10) AS input, ts
FROM events
"""

RUN_LOG = """
SELECT CAST(event_id AS STRING) AS run_id, 'corpus ' || CAST(user_id AS STRING) AS corpus,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running'
    WHEN 'click' THEN 'awaiting_review' ELSE 'interrupted' END AS status,
  ts AS started_at, CASE WHEN event_id % 3 <> 0 THEN 'stage ' || CAST(event_id % 5 AS STRING) END AS current_stage,
  CAST(NULL AS STRING) AS stage_detail
FROM events
"""

EVENT_FINDINGS = """
SELECT event_id AS finding_id, event_id AS finding_index, user_id AS run_id, props AS explanation,
  CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity
FROM events
"""
EVENT_DECISIONS = """
SELECT event_id AS decision_id, event_id AS finding_id, event_id AS finding_index, 'finding' AS kind,
  CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'signup' THEN 'approved' WHEN 'click' THEN 'rejected'
    ELSE 'deferred' END AS verdict,
  'user ' || CAST(user_id AS STRING) AS actor, ts AS created_at
FROM events WHERE event_type <> 'view'
"""

CALLS = """
SELECT user_id AS run_id, event_type AS stage,
  CASE event_id % 3 WHEN 0 THEN 'gemini-3.6-flash' WHEN 1 THEN 'gemini-3.1-flash-lite' ELSE 'other' END AS model,
  CAST(event_id % 977 AS INT) AS tokens_in, CAST(event_id % 331 AS INT) AS tokens_out, event_id % 4 = 0 AS cached
FROM events
"""

# Proposed rules, one per part, with the usual mistakes in them.
RULE_PROPOSALS = """
SELECT CASE WHEN p_partkey % 41 <> 0 THEN p_type END AS ruleset_id, CAST(p_partkey AS INT) AS position,
  CASE WHEN p_partkey % 37 <> 0 THEN p_brand || '-' || CAST(p_size AS STRING) END AS code,
  CASE p_partkey % 5 WHEN 0 THEN 'numeric_max' WHEN 1 THEN 'numeric_min' WHEN 2 THEN 'numeric_bound'
    WHEN 3 THEN 'presence_required' ELSE 'ratio' END AS kind,
  CASE WHEN p_partkey % 31 <> 0 THEN 'hourly_rate' END AS predicate, p_name AS description,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DECIMAL(18,6)) END AS max,
  CASE WHEN p_partkey % 3 = 1 THEN CAST(p_size AS DECIMAL(18,6)) END AS min,
  CASE WHEN p_partkey % 2 = 0 THEN '2 * annual_fees' END AS expr,
  CASE WHEN p_partkey % 29 = 0 THEN 'urgent' ELSE 'low' END AS severity
FROM part
"""


def register_views(spark: SparkSession, folder: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def derive(spark: SparkSession, folder: str, text: str) -> DataFrame:
    register_views(spark, folder)
    return spark.sql(text)


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, FACTS_AT_ONCE)
