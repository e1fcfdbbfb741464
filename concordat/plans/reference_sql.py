"""What each query must return, written a second time in plain SQL.

The texts are formulated independently of the DataFrame code (row numbers, correlated
lookups and self joins where the operators aggregate) and run on the same tables.
"""

from __future__ import annotations

from concordat.fixed_values import (
    KIND_DESCRIPTIONS,
    EFFECT_GOVERNS,
    EFFECT_OBSERVES,
    MONEY_HIGHER,
    MONEY_LOWER,
    NON_GOVERNING_KINDS,
    NOTE_NO_VERDICT,
    NOTE_UNPARSEABLE,
    NOTE_WITHHELD,
    REASON_FORMULA,
    REASON_UNREADABLE,
    REGISTER_PREFACE,
    REGISTER_TITLE,
    RETAINED,
    SIDES,
    TYPOGRAPHIC,
    WHITESPACE,
)
from concordat.plans import driver_tables as D
from concordat.sources.rules import NOT_A_RULE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def show(number: str) -> str:
    return f"regexp_replace(CAST(({number}) AS VARCHAR), '\\.?0+$', '')"


def q(text: str) -> str:
    return f"('''' || {text} || '''')"


NL2 = "chr(10) || chr(10)"
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NUM = "([0-9][0-9,]*(?:\\.[0-9]+)?)"
FORMULA = "(?i)times the|multiplied by|lesser of|greater of"


def first_of(*patterns: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(value_raw, '{p}', 1), '')" for p in patterns) + ")"


DAYS = first_of(f"(?i)net\\s*{NUM}", f"(?i){NUM}\\s*(?:\\([0-9]+\\))?\\s*day", f"^{NUM}$",
                f"(?i)^[a-z\\s,-]*\\({NUM}\\)$")
MONTHS = first_of(f"(?i){NUM}\\s*month", f"(?i){NUM}\\s*year")

VIEWS = f"""
facts AS MATERIALIZED ({D.FACTS}),
read_ AS (
  SELECT *, CASE WHEN regexp_matches(value_raw, '{FORMULA}') THEN NULL
    WHEN predicate IN ('hourly_rate','liability_cap','annual_fees','invoice_amount','invoice_rate') THEN {first_of(NUM)}
    WHEN predicate IN ('payment_terms_days','termination_notice_days') THEN {DAYS}
    WHEN predicate = 'auto_renew_months' THEN {MONTHS}
    WHEN predicate = 'invoice_hours' THEN value_raw END AS digits,
    CASE WHEN value_raw LIKE '%year%' THEN 12 ELSE 1 END AS factor
  FROM facts),
fv AS MATERIALIZED (
  SELECT fact_id, document_id, document_kind, subject, qualifier, effective_date, fact_seq, predicate, value_raw,
    lower(trim(regexp_replace(subject, '\\s+', ' ', 'g'))) AS subject_key,
    nullif(trim(regexp_replace(lower(qualifier), '[^0-9a-z]+', ' ', 'g')), '') AS scope_key,
    CASE document_kind WHEN 'msa' THEN 10 WHEN 'sow' THEN 20 WHEN 'amendment' THEN 30
      WHEN 'renewal_notice' THEN 5 WHEN 'invoice' THEN 0 ELSE -1 END AS precedence,
    document_kind IN ('msa', 'sow', 'amendment') AS governs,
    CASE predicate WHEN 'invoice_rate' THEN 'hourly_rate' ELSE predicate END AS governed_predicate,
    CAST(CAST(replace(digits, ',', '') AS DECIMAL(18,6)) * factor AS DECIMAL(18,6)) AS magnitude,
    CASE WHEN digits IS NULL THEN NULL WHEN predicate LIKE '%_days' THEN 'days' WHEN predicate LIKE '%_months' THEN 'months'
      WHEN predicate = 'invoice_hours' THEN 'hours' WHEN predicate <> 'governing_law' THEN 'USD' END AS unit
  FROM read_)"""


def register(run: int, more: str = "true") -> str:
    """Views, governing facts, names and sections of a run; `more` keeps some of the facts only."""
    where = f"WHERE {'document_id % 10 <> 0' if run == 1 else 'true'} AND ({more})"
    return f"""
v{run} AS (SELECT * FROM fv {where}),
best{run} AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY subject_key, predicate, scope_key
      ORDER BY coalesce(effective_date, DATE '0001-01-01') DESC, precedence DESC, fact_seq DESC) AS rn
    FROM v{run} WHERE governs) x WHERE rn = 1),
names{run} AS MATERIALIZED (
  SELECT subject_key, subject AS vendor FROM (
    SELECT subject_key, subject, row_number() OVER (PARTITION BY subject_key ORDER BY weight DESC,
        CASE WHEN upper(subject) = subject THEN 1 ELSE 0 END, subject DESC) AS rn
    FROM (SELECT subject_key, subject, sum(CASE WHEN governs THEN 2 ELSE 1 END) AS weight
          FROM v{run} GROUP BY subject_key, subject) w) x WHERE rn = 1),
res{run} AS MATERIALIZED (
  SELECT g.subject_key, n.vendor, g.predicate, g.scope_key,
    g.subject_key || '::' || g.predicate || coalesce('::' || g.scope_key, '') AS section_key,
    b.fact_id AS gid, b.value_raw AS value, b.magnitude, b.unit, b.document_kind AS source_kind,
    strftime(b.effective_date, '%Y-%m-%d') AS since,
    CASE WHEN b.fact_id IS NULL THEN 'unsupported' ELSE 'agreed' END AS status,
    g.n_governing, g.n_observed
  FROM (SELECT subject_key, predicate, scope_key, count(*) FILTER (WHERE governs) AS n_governing,
          count(*) FILTER (WHERE NOT governs) AS n_observed
        FROM v{run} GROUP BY subject_key, predicate, scope_key) g
  JOIN names{run} n ON n.subject_key = g.subject_key
  LEFT JOIN best{run} b ON b.subject_key = g.subject_key AND b.predicate = g.predicate
    AND b.scope_key IS NOT DISTINCT FROM g.scope_key),
part{run} AS MATERIALIZED (
  SELECT r.section_key, v.fact_id, r.gid, v.value_raw, v.effective_date, v.precedence, v.fact_seq, v.document_id,
    CASE WHEN NOT v.governs THEN 'observed' WHEN v.fact_id = r.gid THEN 'governing' ELSE 'superseded' END AS role
  FROM v{run} v JOIN res{run} r ON r.subject_key = v.subject_key AND r.predicate = v.predicate
    AND r.scope_key IS NOT DISTINCT FROM v.scope_key)"""


def sections(run: int) -> str:
    text = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
    half = lambda at: f"CAST(sum(CAST('0x' || substr(sha256(part || ' ' || sha256(value_raw)), {at}, 15) AS BIGINT)) AS VARCHAR)"
    return f"""
listed{run} AS MATERIALIZED (
  SELECT section_key, value_raw, role || CASE WHEN role = 'superseded' THEN '/' || strftime(coalesce(effective_date, DATE '0001-01-01'), '%Y-%m-%d')
      || '/' || lpad(CAST(precedence + 1 AS VARCHAR), 3, '0') ELSE '' END || '/' || lpad(CAST(fact_seq AS VARCHAR), 20, '0') AS part
  FROM part{run} WHERE role <> 'governing'),
digest{run} AS (SELECT section_key, count(*) || ':' || {half(1)} || ':' || {half(16)} AS digest FROM listed{run} GROUP BY section_key),
sec{run} AS MATERIALIZED (
  SELECT x.*, sha256(sha256(content) || ' ' || coalesce(digest, '0:0:0')) AS content_hash, substr(sha256(section_key), 1, 8) AS ref,
    n_governing + n_observed AS n_facts FROM (
    SELECT r.*,
      '{{"effective_date":' || {text('since')} || ',"governing_source":' || {text('source_kind')} || ',"normalized":' ||
      {text('unit')} || ',"scope":' || {text('scope_key')} || ',"status":"' || status || '","term":"' || predicate ||
      '","value":' || {text('value')} || ',"vendor":"' || vendor || '"}}' AS content
    FROM res{run} r) x LEFT JOIN digest{run} USING (section_key))"""


BOTH = f"WITH {VIEWS}, {register(1)}, {register(2)}"
RUN2 = f"WITH {VIEWS}, {register(2)}"
SECTIONS = f"{BOTH}, {sections(1)}, {sections(2)}"
# Run 2 on top of run 1: a section is carried when it holds the same facts and its logic is current.
PLANNED = f"""{SECTIONS},
moved AS MATERIALIZED (
  SELECT section_key FROM (SELECT section_key, fact_id FROM part2 EXCEPT SELECT section_key, fact_id FROM part1) a
  UNION SELECT section_key FROM (SELECT section_key, fact_id FROM part1 EXCEPT SELECT section_key, fact_id FROM part2) b),
plan AS MATERIALIZED (
  SELECT s2.*, s1.content_hash AS old_hash, s1.content AS old_content, s1.section_key IS NOT NULL AS had,
    CASE WHEN s1.section_key IS NULL THEN 'new' WHEN s1.ref LIKE '0%' THEN 'logic changed'
      WHEN s2.section_key IN (SELECT section_key FROM moved) THEN 'facts changed' END AS reason
  FROM sec2 s2 LEFT JOIN sec1 s1 ON s1.section_key = s2.section_key),
ver2 AS MATERIALIZED (
  SELECT *, reason IS NULL AS carried_forward, CASE WHEN reason IS NULL THEN old_hash ELSE content_hash END AS hash_now,
    CASE WHEN reason IS NULL THEN old_content ELSE content END AS content_now FROM plan)"""

CLAIM = ("CASE WHEN value IS NULL THEN vendor || ': no supported value for ' || predicate || '.' ELSE vendor || ': ' || "
         "predicate || ' is ' || value || ', per the ' || source_kind || coalesce(', effective ' || since, '') || '.' END")

E1 = f"""
ranked AS (
  SELECT fact_seq, magnitude, dense_rank() OVER (ORDER BY subject_key, predicate, scope_key, effective_date, precedence) AS grp
  FROM fv WHERE governs AND magnitude IS NOT NULL),
extremes AS (
  SELECT grp, min(fact_seq) AS head, min_by(magnitude, fact_seq) AS head_value, min(magnitude) AS lo, max(magnitude) AS hi
  FROM ranked GROUP BY grp HAVING min(magnitude) < max(magnitude)),
others AS (
  SELECT grp, min(fact_seq) AS other FROM ranked JOIN extremes USING (grp)
  WHERE magnitude = CASE WHEN head_value = lo THEN hi ELSE lo END GROUP BY grp),
disputed AS (
  SELECT fact_seq AS seq, CASE WHEN magnitude = head_value THEN other ELSE head END AS against
  FROM ranked JOIN extremes USING (grp) JOIN others USING (grp) WHERE fact_seq <> head),
e1 AS (
  SELECT '{'same_predicate_different_value'}' AS kind,
    (SELECT min_by(f.subject, f.fact_seq) FROM fv f WHERE f.governs AND f.subject_key = a.subject_key
       AND f.predicate = a.predicate AND f.scope_key IS NOT DISTINCT FROM a.scope_key) AS subject,
    a.predicate, a.scope_key, a.fact_id AS a_fact_id, b.fact_id AS b_fact_id,
    a.value_raw AS a_value, b.value_raw AS b_value, a.document_kind AS a_kind, b.document_kind AS b_kind,
    a.effective_date AS a_date, b.effective_date AS b_date,
    CASE WHEN a.magnitude > b.magnitude THEN 1 ELSE -1 END AS sign,
    {show('abs(a.magnitude - b.magnitude)')} AS delta, a.unit,
    a.document_kind || ' states ' || {q('a.value_raw')} || ' and ' || b.document_kind || ' states ' || {q('b.value_raw')}
      || ' for ' || a.predicate
      || '. Both carry the same effective date and precedence, so neither supersedes the other.' AS detail
  FROM disputed JOIN fv a ON a.fact_seq = least(seq, against) JOIN fv b ON b.fact_seq = greatest(seq, against))"""

E2 = f"""
obs AS (
  SELECT o.*, g.fact_id AS gid, g.value_raw AS gvalue, g.magnitude AS gmag, g.unit AS gunit, g.document_kind AS gkind,
    g.effective_date AS gdate
  FROM (SELECT * FROM fv WHERE NOT governs AND effective_date IS NOT NULL AND magnitude IS NOT NULL) o,
    LATERAL (SELECT * FROM fv g WHERE g.governs AND g.subject_key = o.subject_key
      AND g.governed_predicate = o.governed_predicate AND coalesce(g.scope_key, '') = coalesce(o.scope_key, '')
      AND g.effective_date <= o.effective_date
      ORDER BY g.effective_date DESC, g.precedence DESC, g.fact_seq DESC LIMIT 1) g),
wrong AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, subject_key, governed_predicate, scope_key ORDER BY fact_seq) AS rn
  FROM obs WHERE unit = gunit AND magnitude <> gmag),
spelled AS (
  SELECT subject_key, governed_predicate, scope_key, min_by(subject, fact_seq) AS subject FROM fv
  GROUP BY subject_key, governed_predicate, scope_key),
e2 AS (
  SELECT 'temporal_precedence' AS kind, s.subject, w.governed_predicate AS predicate, w.scope_key,
    w.fact_id AS a_fact_id, w.gid AS b_fact_id, w.value_raw AS a_value, w.gvalue AS b_value,
    w.document_kind AS a_kind, w.gkind AS b_kind, w.effective_date AS a_date, w.gdate AS b_date,
    CASE WHEN w.magnitude > w.gmag THEN 1 ELSE -1 END AS sign, {show('abs(w.magnitude - w.gmag)')} AS delta, w.unit,
    'On ' || strftime(w.effective_date, '%Y-%m-%d') || ' the ' || w.document_kind || ' used ' || {q('w.value_raw')}
      || ', but the value governing since ' || strftime(w.gdate, '%Y-%m-%d') || ' (' || w.gkind || ') was '
      || {q('w.gvalue')} || '. Difference: ' || {show('w.magnitude - w.gmag')} || '.' AS detail
  FROM wrong w JOIN spelled s ON s.subject_key = w.subject_key AND s.governed_predicate = w.governed_predicate
    AND s.scope_key IS NOT DISTINCT FROM w.scope_key WHERE w.rn = 1)"""

E3 = f"""
line AS (
  SELECT document_id, scope_key, predicate, min_by(fact_id, fact_seq) AS fact_id, min_by(value_raw, fact_seq) AS value_raw,
    min(magnitude) AS magnitude, min_by(subject, fact_seq) AS subject, min_by(document_kind, fact_seq) AS document_kind,
    min_by(effective_date, fact_seq) AS effective_date
  FROM fv WHERE predicate LIKE 'invoice_%' GROUP BY document_id, scope_key, predicate
  HAVING count(DISTINCT magnitude) = 1 AND count(*) = count(magnitude)),
e3 AS (
  SELECT 'arithmetic_mismatch' AS kind, t.subject, 'invoice_amount' AS predicate, t.scope_key,
    t.fact_id AS a_fact_id, r.fact_id AS b_fact_id, t.value_raw AS a_value, r.value_raw AS b_value,
    t.document_kind AS a_kind, r.document_kind AS b_kind, t.effective_date AS a_date, r.effective_date AS b_date,
    CASE WHEN t.magnitude > r.magnitude * h.magnitude THEN 1 ELSE -1 END AS sign,
    {show('abs(t.magnitude - r.magnitude * h.magnitude)')} AS delta, 'USD' AS unit,
    coalesce('On line ' || {q('t.scope_key')} || ', ', '') || 'invoice_amount is stated as ' || {q('t.value_raw')}
      || ', but invoice_rate=' || {q('r.value_raw')} || ' x invoice_hours=' || {q('h.value_raw')} || ' gives '
      || {show('r.magnitude * h.magnitude')} || '. Difference: ' || {show('t.magnitude - r.magnitude * h.magnitude')} || '.' AS detail
  FROM line t JOIN line r ON r.document_id = t.document_id AND r.scope_key IS NOT DISTINCT FROM t.scope_key
    JOIN line h ON h.document_id = t.document_id AND h.scope_key IS NOT DISTINCT FROM t.scope_key
  WHERE t.predicate = 'invoice_amount' AND r.predicate = 'invoice_rate' AND h.predicate = 'invoice_hours'
    AND t.magnitude <> r.magnitude * h.magnitude
    AND (t.scope_key IS NOT NULL OR t.document_id NOT IN (SELECT document_id FROM fv WHERE scope_key IS NOT NULL)))"""

CANDIDATES = f"""WITH {VIEWS}, {E1}, {E2}, {E3},
cand AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3)"""


def direction() -> str:
    cases = []
    for kind, (subject, reference) in SIDES.items():
        money = ("CASE WHEN unit = 'USD' THEN CASE WHEN sign > 0 THEN " + lit(MONEY_HIGHER) + " ELSE " + lit(MONEY_LOWER)
                 + " END ELSE '' END") if kind == "temporal_precedence" else "''"
        cases.append(
            f"WHEN kind = '{kind}' THEN {lit('Direction, computed: ' + subject + ' is ')} || "
            f"CASE WHEN sign > 0 THEN 'HIGHER' ELSE 'LOWER' END || {lit(' than ' + reference + ', by ')} || "
            f"CASE WHEN unit = 'USD' THEN '$' || delta ELSE delta || ' ' || unit END || '.' || {money}")
    return "CASE " + " ".join(cases) + " END"


JUDGED = f"""{CANDIDATES},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY sha256(kind || chr(10) || a_fact_id || chr(10) || b_fact_id)) - 1 AS candidate_index,
    {direction()} AS direction FROM cand),
prose AS (
  SELECT *, candidate_index // 100 AS batch_id,
    max(CASE WHEN a_fact_id % 11 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY candidate_index // 100) AS any_answer,
    CASE a_fact_id % 6 WHEN 0 THEN 'The billed figure is higher than agreed.' WHEN 1 THEN 'The figure is lower; check it.'
      WHEN 2 THEN 'The figure is not higher than agreed.' WHEN 3 THEN 'It is above one figure but below another.'
      WHEN 4 THEN 'A refund is due.' ELSE detail END AS said,
    CASE WHEN a_fact_id % 6 IN (0, 4) THEN 1 WHEN a_fact_id % 6 = 1 THEN -1 END AS claimed
  FROM numbered),
judged AS (
  SELECT *, CASE WHEN batch_id % 10 = 3 AND any_answer = 1 THEN 'broken'
      WHEN batch_id % 10 = 4 OR a_fact_id % 11 = 0 THEN 'missing' ELSE 'given' END AS answer
  FROM prose),
verdict AS (
  SELECT *, CASE WHEN answer = 'given' THEN a_fact_id % 5 <> 0 ELSE true END AS is_real_conflict,
    CASE WHEN answer = 'given' THEN CASE a_fact_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END
      ELSE 'medium' END AS severity,
    CASE answer WHEN 'broken' THEN detail || ' ({NOTE_UNPARSEABLE}.)' WHEN 'missing' THEN detail || {lit(' ' + NOTE_NO_VERDICT)}
      ELSE said END AS explanation,
    answer = 'given' AND coalesce(claimed <> sign, false) AS withheld
  FROM judged),
merged AS (
  SELECT *, CASE WHEN a_fact_id % 3 = 0 THEN CASE WHEN a_fact_id % 2 = 0 THEN 'open' ELSE 'dismissed' END END AS old
  FROM verdict)"""

LETTERS = f"""
letter AS (
  SELECT conv_id AS document_id, {D.LETTER_URI} AS uri,
    string_agg(text, {NL2} ORDER BY turn) AS text FROM ({D.LETTER_TURNS}) t GROUP BY conv_id)"""
ARTICLES = "letter AS (SELECT doc_id AS document_id, '/in/doc-' || doc_id || '.txt' AS uri, text FROM documents)"
CHUNKS = f"""
piece AS (
  SELECT document_id, unnest(string_split(text, {NL2})) AS piece,
    generate_subscripts(string_split(text, {NL2}), 1) AS pos FROM letter),
placed AS (
  SELECT *, coalesce(sum(length(piece) + 2) OVER (PARTITION BY document_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(piece) - length(ltrim(piece, {STRIP})) AS char_start
  FROM piece),
chunk AS (
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS ordinal,
    trim(piece, {STRIP}) AS text, CAST(char_start AS BIGINT) AS char_start,
    CAST(char_start AS BIGINT) + length(trim(piece, {STRIP})) AS char_end
  FROM placed WHERE trim(piece, {STRIP}) <> '')"""
WHOLE = """
whole AS (
  SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal) AS text,
    string_agg(repeat(chr(10), CAST(char_start - before AS BIGINT)) || text, '' ORDER BY ordinal) AS text_at_offsets
  FROM (SELECT *, coalesce(lag(char_end) OVER (PARTITION BY document_id ORDER BY ordinal), 0) AS before FROM chunk) c
  GROUP BY document_id)"""

_from, _to = "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values())
PLAIN = lambda c: f"translate({c}, {lit(_from)}, {lit(_to)})"
QUOTED = f"""
asked AS (
  SELECT document_id, quote, {PLAIN('quote')} AS plain,
    replace(regexp_escape(trim(regexp_replace({PLAIN('quote')}, '\\s+', ' ', 'g'))), '\\ ', '\\s+') AS pattern
  FROM (SELECT document_id, CASE WHEN document_id % 5 = 0 THEN 'zz' || p WHEN document_id % 7 = 0 THEN translate(p, '''-', '’–')
      WHEN document_id % 11 = 0 THEN regexp_replace(p, '[ ' || chr(10) || ']+', ' ' || chr(10) || ' ', 'g') ELSE p END AS quote
    FROM (SELECT document_id, trim(substr(text, {D.QUOTE_START}, {D.QUOTE_LENGTH}), {STRIP}) AS p FROM letter, (VALUES (0), (1), (2)) AS n(k)) x) y
  WHERE quote <> '' GROUP BY document_id, quote),
tried AS (
  SELECT a.document_id, a.quote, a.plain, a.pattern, s.ordinal, s.base, s.text
  FROM asked a JOIN (
    SELECT document_id, ordinal, char_start AS base, text FROM chunk
    UNION ALL SELECT document_id, NULL, 0, text_at_offsets FROM whole) s USING (document_id)),
hits AS (
  SELECT *, CASE WHEN strpos(text, quote) > 0 THEN quote WHEN strpos({PLAIN('text')}, plain) > 0 THEN plain
      ELSE nullif(regexp_extract({PLAIN('text')}, pattern), '') END AS found,
    CASE WHEN strpos(text, quote) > 0 THEN text ELSE {PLAIN('text')} END AS inside
  FROM tried),
ranked AS (
  SELECT *, base + strpos(inside, found) - 1 AS char_start,
    row_number() OVER (PARTITION BY document_id, quote ORDER BY ordinal NULLS LAST) AS rn
  FROM hits WHERE found IS NOT NULL)"""
CITED = """
SELECT a.document_id, a.quote, r.char_start, r.char_start + length(r.found) AS char_end,
  coalesce(r.ordinal, c.ordinal) AS chunk_ordinal
FROM asked a LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (document_id, quote)
LEFT JOIN chunk c ON c.document_id = a.document_id AND r.char_start >= c.char_start AND r.char_start < c.char_end"""

NAME = "CASE WHEN document_id % 2 = 1 THEN 'order-' || document_id || '.md' ELSE 'order_' || document_id || '.txt' END"
CONTRACTS = f"doc AS ({D.CONTRACTS})"
ARRIVED = "arr AS (SELECT doc_id AS arrival, source AS corpus, sha256(text) AS sha256, '/in/doc-' || doc_id || '.txt' AS uri FROM documents)"
CLASSED = """
cls AS (
  SELECT o_orderkey AS document_id, o_custkey, o_orderstatus,
    o_orderkey % 50 = 0 AS broken,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'amendment' WHEN '2-HIGH' THEN 'msa' WHEN '3-MEDIUM' THEN 'sow'
      WHEN '5-LOW' THEN 'invoice' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'letter' ELSE 'unknown' END END AS given,
    least(1.0, (o_orderkey % 140) / 100.0) AS conf, o_orderkey % 9 NOT IN (0, 1) AS fits,
    CASE WHEN o_orderkey % 6 IN (0, 1) THEN NULL WHEN o_orderkey % 6 = 2 THEN '2024-03-04'
      ELSE strftime(o_orderdate, '%Y-%m-%d') END AS said_date
  FROM orders),
parsed AS (
  SELECT document_id, CASE WHEN broken OR given = 'letter' THEN 'unknown' ELSE given END AS kind,
    CASE WHEN broken THEN '' ELSE 'Customer ' || o_custkey END AS vendor,
    CASE WHEN broken OR given = 'letter' THEN 0.0 ELSE conf END AS conf,
    CASE WHEN broken THEN 'classifier returned unparseable output'
      WHEN given = 'letter' THEN 'classifier returned unrecognised kind ''letter''' ELSE 'status ' || o_orderstatus END AS reasoning,
    CASE WHEN NOT broken AND given <> 'letter' THEN said_date END AS document_date,
    broken OR given = 'letter' OR fits AS fits_kind FROM cls),
routed AS (
  SELECT *, CASE WHEN kind = 'unknown' THEN 'the classifier declined to identify this document'
    WHEN NOT fits_kind THEN 'the classifier reports ''' || kind || ''' is the nearest available kind rather than a description of this document'
    WHEN conf < 0.75 THEN 'confidence ' || printf('%.2f', conf) || ' is below the 0.75 threshold' END AS reason
  FROM parsed)"""
ANSWERED = f"""
resp AS (
  SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
      l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS document_id,
    s_name, strftime(l_shipdate, '%Y-%m-%d') AS shipped, CAST(l_quantity AS BIGINT) AS qty,
    CAST(floor(l_extendedprice) AS BIGINT) AS price
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
good AS (SELECT * FROM resp WHERE document_id % 50 > 1)"""
RATE_VALUE = ("CASE document_id % 4 WHEN 0 THEN '($' || price || ' per hour)' WHEN 1 THEN '$' || price "
              "WHEN 2 THEN 'thirty (30)' ELSE '$' || price END")
LINE_NAME = "'line-' || document_id || '.md'"

REQUESTED = """
req AS (
  SELECT event_id AS request_id, event_type AS stage, ts, sha256('{"input":"' || replace(props, '"', '\\"') || '\\n' || 'user ' || user_id
    || '","model":"model-' || (user_id % 2) || '","prompt_version":"v1","stage":"' || event_type || '"}') AS cache_key
  FROM events),
keyed AS (
  SELECT *, min(request_id) OVER (PARTITION BY cache_key) AS first_id,
    cache_key IN (SELECT cache_key FROM req WHERE ts < TIMESTAMP '2024-01-15') AS cached FROM req)"""

RULE_TEXT = f"""
vend AS (SELECT DISTINCT subject_key, vendor FROM res{{r}} WHERE scope_key IS NULL),
gov AS (SELECT * FROM res{{r}} WHERE scope_key IS NULL AND gid IS NOT NULL),
rule(code, kind, predicate, description, lim, severity) AS (VALUES
  ('LIAB-01', 'bound', 'liability_cap', 'Liability cap must not exceed 2x annual fees', 0, 'high'),
  ('PAY-01', 'max', 'payment_terms_days', 'Payment terms must be net-30 or better', 30, 'medium'),
  ('RENEW-01', 'max', 'auto_renew_months', 'No auto-renewal beyond 12 months without review', 12, 'medium'),
  ('NOTICE-01', 'min', 'termination_notice_days', 'Termination notice period must be at least 30 days', 30, 'medium')),
tested AS (
  SELECT r.*, g.vendor, g.subject_key, g.value, g.magnitude, g.gid,
    CASE WHEN r.kind = 'bound' THEN 2 * (SELECT f.magnitude FROM gov f WHERE f.subject_key = g.subject_key
      AND f.predicate = 'annual_fees') ELSE CAST(r.lim AS DECIMAL(18,6)) END AS bound
  FROM rule r JOIN gov g ON g.predicate = r.predicate),
viol AS (
  SELECT code, vendor AS subject, subject_key, predicate, value AS observed, gid AS fact_id,
    magnitude IS NOT NULL AND bound IS NOT NULL AS checked,
    CASE WHEN magnitude IS NULL OR bound IS NULL THEN 'low' ELSE severity END AS severity,
    CASE WHEN magnitude IS NULL THEN code || ' could not be evaluated for ' || vendor || ': the recorded ' || predicate || ' '
        || {q('value')} || ' is ' || CASE WHEN regexp_matches(value, '{FORMULA}') THEN '{REASON_FORMULA}' ELSE '{REASON_UNREADABLE}' END
        || '. Not checked.'
      WHEN bound IS NULL THEN code || ' could not be evaluated for ' || vendor || ': the bound ''2 * annual_fees'' needs a value this '
        || 'corpus does not supply. Not checked.'
      ELSE description || '. ' || vendor || ' has ' || predicate || ' of ' || value || ' (' || {show('magnitude')} || '), which '
        || CASE WHEN kind = 'min' THEN 'falls short of' ELSE 'exceeds' END || ' the limit of ' || {show('CAST(bound AS DECIMAL(38,6))')} || '.' END AS explanation
  FROM tested WHERE magnitude IS NULL OR bound IS NULL OR (kind = 'min' AND magnitude < bound) OR (kind <> 'min' AND magnitude > bound)
  UNION ALL
  SELECT 'LAW-01', vendor, subject_key, 'governing_law', NULL, NULL, true, 'low',
    'Governing law must be named explicitly. No supported value for governing_law was found for ' || vendor || '.'
  FROM vend v WHERE NOT EXISTS (SELECT 1 FROM gov g WHERE g.subject_key = v.subject_key AND g.predicate = 'governing_law'))"""


def violations(run: int) -> str:
    return f"{BOTH}, {RULE_TEXT.replace('{r}', str(run))}"


def humanised(term: str) -> str:
    return (f"CASE {term} WHEN 'hourly_rate' THEN 'Hourly Rate' WHEN 'payment_terms_days' THEN 'Payment Terms (days)' "
            f"WHEN 'liability_cap' THEN 'Liability Cap' WHEN 'auto_renew_months' THEN 'Auto Renew (months)' "
            f"WHEN 'termination_notice_days' THEN 'Termination Notice (days)' WHEN 'annual_fees' THEN 'Annual Fees' "
            f"WHEN 'governing_law' THEN 'Governing Law' WHEN 'invoice_amount' THEN 'Invoice Amount' "
            f"WHEN 'invoice_rate' THEN 'Invoice Rate' ELSE 'Invoice Hours' END")


def rendered(name: str, source: str, hash_column: str) -> str:
    label = (f"{humanised('predicate')} || coalesce(' — ' || upper(substr(scope_key, 1, 1)) || substr(scope_key, 2), '')")
    return f"""
{name}_label AS (SELECT *, {label} AS label FROM {source}),
{name} AS (
  SELECT *, '### ' || vendor || ' — ' || label || ' [ref:' || ref || ']' AS heading,
    chr(10) || CASE WHEN value IS NULL THEN 'No supported value for **' || label || '** was established for ' || vendor
        || '. This is recorded rather than omitted.'
      ELSE 'The governing **' || label || '** for ' || vendor || ' is **' || value || '**' || coalesce(', effective ' || since, '')
        || ', per the ' || source_kind || '.' END AS lead,
    {NL2} || '*Status: ' || status || '. · rev ' || substr({hash_column}, 1, 8) || '*' AS tail
  FROM {name}_label)"""


PUBLISHED = f"""{PLANNED}, {rendered('pub1', 'sec1', 'content_hash')}, {rendered('pub2', 'ver2', 'hash_now')},
older AS (SELECT section_key, part, value_raw, row_number() OVER (PARTITION BY section_key ORDER BY part) AS nth FROM listed2 WHERE part LIKE 'superseded/%'),
rows2 AS (
  SELECT section_key, ref, '' AS part, heading || chr(10) || lead AS text, lead AS below FROM pub2
  UNION ALL SELECT section_key, ref, part, text, text FROM (
    SELECT o.section_key, p.ref, o.part, CASE WHEN nth = 1 THEN {NL2} || 'This supersedes ' ELSE ', ' END || o.value_raw AS text
    FROM older o JOIN pub2 p USING (section_key))
  UNION ALL SELECT section_key, ref, '~', text, text FROM (
    SELECT p.section_key, p.ref, CASE WHEN o.section_key IS NULL THEN '' ELSE '. {RETAINED}' END || p.tail AS text
    FROM pub2 p LEFT JOIN (SELECT DISTINCT section_key FROM older) o USING (section_key))),
held AS (SELECT substr(ref, 1, 3) AS corpus, ref, substr(content_hash, 1, 8) AS rev FROM sec1),
wanted AS (SELECT substr(ref, 1, 3) AS corpus, ref, section_key, substr(hash_now, 1, 8) AS rev FROM ver2 WHERE ref NOT LIKE 'f%'),
diff AS (
  SELECT coalesce(w.corpus, h.corpus) AS corpus, coalesce(w.ref, h.ref) AS ref, w.section_key,
    CASE WHEN w.ref IS NULL THEN 'remove' WHEN h.rev IS DISTINCT FROM w.rev THEN 'write' ELSE 'unchanged' END AS action
  FROM wanted w FULL OUTER JOIN held h ON h.corpus = w.corpus AND h.ref = w.ref),
checked AS (
  SELECT d.corpus, d.section_key, CASE WHEN o.ref IS NULL THEN 'no heading carrying [ref:' || d.ref || '] in the document'
      WHEN n.value IS NOT NULL AND strpos(o.heading || chr(10) || o.lead || coalesce(o.listed, '') || o.tail, n.value) = 0
        THEN 'section ' || d.ref || ' does not contain its value ' || {q('n.value')} END AS error
  FROM diff d JOIN pub2 n ON n.section_key = d.section_key LEFT JOIN (
    SELECT p.*, l.listed FROM pub1 p LEFT JOIN (SELECT section_key, string_agg(value_raw, ', ' ORDER BY part) AS listed FROM listed1
      WHERE part LIKE 'superseded/%' GROUP BY section_key) l USING (section_key)) o ON o.section_key = d.section_key
  WHERE d.action = 'write')"""

EVIDENCE = f"""{SECTIONS}, {CONTRACTS},
ev AS (SELECT fact_id, predicate, value_raw, document_id, effective_date, fact_id % 29 <> 0 AS kept, fact_id % 23 <> 0 AS linked,
  fact_id % 17 <> 0 AS stored, document_id % 97 <> 0 AS filed,
  'The ' || replace(predicate, '_', ' ') || ' is ' || CASE WHEN fact_id % 13 = 0 THEN 'withdrawn' ELSE value_raw END || '.' AS passage
  FROM fv),
seen AS (
  SELECT *, strpos(passage, value_raw) > 0 OR (
    CASE WHEN regexp_replace(value_raw, '[^0-9]', '', 'g') = '' THEN strpos(lower(regexp_replace(passage, '\\s+', ' ', 'g')),
        lower(trim(regexp_replace(value_raw, '\\s+', ' ', 'g')))) > 0
      ELSE strpos(regexp_replace(passage, '[^0-9]', '', 'g'), rtrim(regexp_replace(value_raw, '[^0-9]', '', 'g'), '0')) > 0 END) AS present
  FROM ev),
failed AS (
  SELECT p.section_key, p.fact_id,
    CASE WHEN NOT s.kept THEN 'dangling_citation' WHEN NOT s.linked THEN 'unverifiable_citation'
      WHEN NOT s.stored OR NOT s.filed THEN 'dangling_citation' WHEN NOT s.present THEN 'citation_does_not_resolve' END AS reason,
    CASE WHEN NOT s.kept THEN 'Claim cites fact ' || p.fact_id
        || ' which no longer exists. The supporting evidence was removed after the claim was made.'
      WHEN NOT s.linked THEN 'Fact ' || s.predicate || '=' || {q('s.value_raw')}
        || ' has no chunk recorded, so its citation cannot be re-checked against the source.'
      WHEN NOT s.stored OR NOT s.filed THEN 'Fact ' || s.predicate || '=' || {q('s.value_raw')}
        || ' cites a chunk or document that no longer exists.'
      ELSE 'Claim cites ' || s.predicate || '=' || {q('s.value_raw')} || ' from ' || d.uri
        || ', but that value no longer appears in the cited passage. The source changed after the claim was made.' END AS detail
  FROM part1 p JOIN seen s ON s.fact_id = p.fact_id JOIN doc d ON d.document_id = s.document_id
  WHERE substr(sha256(p.section_key), 1, 2) <> '00'
  UNION ALL
  SELECT section_key, NULL, 'uncited_claim', 'Claim asserts ' || {q(CLAIM)}
    || ' but carries no citation. A supported claim without evidence is an invented one.'
  FROM sec1 WHERE ref LIKE '00%' AND value IS NOT NULL)"""

SHOWN = "kind, subject, predicate, scope_key, a_fact_id, b_fact_id, sign, delta, unit, detail"
PENDING = f"""
findings AS ({D.EVENT_FINDINGS}), decisions AS ({D.EVENT_DECISIONS}),
asked AS (
  SELECT finding_index, severity, CASE WHEN finding_index % 3 = 0 THEN explanation || ' (moved)' ELSE explanation END AS explanation
  FROM findings),
newest AS (
  SELECT explanation, verdict FROM (SELECT f.explanation, d.verdict, row_number() OVER (PARTITION BY f.explanation
      ORDER BY d.created_at DESC, d.decision_id DESC) AS rn FROM decisions d JOIN findings f USING (finding_id)) x WHERE rn = 1),
pending AS (SELECT a.*, n.verdict AS prior_verdict FROM asked a LEFT JOIN newest n USING (explanation)),
queue AS (SELECT *, CASE WHEN prior_verdict IS NULL THEN 'fresh' ELSE 'carried' END AS queue FROM pending)"""
DIFFED = f"""
{ARRIVED},
listed AS (SELECT 'doc-' || arrival || '.txt' AS name, sha256, arrival FROM arr),
now_ AS (SELECT * FROM listed WHERE arrival % 9 <> 5),
before_ AS (SELECT name, CASE WHEN arrival % 8 = 1 THEN reverse(sha256) ELSE sha256 END AS sha256 FROM listed WHERE arrival % 4 <> 0),
states AS (
  SELECT coalesce(n.name, b.name) AS name, CASE WHEN n.name IS NULL THEN 'removed' WHEN b.name IS NULL THEN 'added'
    WHEN n.sha256 <> b.sha256 THEN 'modified' END AS state FROM now_ n FULL OUTER JOIN before_ b ON n.name = b.name)"""

REFERENCE_SQL = {
    "a4_append_new": f"""WITH {ARRIVED} SELECT corpus, sha256, min(arrival) AS arrival FROM arr a WHERE NOT EXISTS (
      SELECT 1 FROM arr t WHERE t.arrival % 4 = 1 AND t.corpus = a.corpus AND t.sha256 = a.sha256) GROUP BY corpus, sha256""",
    "a7_known_hashes": f"""WITH {LETTERS} SELECT 'conv-' || document_id || CASE WHEN document_id % 10 = 0 THEN '.docx'
      WHEN document_id % 2 = 1 THEN '.md' ELSE '.txt' END AS name, sha256(text) AS sha256 FROM letter""",
    "b1_partition_readable": f"""WITH {LETTERS} SELECT uri, CASE WHEN document_id % 10 = 0 THEN NULL WHEN document_id % 2 = 1
      THEN 'text/markdown' ELSE 'text/plain' END AS mime, CASE WHEN document_id % 10 = 0 THEN 'conv-' || document_id ||
      '.docx skipped: conv-' || document_id || '.docx: .docx is not a supported format. Supported: .md, .pdf, .txt.' END AS explanation
      FROM letter""",
    "b2_dedupe_documents": f"""WITH {ARRIVED} SELECT sha256(corpus || chr(10) || sha256) AS document_id, corpus, sha256, uri FROM (
      SELECT *, row_number() OVER (PARTITION BY corpus, sha256 ORDER BY arrival) AS rn,
        max(CASE WHEN arrival % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, sha256) AS known FROM arr) x
      WHERE rn = 1 AND known = 0""",
    "b2_resolve_arrivals": f"""WITH {ARRIVED} SELECT corpus, arrival, sha256(corpus || chr(10) || sha256) AS document_id,
      CASE WHEN max(CASE WHEN arrival % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, sha256) = 1 THEN 'known'
        WHEN row_number() OVER (PARTITION BY corpus, sha256 ORDER BY arrival) = 1 THEN 'new' ELSE 'copy' END AS state FROM arr""",
    "b3_chunk_documents": f"WITH {LETTERS}, {CHUNKS} SELECT * FROM chunk",
    "b3_chunk_articles": f"WITH {ARTICLES}, {CHUNKS} SELECT document_id, ordinal, sha256(text) AS sha256, char_start, char_end FROM chunk",
    "b4_document_text": f"WITH {LETTERS}, {CHUNKS}, {WHOLE} SELECT * FROM whole",
    "c1_enrich_cached": f"WITH {REQUESTED} SELECT request_id, cache_key, cached OR request_id <> first_id AS hit FROM keyed",
    "c1_missing_requests": f"WITH {REQUESTED} SELECT request_id, cache_key FROM keyed WHERE NOT cached AND request_id = first_id",
    "c1_hit_counts": f"""WITH {REQUESTED} SELECT stage, count(*) FILTER (WHERE cached OR request_id <> first_id) AS cache_hits,
      count(*) FILTER (WHERE NOT cached AND request_id = first_id) AS cache_misses FROM keyed GROUP BY stage""",
    "c2_parse_classifications": f"WITH {CLASSED} SELECT document_id, kind, vendor, printf('%.2f', conf) AS confidence, reasoning, document_date, fits_kind FROM parsed",
    "c3_route_escalations": f"""WITH {CLASSED} SELECT document_id, kind, coalesce(reason, CASE WHEN document_id % 12 = 0 THEN
      'the document never names ''Customer  Corp'', so it may be an agreement between other parties rather than one of ours' END) AS reason FROM routed""",
    "c3_escalation_findings": f"""WITH {CLASSED} SELECT document_id, 'medium' AS severity, 'document' AS target_kind, {NAME} ||
      ': needs a human to say what it is — ' || reason || '. Proposed ''' || kind || ''' at confidence ' || printf('%.2f', conf)
      || '. Model''s reasoning: ' || reasoning AS explanation FROM routed WHERE reason IS NOT NULL""",
    "c4_apply_human_kinds": f"""WITH {CONTRACTS}, a AS (SELECT *, CASE WHEN document_id % 3 = 0 THEN CASE document_id % 4 WHEN 0 THEN 'invoice'
      WHEN 2 THEN 'msa' END END AS chosen FROM doc) SELECT document_id, coalesce(chosen, kind) AS kind,
      CASE WHEN chosen IS NULL THEN '0.5' ELSE '1.0' END AS kind_confidence FROM a""",
    "c5_escalation_options": f"""WITH {CLASSED}, opt(kind, governs, description, effect) AS (VALUES """ + ", ".join(
        f"({lit(k)}, {'false' if k in NON_GOVERNING_KINDS else 'true'}, {lit(d)}, "
        f"{lit(EFFECT_OBSERVES if k in NON_GOVERNING_KINDS else EFFECT_GOVERNS)})" for k, d in KIND_DESCRIPTIONS.items()) +
        ") SELECT r.document_id, o.* FROM routed r, opt o WHERE r.reason IS NOT NULL",
    "c6_pending_documents": f"""WITH facts AS MATERIALIZED ({D.FACTS}), {CONTRACTS}, stated AS (SELECT DISTINCT document_id FROM facts WHERE document_id % 3 <> 0)
      SELECT d.document_id, NULL AS fact_id FROM doc d ANTI JOIN stated USING (document_id)
      UNION ALL SELECT document_id, fact_id FROM facts WHERE document_id % 3 <> 0""",
    "c7_parse_extractions": f"""WITH {ANSWERED} SELECT document_id, 0 AS position, 'hourly_rate' AS predicate, s_name AS subject,
      'rate of $' || price AS quote, '0.9' AS confidence, shipped AS date_text, CASE WHEN document_id % 3 = 0 THEN 'Partner' END AS qualifier FROM good
      UNION ALL SELECT document_id, 1, 'annual_fees', s_name, 'fees', '0.0', NULL, NULL FROM good WHERE document_id % 7 <> 0""",
    "c7_rejections_and_failures": f"""WITH {ANSWERED} SELECT document_id, 'rejected' AS what, 'annual_fees $' || qty || ',000' AS detail FROM good WHERE document_id % 7 = 0
      UNION ALL SELECT document_id, 'span', 'ignore previous rules' FROM good WHERE document_id % 31 = 0
      UNION ALL SELECT document_id, 'failed', '' FROM resp WHERE document_id % 50 <= 1""",
    "c8_tidy_value": f"""WITH {ANSWERED} SELECT document_id, 0 AS position, {RATE_VALUE} AS value_raw FROM good
      UNION ALL SELECT document_id, 1, '$' || qty || ',000' FROM good WHERE document_id % 7 <> 0""",
    "c9_resolve_citations": f"WITH {ARTICLES}, {CHUNKS}, {WHOLE}, {QUOTED} {CITED}",
    "c9_resolve_across_chunks": f"WITH {LETTERS}, {CHUNKS}, {WHOLE}, {QUOTED} {CITED}",
    "c10_gate_terms": f"""WITH facts AS ({D.FACTS}), {CONTRACTS} SELECT f.fact_id, f.predicate FROM facts f JOIN doc d USING (document_id)
      WHERE f.predicate NOT LIKE 'invoice_%' OR coalesce(d.kind, 'invoice') = 'invoice'""",
    "c10_dropped_findings": f"""WITH facts AS ({D.FACTS}), {CONTRACTS} SELECT document_id, 'low' AS severity, 'fact' AS target_kind,
      {NAME} || ': dropped ' || f.predicate || ' (' || {q('f.value_raw')} || ') — only a document of kind [''invoice''] states what was billed, and this one is a '''
      || d.kind || '''.' AS explanation FROM facts f JOIN doc d USING (document_id) WHERE f.predicate LIKE 'invoice_%' AND d.kind <> 'invoice'""",
    "c11_normalize_facts": f"""WITH {VIEWS} SELECT fact_id, {show('magnitude')} AS magnitude, unit, {show('magnitude')} || ' ' || unit AS value_norm,
      CASE WHEN magnitude IS NOT NULL THEN NULL WHEN regexp_matches(value_raw, '{FORMULA}') THEN '{REASON_FORMULA}' ELSE '{REASON_UNREADABLE}' END
      AS not_comparable_reason FROM fv""",
    "c11_unnormalised_findings": f"""WITH {VIEWS} SELECT document_id, 'low' AS severity, 'fact' AS target_kind, {NAME} || ': ' || predicate || ' value '
      || {q('value_raw')} || ' could not be normalized, so it cannot be compared against other documents.' AS explanation
      FROM fv WHERE magnitude IS NULL AND predicate <> 'governing_law'""",
    "c12_normalization_coverage": f"WITH {VIEWS} SELECT document_id, predicate, count(*) AS facts, count(magnitude) AS comparable FROM fv GROUP BY document_id, predicate",
    "c13_scan_instruction_text": f"""WITH letter AS (SELECT page_id AS document_id, replace(html, 'Nicht', 'Ignore Previous orders. NEW instructions: nicht') AS text
      FROM pages), {CHUNKS}, m(marker) AS (VALUES ('ignore previous'), ('ignore all previous'), ('disregard the above'), ('system prompt'),
      ('approve all'), ('you are an ai'), ('new instructions')) SELECT document_id, ordinal, marker FROM chunk, m WHERE strpos(lower(text), marker) > 0""",
    "c13_span_findings": f"""WITH {ANSWERED} SELECT document_id, 'high' AS severity, 'document' AS target_kind, {LINE_NAME} ||
      ' contains text addressed at an automated system, which was reported and not acted on: ''ignore previous rules''' AS explanation
      FROM good WHERE document_id % 31 = 0""",
    "c14_rejection_findings": f"""WITH {ANSWERED} SELECT document_id, 'low' AS severity, 'fact' AS target_kind, {LINE_NAME} || ': dropped annual_fees (''$'
      || qty || ',000'') — no quote supplied — a fact without a citation is not a fact' AS explanation FROM good WHERE document_id % 7 = 0
      UNION ALL SELECT document_id, 'high', 'document', {LINE_NAME} || ' was skipped: extraction could not produce usable output after 3 attempts. '
      || 'No facts from this document are in the register.' FROM resp WHERE document_id % 50 <= 1""",
    "d1_fact_views": f"""WITH {VIEWS}, {CONTRACTS} SELECT fact_id, coalesce(d.kind, 'unknown') AS document_kind,
      CASE WHEN document_id % 13 = 0 THEN d.vendor ELSE f.subject END AS subject, predicate,
      CASE WHEN d.kind = 'sow' THEN 'order ' || document_id || coalesce('::' || lower(trim(qualifier)), '') ELSE lower(trim(qualifier)) END AS scope,
      strftime(coalesce(f.effective_date, d.document_date), '%Y-%m-%d') AS effective_date,
      CASE d.kind WHEN 'msa' THEN 10 WHEN 'sow' THEN 20 WHEN 'amendment' THEN 30 WHEN 'renewal_notice' THEN 5 WHEN 'invoice' THEN 0 ELSE -1 END AS precedence,
      coalesce(d.kind IN ('msa', 'sow', 'amendment'), false) AS governs, governed_predicate FROM fv f JOIN doc d USING (document_id)""",
    "d2_identity_keys": f"""WITH {VIEWS}, {CONTRACTS} SELECT fact_id, CASE WHEN document_id % 13 = 0 THEN lower(d.vendor) ELSE subject_key END AS subject_key,
      CASE WHEN d.kind = 'sow' THEN 'order ' || document_id || coalesce(' ' || scope_key, '') ELSE scope_key END AS scope_key
      FROM fv f JOIN doc d USING (document_id)""",
    "d3_display_names": f"{RUN2} SELECT subject_key, vendor FROM names2",
    "d4_reconcile": f"""{RUN2} SELECT section_key, vendor, predicate, scope_key, gid AS governing_fact_id, value, {show('magnitude')} AS magnitude, unit,
      since AS effective_date, source_kind, status, greatest(n_governing - 1, 0) AS n_superseded, n_observed FROM res2""",
    "d4_contributions": f"{RUN2} SELECT section_key, fact_id, role FROM part2",
    "d5_governing_at": f"""WITH {VIEWS},
      daily AS (SELECT subject_key, predicate, coalesce(scope_key, '') AS scope, effective_date AS since,
        arg_max(fact_id, (precedence, fact_seq)) AS governing_fact_id
        FROM fv WHERE governs AND effective_date IS NOT NULL GROUP BY ALL),
      probe AS (SELECT fact_id AS probe_id, subject_key, governed_predicate AS predicate, coalesce(scope_key, '') AS scope,
        CAST(effective_date + INTERVAL 1 DAY AS DATE) AS since FROM fv WHERE NOT governs AND effective_date IS NOT NULL)
      SELECT probe_id, strftime(since, '%Y-%m-%d') AS probe_date, governing_fact_id
      FROM probe ASOF LEFT JOIN daily USING (subject_key, predicate, scope, since)""",
    "d6_supersession": f"{RUN2} SELECT section_key, fact_id AS superseded_fact_id, gid AS governing_fact_id FROM part2 WHERE role = 'superseded'",
    "e1_equal_rank": f"WITH {VIEWS}, {E1} SELECT {SHOWN} FROM e1",
    "e1_disagreeing_facts": f"""WITH {VIEWS}, w AS (SELECT *, count(*) OVER p AS n_facts, min(magnitude) OVER p AS lo, max(magnitude) OVER p AS hi,
      dense_rank() OVER (PARTITION BY subject_key, predicate, scope_key, effective_date, precedence ORDER BY magnitude)
      + dense_rank() OVER (PARTITION BY subject_key, predicate, scope_key, effective_date, precedence ORDER BY magnitude DESC) - 1 AS n_values
      FROM fv WHERE governs AND magnitude IS NOT NULL WINDOW p AS (PARTITION BY subject_key, predicate, scope_key, effective_date, precedence))
      SELECT fact_id, predicate, {show('magnitude')} AS magnitude, n_facts, n_values FROM w WHERE lo < hi""",
    "e2_temporal_violations": f"WITH {VIEWS}, {E2} SELECT {SHOWN} FROM e2",
    "e3_arithmetic_mismatches": f"WITH {VIEWS}, {E3} SELECT {SHOWN} FROM e3",
    "e4_governed_terms": f"WITH {VIEWS} SELECT predicate, governed_predicate, count(*) AS facts FROM fv GROUP BY ALL",
    "e5_detect": f"""{CANDIDATES} SELECT kind, subject, predicate, scope_key, a_fact_id, b_fact_id, a_value, b_value, a_kind, b_kind,
      strftime(a_date, '%Y-%m-%d') AS a_date, strftime(b_date, '%Y-%m-%d') AS b_date FROM cand""",
    "e6_with_direction": f"{CANDIDATES} SELECT kind, a_fact_id, b_fact_id, sign, {direction()} AS direction FROM cand",
    "e7_candidate_counts": f"{CANDIDATES} SELECT kind, count(*) AS candidates FROM cand GROUP BY kind",
    "f1_apply_verdicts": f"{JUDGED} SELECT kind, a_fact_id, b_fact_id, candidate_index, is_real_conflict, severity, explanation FROM verdict",
    "f2_check_explanations": f"""{JUDGED} SELECT kind, a_fact_id, b_fact_id, withheld, CASE WHEN withheld THEN direction || ' ' || detail || {lit(' ' + NOTE_WITHHELD)}
      ELSE explanation END AS explanation FROM verdict""",
    "f3_merge_conflicts": f"""{JUDGED} SELECT kind, a_fact_id, b_fact_id, severity, CASE WHEN is_real_conflict THEN 'open' ELSE 'dismissed' END AS status
      FROM merged WHERE old IS NULL""",
    "f3_conflict_findings": f"""{JUDGED} SELECT kind, a_fact_id, b_fact_id, severity, subject || ' — ' || predicate || ': ' || explanation AS explanation
      FROM merged WHERE is_real_conflict AND coalesce(old, 'open') = 'open'""",
    "f3_settled_before": f"{JUDGED} SELECT count(*) AS already_settled FROM merged WHERE old = 'dismissed'",
    "g1_section_plans": f"{SECTIONS} SELECT section_key, content, content_hash, n_facts, gid AS governing_fact_id FROM sec2",
    "g1_section_parts": f"{SECTIONS} SELECT section_key, part, value_raw AS content FROM listed2",
    "g1_hot_section": f"""WITH {VIEWS.replace("fv AS MATERIALIZED (", "fv0 AS MATERIALIZED (", 1)}, fv AS MATERIALIZED (
      SELECT * REPLACE ('Everyone' AS subject, 'everyone' AS subject_key, NULL::VARCHAR AS scope_key, 'hourly_rate' AS predicate, 'hourly_rate' AS governed_predicate)
      FROM fv0 WHERE predicate NOT LIKE 'invoice_%'), {register(2)}, {sections(2)} SELECT section_key, content, content_hash, n_facts FROM sec2""",
    "g2_plan_recomposition": f"{PLANNED} SELECT section_key, reason IS NULL AS carried_forward, reason FROM plan",
    "g3_apply_plan": f"""{PLANNED} SELECT section_key, hash_now AS content_hash, '1' AS composer_version, carried_forward,
      sha256('run-2' || chr(10) || section_key) AS version_id, CASE WHEN had THEN sha256('run-1' || chr(10) || section_key) END AS prev_version_id FROM ver2""",
    "g4_claims": f"{PLANNED} SELECT section_key, {CLAIM} AS text, CASE WHEN value IS NULL THEN 'unsupported' ELSE 'supported' END AS status FROM ver2",
    "g4_citations": f"{RUN2} SELECT section_key, fact_id FROM part2",
    "g5_plan_summary": f"""{PLANNED} SELECT count(*) AS sections_total, count(*) FILTER (WHERE NOT carried_forward) AS sections_rederived,
      count(*) FILTER (WHERE carried_forward) AS sections_carried_forward FROM ver2""",
    "g6_previous_run": """SELECT corpus, run_id FROM (SELECT 'corpus ' || user_id AS corpus, CAST(event_id AS VARCHAR) AS run_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM events WHERE event_type = 'purchase') x WHERE rn = 1""",
    "h1_validate_rules": f"""WITH r AS ({D.RULE_PROPOSALS}), c AS (SELECT *, coalesce(code, '?') AS named,
        row_number() OVER (PARTITION BY ruleset_id, code ORDER BY position) AS nth FROM r)
      SELECT position, 'missing ''ruleset_id''' AS problem FROM c WHERE ruleset_id IS NULL
      UNION ALL SELECT position, 'missing ''code''' FROM c WHERE code IS NULL
      UNION ALL SELECT position, named || ': kind ''ratio'' is not one of [''numeric_bound'', ''numeric_max'', ''numeric_min'', ''presence_required'']' FROM c WHERE kind = 'ratio'
      UNION ALL SELECT position, named || ': severity ''urgent'' is not valid' FROM c WHERE severity = 'urgent'
      UNION ALL SELECT position, named || ': missing ''predicate''' FROM c WHERE predicate IS NULL
      UNION ALL SELECT position, named || ': numeric_max needs config.max' FROM c WHERE kind = 'numeric_max' AND max IS NULL
      UNION ALL SELECT position, named || ': numeric_min needs config.min' FROM c WHERE kind = 'numeric_min' AND min IS NULL
      UNION ALL SELECT position, named || ': numeric_bound needs config.expr' FROM c WHERE kind = 'numeric_bound' AND expr IS NULL
      UNION ALL SELECT position, 'duplicate code ''' || code || '''' FROM c WHERE code IS NOT NULL AND nth > 1""",
    "h2_evaluate_rules": f"{violations(2)} SELECT code, subject, predicate, observed, explanation, fact_id, checked, severity FROM viol",
    "h3_bound_expressions": f"""{violations(2)}, caps AS (SELECT g.vendor, g.value, g.magnitude, f.magnitude AS fees, p.magnitude AS pay, n.magnitude AS renew
        FROM gov g LEFT JOIN gov f ON f.subject_key = g.subject_key AND f.predicate = 'annual_fees'
        LEFT JOIN gov p ON p.subject_key = g.subject_key AND p.predicate = 'payment_terms_days'
        LEFT JOIN gov n ON n.subject_key = g.subject_key AND n.predicate = 'auto_renew_months' WHERE g.predicate = 'liability_cap'),
      bounds AS (
        SELECT *, 'B0' AS code, '2 * annual_fees' AS expr, fees * 2 AS bound FROM caps
        UNION ALL SELECT *, 'B1', 'annual_fees + 1000000 * 3', (fees + 1000000) * 3 FROM caps
        UNION ALL SELECT *, 'B2', 'annual_fees - 1 * 2 + payment_terms_days', (fees - 1) * 2 + pay FROM caps
        UNION ALL SELECT *, 'B3', ' 1.5*annual_fees ', NULL FROM caps
        UNION ALL SELECT *, 'B4', '2 *', NULL FROM caps UNION ALL SELECT *, 'B5', '2 annual_fees', NULL FROM caps
        UNION ALL SELECT *, 'B6', 'no_such_term', NULL FROM caps UNION ALL SELECT *, 'B7', '10 - auto_renew_months', 10 - renew FROM caps)
      SELECT code, vendor AS subject, magnitude IS NOT NULL AND bound IS NOT NULL AS checked,
        CASE WHEN magnitude IS NULL THEN code || ' could not be evaluated for ' || vendor || ': the recorded liability_cap ' || {q('value')}
            || ' is {REASON_FORMULA}. Not checked.'
          WHEN bound IS NULL THEN code || ' could not be evaluated for ' || vendor || ': the bound ' || {q('expr')}
            || ' needs a value this corpus does not supply. Not checked.'
          ELSE 'Bound. ' || vendor || ' has liability_cap of ' || value || ' (' || {show('magnitude')} || '), which exceeds the limit of '
            || {show('CAST(bound AS DECIMAL(38,6))')} || '.' END AS explanation
      FROM bounds WHERE magnitude IS NULL OR bound IS NULL OR magnitude > bound""",
    "h4_presence_required": f"""WITH {VIEWS}, {register(1, D.LAWLESS)},
      vend AS (SELECT DISTINCT subject_key, vendor FROM res1 WHERE scope_key IS NULL),
      wanted(code, term) AS (VALUES ('HAS-0', 'governing_law'), ('HAS-1', 'hourly_rate'), ('HAS-2', 'audit_rights'), ('HAS-3', 'invoice_rate'))
      SELECT code, vendor AS subject, 'Must be stated. No supported value for ' || term || ' was found for ' || vendor || '.' AS explanation, 'low' AS severity
      FROM vend v, wanted w WHERE NOT EXISTS (SELECT 1 FROM res1 g WHERE g.scope_key IS NULL AND g.gid IS NOT NULL
        AND g.subject_key = v.subject_key AND g.predicate = w.term)""",
    "h2_part_playbook": f"""{RUN2}, rule AS ({D.PART_RULES}),
      gov AS MATERIALIZED (SELECT * FROM res2 WHERE scope_key IS NULL AND gid IS NOT NULL),
      vend AS MATERIALIZED (SELECT DISTINCT subject_key, vendor FROM res2 WHERE scope_key IS NULL)
      SELECT code, vendor AS subject, r.predicate, gid AS fact_id, magnitude IS NOT NULL AS checked,
        CASE WHEN magnitude IS NULL THEN 'low' ELSE severity END AS severity
      FROM rule r JOIN gov g ON g.predicate = r.predicate WHERE kind <> 'presence_required' AND (magnitude IS NULL
        OR (kind = 'numeric_max' AND magnitude > r.max) OR (kind = 'numeric_min' AND magnitude < r.min))
      UNION ALL SELECT code, vendor, r.predicate, NULL, true, severity FROM rule r, vend v WHERE kind = 'presence_required'
        AND NOT EXISTS (SELECT 1 FROM gov g WHERE g.subject_key = v.subject_key AND g.predicate = r.predicate)""",
    "h5_rule_counts": f"{violations(2)} SELECT count(*) AS violations, count(*) FILTER (WHERE NOT checked) AS not_checked FROM viol",
    "h6_link_sections": f"""{violations(2)} SELECT v.code, v.subject, k.section_key, '[' || v.code || '] ' || v.explanation AS explanation, v.severity
      FROM viol v LEFT JOIN (SELECT section_key FROM res1 WHERE (n_governing + n_observed) % 2 = 1) k
      ON k.section_key = v.subject_key || '::' || v.predicate""",
    "i1_verify_run": f"{EVIDENCE} SELECT section_key, fact_id, reason, detail FROM failed WHERE reason IS NOT NULL",
    "i2_value_present": f"{EVIDENCE} SELECT fact_id, present FROM seen WHERE kept AND linked AND stored",
    "i3_verification_summary": f"""{EVIDENCE} SELECT (SELECT count(*) FROM sec1) AS claims_checked,
      (SELECT count(*) FROM part1 WHERE substr(sha256(section_key), 1, 2) <> '00') AS citations_checked,
      (SELECT count(*) FROM failed WHERE reason IS NOT NULL) AS failures,
      (SELECT count(*) FROM failed WHERE reason IS NOT NULL) = 0 AS passed""",
    "j1_build_changes": f"""{PLANNED} SELECT section_key, CASE WHEN NOT had THEN 'added' WHEN old_hash <> hash_now THEN 'changed' ELSE 'unchanged' END AS status,
      hash_now AS content_hash, old_hash AS previous_hash FROM ver2""",
    "j2_change_causes": f"""{PLANNED}, changed AS MATERIALIZED (SELECT section_key FROM ver2 WHERE NOT had OR old_hash <> hash_now),
      now_ AS MATERIALIZED (SELECT DISTINCT section_key, {NAME} AS document FROM part2 SEMI JOIN changed USING (section_key)),
      then_ AS MATERIALIZED (SELECT DISTINCT section_key, {NAME} AS document FROM part1 SEMI JOIN changed USING (section_key)),
      new_ AS MATERIALIZED (SELECT * FROM now_ ANTI JOIN then_ USING (section_key, document))
      SELECT * FROM new_ UNION ALL SELECT * FROM now_ ANTI JOIN new_ USING (section_key)""",
    "j3_change_summary": f"""{PLANNED} SELECT count(*) AS sections_total, count(*) FILTER (WHERE NOT had) AS added,
      count(*) FILTER (WHERE had AND old_hash <> hash_now) AS changed, count(*) FILTER (WHERE old_hash = hash_now) AS unchanged,
      round(count(*) FILTER (WHERE old_hash = hash_now) / count(*), 3) AS untouched_fraction FROM ver2""",
    "k1_assemble_findings": f"""{violations(2)}, low AS (SELECT DISTINCT document_id, {NAME} || ': ' || predicate || ' value '
        || {q('value_raw')} || ' could not be normalized, so it cannot be compared against other documents.' AS explanation
        FROM fv WHERE magnitude IS NULL AND predicate <> 'governing_law'),
      f AS (SELECT 3 AS ord, 'extract' AS stage, 'low' AS severity, explanation, sha256(document_id || chr(10) || explanation) AS key FROM low
        UNION ALL SELECT 5, 'examine', severity, '[' || code || '] ' || explanation, sha256(code || chr(10) || subject_key || chr(10) || '[' || code || '] ' || explanation) FROM viol)
      SELECT stage, severity, explanation, row_number() OVER (ORDER BY ord, sha256(stage || chr(10) || key)) - 1 AS finding_index FROM f""",
    "k2_commit_decisions": """SELECT event_id AS finding_index, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity,
      CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'approved' ELSE 'rejected' END AS status, 'finding' AS kind,
      CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'approved' ELSE 'rejected' END AS verdict, 'reviewer' AS actor FROM events""",
    "k3_prior_verdicts": f"WITH {PENDING} SELECT finding_index, prior_verdict FROM pending",
    "k4_resolved_findings": f"""{violations(1)}, {RULE_TEXT.replace('{r}', '2').replace('vend AS', 'vendb AS').replace('FROM vend v', 'FROM vendb v').replace('gov AS', 'govb AS').replace('gov g', 'govb g').replace('gov f', 'govb f').replace('rule(', 'ruleb(').replace('rule r', 'ruleb r').replace('tested', 'testedb').replace('viol AS', 'violb AS')}
      SELECT '[' || code || '] ' || explanation AS explanation FROM viol EXCEPT SELECT '[' || code || '] ' || explanation FROM violb""",
    "k5_review_queue": f"""WITH {PENDING} SELECT queue, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_rank,
      finding_index, severity FROM queue""",
    "k5_queue_counts": f"WITH {PENDING} SELECT queue, severity, count(*) AS findings FROM queue GROUP BY ALL",
    "k6_decision_log": f"""WITH {PENDING} SELECT d.decision_id, d.verdict, d.actor, f.severity, f.explanation,
      strftime(d.created_at, '%Y-%m-%d %H:%M:%S') AS decided_at FROM decisions d JOIN findings f USING (finding_id)""",
    "l1_deliverable": f"{PLANNED} SELECT section_key, content_now AS content, hash_now AS content_hash, carried_forward FROM ver2",
    "l2_provenance": f"""{EVIDENCE} SELECT p.section_key, p.fact_id, p.claim,
      CASE WHEN e.document_id % 2 = 1 THEN 'order-' || e.document_id || '.md' ELSE 'order_' || e.document_id || '.txt' END AS document,
      d.kind AS document_kind, strftime(e.effective_date, '%Y-%m-%d') AS effective_date,
      CASE WHEN e.linked AND e.stored THEN e.passage END AS passage, CASE WHEN e.linked AND e.stored THEN length(e.passage) END AS char_end
      FROM (SELECT x.section_key, x.fact_id, c.claim FROM part1 x JOIN (SELECT section_key, {CLAIM} AS claim FROM sec1) c
        ON c.section_key = x.section_key) p JOIN ev e ON e.fact_id = p.fact_id JOIN doc d ON d.document_id = e.document_id
      WHERE e.kept AND e.filed""",
    "l3_list_runs": """SELECT CAST(event_id AS VARCHAR) AS run_id, 'corpus ' || user_id AS corpus, CASE event_type WHEN 'purchase' THEN 'completed'
      WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'click' THEN 'awaiting_review' ELSE 'interrupted' END AS status,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 25""",
    "l4_stage_costs": f"""WITH c AS ({D.CALLS}), p AS (SELECT run_id, stage, CASE WHEN cached THEN 0 ELSE tokens_in END AS tin,
        CASE WHEN cached THEN 0 ELSE tokens_out END AS tout, cached, true AS real,
        CASE model WHEN 'gemini-3.6-flash' THEN 0.30 WHEN 'gemini-3.1-flash-lite' THEN 0.10 ELSE 0.00 END AS pin,
        CASE model WHEN 'gemini-3.6-flash' THEN 2.50 WHEN 'gemini-3.1-flash-lite' THEN 0.40 ELSE 0.00 END AS pout FROM c
        UNION ALL SELECT run_id, 'adjudicate', 0, 0, false, false, 0.00, 0.00 FROM c GROUP BY run_id HAVING count(*) % 2 = 0)
      SELECT run_id, stage, CAST(sum(tin) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out,
        CAST(CAST(sum(CAST(tin * pin + tout * pout AS DECIMAL(30,6))) AS DECIMAL(30,12)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(30,12))::VARCHAR AS cost_usd,
        count(*) FILTER (WHERE cached) AS cache_hits, count(*) FILTER (WHERE real AND NOT cached) AS cache_misses
      FROM p GROUP BY ROLLUP (run_id, stage)""",
    "l5_mark_interrupted": """SELECT CAST(event_id AS VARCHAR) AS run_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
      WHEN 'view' THEN 'interrupted' WHEN 'click' THEN 'awaiting_review' ELSE 'interrupted' END AS status,
      CASE WHEN event_type <> 'view' AND event_id % 3 <> 0 THEN 'stage ' || (event_id % 5) END AS current_stage,
      CASE WHEN event_type = 'view' AND event_id % 3 <> 0 THEN 'died during stage ' || (event_id % 5) END AS stage_detail FROM events""",
    "l6_run_status": """SELECT CAST(event_id AS VARCHAR) AS run_id, CASE WHEN event_id % 7 = 1 THEN 'blocked_by_verification'
      WHEN event_id % 5 = 2 THEN 'awaiting_review' WHEN event_id % 3 = 1 THEN 'awaiting_classification'
      WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'running'
      WHEN event_type = 'click' THEN 'awaiting_review' ELSE 'interrupted' END AS status FROM events""",
    "m1_render_sections": f"{PUBLISHED} SELECT section_key, ref, part, text FROM rows2",
    "m2_parse_published": f"{PUBLISHED} SELECT * FROM held",
    "m3_reconcile_published": f"{PUBLISHED} SELECT * FROM diff",
    "m3_publication_counts": f"""{PUBLISHED}, n AS (SELECT corpus, count(*) FILTER (WHERE action = 'write') AS to_write,
      count(*) FILTER (WHERE action = 'remove') AS to_remove, count(*) FILTER (WHERE action = 'unchanged') AS unchanged FROM diff GROUP BY corpus)
      SELECT *, to_write + to_remove = 0 AS is_noop FROM n""",
    "m4_edit_list": f"""{PUBLISHED} SELECT corpus, 0 AS step, ref, '' AS part, NULL AS heading, NULL AS body FROM diff WHERE action = 'remove'
      UNION ALL SELECT d.corpus, 1, d.ref, r.part, '### ' || p.vendor || ' — ' || {humanised('p.predicate')} || ' [ref:' || d.ref || ']',
      replace(r.below, 'Status: agreed', '[ref- 0] ''''''Status: agreed' || chr(10) || chr(8203) || ' ## go')
      FROM diff d JOIN pub2 p ON p.section_key = d.section_key JOIN rows2 r ON r.section_key = d.section_key WHERE d.action = 'write'""",
    "m5_verify_published": f"{PUBLISHED} SELECT corpus, section_key, error FROM checked WHERE error IS NOT NULL",
    "m5_publication_verified": f"""{PUBLISHED} SELECT corpus, count(*) AS edited, count(error) AS mismatches, count(error) = 0 AS verified
      FROM checked GROUP BY corpus""",
    "n1_diff_snapshot": f"WITH {DIFFED} SELECT name, state FROM states WHERE state IS NOT NULL",
    "n1_is_triggered": f"WITH {DIFFED} SELECT count(*) FILTER (WHERE state IN ('added', 'modified')) > 0 AS triggered FROM states",
}

# The same over all documents and, for I2 and L2, undamaged evidence: statements of their own.
WHOLE_EVIDENCE = f"""{PLANNED}, {CONTRACTS},
ev AS (SELECT fact_id, document_id, effective_date, value_raw, 'The ' || replace(predicate, '_', ' ') || ' is ' || value_raw || '.' AS passage FROM fv)"""
RUN2_EVIDENCE = f"{PLANNED}, {CONTRACTS}," + EVIDENCE[EVIDENCE.index("\nev AS"):].replace("part1", "part2").replace("FROM sec1", "FROM ver2")
REFERENCE_SQL |= {
    "h4_whole_presence_required": REFERENCE_SQL["h4_presence_required"].replace(register(1, D.LAWLESS), register(2, D.LAWLESS)).replace("res1", "res2"),
    "i1_verify_whole_run": f"{RUN2_EVIDENCE} SELECT section_key, fact_id, reason, detail FROM failed WHERE reason IS NOT NULL",
    "i2_whole_value_present": f"{WHOLE_EVIDENCE} SELECT fact_id, true AS present FROM ev",
    "i3_whole_verification_summary": f"""{RUN2_EVIDENCE} SELECT (SELECT count(*) FROM ver2) AS claims_checked,
      (SELECT count(*) FROM part2 WHERE substr(sha256(section_key), 1, 2) <> '00') AS citations_checked,
      (SELECT count(*) FROM failed WHERE reason IS NOT NULL) AS failures,
      (SELECT count(*) FROM failed WHERE reason IS NOT NULL) = 0 AS passed""",
    "l2_whole_provenance": f"""{WHOLE_EVIDENCE} SELECT p.section_key, p.fact_id, c.claim,
      CASE WHEN e.document_id % 2 = 1 THEN 'order-' || e.document_id || '.md' ELSE 'order_' || e.document_id || '.txt' END AS document,
      d.kind AS document_kind, strftime(e.effective_date, '%Y-%m-%d') AS effective_date, e.passage, length(e.passage) AS char_end
      FROM part2 p JOIN (SELECT section_key, {CLAIM} AS claim FROM ver2) c ON c.section_key = p.section_key
      JOIN ev e ON e.fact_id = p.fact_id JOIN doc d ON d.document_id = e.document_id""",
}
# A register that is maintained ends where one built anew does.
REFERENCE_SQL["n3_maintained_states"] = REFERENCE_SQL["d4_reconcile"]
REFERENCE_SQL["n3_maintained_candidates"] = REFERENCE_SQL["e5_detect"]
# Metrics that are stored add up to those of the calls.
REFERENCE_SQL["l4_stored_metrics"] = REFERENCE_SQL["l4_stage_costs"]
REFERENCE_SQL["a5_rules_frame"] = f"""WITH part_rule AS ({D.PART_RULES}),
  r AS (SELECT row_number() OVER (ORDER BY position) AS number, position, CASE WHEN position % 11 = 0 THEN 'P-1' ELSE code END AS code,
    CASE WHEN position % 13 = 0 THEN 'ratio' ELSE kind END AS kind FROM part_rule),
  good AS (SELECT * FROM r WHERE position % 17 <> 0)
  SELECT number, code, kind, NULL AS problem FROM good
  UNION ALL SELECT number, NULL, NULL, {lit(NOT_A_RULE)} FROM r WHERE position % 17 = 0
  UNION ALL SELECT number, code, NULL, code || ': kind ''ratio'' is not one of [''numeric_bound'', ''numeric_max'', ''numeric_min'', ''presence_required'']' FROM good WHERE kind = 'ratio'
  UNION ALL SELECT number, code, NULL, 'duplicate code ''' || code || '''' FROM (SELECT *, min(number) OVER (PARTITION BY code) AS first FROM good) g WHERE number > first"""
REFERENCE_SQL["a6_register_rows"] = f"""{PUBLISHED}, pieces AS (
    SELECT '' AS section_key, '' AS part, {lit(REGISTER_TITLE)} || chr(10) || chr(10) || 'Corpus **all** · run `run-2` · ' || (SELECT count(*) FROM rows2 WHERE part = '')
      || ' obligations.' || chr(10) || chr(10) || {lit(REGISTER_PREFACE)} || chr(10) || chr(10) || '---' || chr(10) AS text
    UNION ALL SELECT section_key, part, CASE WHEN ends_with(text, '*') THEN text || chr(10) ELSE text END FROM rows2)
  SELECT row_number() OVER (ORDER BY section_key, part, i) AS number, lines[i] AS line
  FROM (SELECT section_key, part, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM pieces) p) q"""
