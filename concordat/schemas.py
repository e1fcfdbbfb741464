"""Columns of the stored tables (partition columns last)."""

SCHEMAS = {
    "documents": (
        "document_id string, doc_seq bigint, arrival string, uri string, sha256 string, mime string, "
        "corpus string"
    ),
    # Which document each path has held, and since when.
    "arrivals": "uri string, document_id string, arrived_at timestamp, corpus string",
    # One row per answer to "what is this document?"; a human's answer outweighs the classifier's.
    "document_kinds": (
        "document_id string, decided_by string, kind string, kind_confidence double, "
        "vendor string, document_date date, corpus string"
    ),
    "chunks": (
        "chunk_id string, document_id string, ordinal int, text string, char_start int, "
        "char_end int, corpus string"
    ),
    "facts": (
        "fact_id string, fact_seq bigint, document_id string, chunk_id string, predicate string, "
        "subject string, value_raw string, value_norm string, unit string, qualifier string, "
        "effective_date date, confidence double, char_start int, char_end int, "
        "not_comparable_reason string, extractor_version string, corpus string"
    ),
    # Facts in context, by the batch in which they came and a hash of their group.
    "fact_views": (
        "fact_id string, fact_seq bigint, document_id string, predicate string, subject string, "
        "value_raw string, effective_date date, document_kind string, subject_key string, "
        "scope_key string, scope_id string, precedence int, governs boolean, governed_predicate string, "
        "magnitude decimal(18,6), unit string, corpus string, batch string, bucket int"
    ),
    # Which documents a run rests on, and the batch that holds their facts.
    "run_documents": "document_id string, signature string, batch string, corpus string, run_id string",
    "group_states": (
        "subject_key string, predicate string, scope_id string, "
        "governing struct<fact_id:string,fact_seq:bigint,subject:string,value_raw:string,magnitude:decimal(18,6),"
        "unit:string,effective_date:date,document_id:string,document_kind:string>, "
        "rank struct<on:date,precedence:int,fact_seq:bigint>, n_governing bigint, n_observed bigint, "
        "digest_0 decimal(38,0), digest_1 decimal(38,0), corpus string, run_id string"
    ),
    "vendor_spellings": "subject_key string, subject string, weight bigint, corpus string, run_id string",
    "section_versions": (
        "version_id string, section_key string, content string, content_hash string, "
        "fact_digest string, composer_version string, carried_forward boolean, "
        "prev_version_id string, corpus string, run_id string"
    ),
    "section_parts": "section_key string, part string, content string, corpus string, run_id string",
    "claims": "claim_id string, section_key string, text string, status string, corpus string, run_id string",
    "citations": "claim_id string, section_key string, fact_id string, corpus string, run_id string",
    "candidates": (
        "kind string, subject string, subject_key string, predicate string, scope_key string, "
        "a_fact_id string, b_fact_id string, a_seq bigint, b_seq bigint, a_value string, "
        "b_value string, a_kind string, b_kind string, a_date date, b_date date, sign int, "
        "delta decimal(38,12), unit string, detail string, candidate_index bigint, "
        "batch_id bigint, index int, corpus string, run_id string"
    ),
    "conflicts": (
        "a_fact_id string, b_fact_id string, kind string, severity string, status string, "
        "explanation string, corpus string, run_id string"
    ),
    "findings": (
        "finding_id string, finding_index bigint, stage string, severity string, status string, "
        "target_kind string, explanation string, prior_verdict string, corpus string, run_id string"
    ),
    # Every verdict given, by a hash of the explanation it was given on.
    "verdict_index": (
        "explanation_hash string, verdict string, created_at timestamp, decision_id string, corpus string, prefix string"
    ),
    # Findings on documents, stored before the answers they are about, so that a run that
    # broke off still reports them when it is started again.
    "document_findings": (
        "seen_in_run string, stage string, finding_key string, severity string, target_kind string, "
        "explanation string, corpus string"
    ),
    "decisions": (
        "decision_id string, finding_id string, finding_index bigint, kind string, verdict string, "
        "actor string, created_at timestamp, corpus string, run_id string"
    ),
    "runs": (
        "parent_run_id string, status string, started_at timestamp, ended_at timestamp, "
        "current_stage string, stage_detail string, corpus string, run_id string"
    ),
    "response_cache": (
        "cache_key string, stage string, model string, prompt_version string, "
        "response_text string, tokens_in int, tokens_out int, corpus string, prefix string"
    ),
    "stage_metrics": (
        "stage string, model string, skipped boolean, seconds double, tokens_in bigint, tokens_out bigint, "
        "cache_hits bigint, cache_misses bigint, corpus string, run_id string"
    ),
}
