"""The operators of this folder as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import conversation_sql, language_id, toxicity
from concordat.llm.common import held_out, joined_sha256, table, tokenizer_file
from concordat.llm.conversation_repair import damage, plan_repairs, repaired_turns
from concordat.llm.conversation_trie import rebuilt, trie, turns_of
from concordat.llm.decontamination import contamination
from concordat.llm.html_text import extract_main_text
from concordat.llm.near_dedup import near_duplicate_classes
from concordat.llm.packing import pack
from concordat.llm.substring_dedup import remove_repeats
from concordat.llm.token_counts import token_counts
from concordat.llm.topk import top_k
from concordat.llm.url_filter import judge_urls
from concordat.llm.warc import archive_pages
from concordat.session import settle

#: Verdict, then host and path of a rule.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase matches, in the columns of its SQL; op1_proximity has the proximity matches too."""
    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), near=None)
    return found.drop("n_near")


def op1_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op1_decontamination, with the number of proximity matches, which its SQL does not have."""
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5, 256)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(documents, labels, ~held_out(F.col("doc_id")))
    return toxicity.score_documents(documents, model).withColumn("held_out", held_out(F.col("doc_id")))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(documents, ~held_out(F.col("doc_id")))
    return language_id.identify(documents, model).withColumn("held_out", held_out(F.col("doc_id")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    plans = settle(plan_repairs(rows), "repairs")
    lines = repaired_turns(rows, plans).select(F.col("conv_id").alias("of"), F.concat("role", F.lit(":"), "text").alias("line"))
    hashed = joined_sha256(lines, ["of"], "line", "\n", "repaired_sha256")
    both = plans.join(hashed, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    turns, lengths = rebuilt(turns_of(conversations), 20, lambda conv_id: F.crc32(conv_id.cast("string")) % 4)
    return trie(turns, lengths)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op1_proximity": op1_proximity,
    "op2_topk": op2_topk,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_html_text": op6_html_text,
    "op7_url_filter": op7_url_filter,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_warc": op13_warc,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH docs AS (SELECT doc_id, {_FOLDED_WORDS} AS words FROM documents),
        items AS (SELECT item_id, words, least(len(words), 10) AS n FROM (SELECT item_id, {_FOLDED_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(words[s : s + n - 1], ' ') AS phrase
                    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS s FROM items)),
        places AS (SELECT doc_id, n, s, array_to_string(words[s : s + n - 1], ' ') AS phrase
                   FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM items) WHERE len(words) >= n)),
        found AS (SELECT doc_id, item_id, n, s FROM places JOIN windows USING (n, phrase)),
        hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id),
        listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                   FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op2_topk": """
        WITH whole AS (
            SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op3_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (SELECT doc_id, s, array_to_string(words[s : s + 12], ' ') AS phrase
                    FROM (SELECT *, unnest(range(1, len(words) - 11)) AS s FROM docs WHERE len(words) >= 13)),
        firsts AS (SELECT phrase, min(doc_id) AS first_id FROM windows GROUP BY phrase),
        gone AS (SELECT DISTINCT doc_id, place FROM (
                     SELECT doc_id, unnest(range(s, s + 13)) AS place FROM windows JOIN firsts USING (phrase) WHERE first_id < doc_id)),
        placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text FROM placed ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id),
        removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM docs LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_conversation_repair": conversation_sql.REPAIR,
    "op12_conversation_trie": conversation_sql.TRIE,
    "op13_warc": """
        WITH whole AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        named AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last_id FROM whole)
        SELECT page_id, payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id <> last_id OR (page_id IS NULL AND last_id IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> last_id OR (page_id IS NULL AND last_id IS NOT NULL) THEN last_id END AS refers_to
        FROM named""",
}
