"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosswind.llm import chat_format, edit_fingerprint, html_text, lang_mix, license_scan, mixing, near_dup, packing, quality_qda, rule_lists, token_align, turn_trie, url_cascade

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), near_dup.Settings(words=2, percent=80))


def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decide(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.with_groups(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_lists.apply(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_lang_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_mix.identify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.trie(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat_format.with_tricky(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat_format.read_back(chat_format.format_conversations(convs))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Exact links by all shared shingles, and components by reach: for small tables.
NEAR_DUP_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def queries() -> dict[str, Query]:
    every = (
        op1_packing, op2_html_text, op3_license_scan, op4_near_dup, op5_quality_qda, op6_mixing, op7_edit_fingerprint, op8_rule_list, op9_lang_mix, op10_url_filter,
        op11_turn_trie, op12_chat_format, op13_token_align,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dup": NEAR_DUP_SQL, "op10_url_filter": url_cascade.judge_sql(), "op11_turn_trie": turn_trie.TRIE_SQL, "op12_chat_format": chat_format.DIGEST_SQL}
