"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, jaccard, licenses, packing, pii, quality_rules, ranked_search, secrets, suffix_dedup, toxicity, warc_zip, whitening
from .common import documents, table


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, folder), k=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


def op2_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found_values(documents(spark, folder), pii.run_key(spark)).select("doc_id", "text", F.size("spans").cast("long").alias("n_replaced"), "spans")


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contamination(documents(spark, folder), table(spark, folder, "benchmark"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit_pack(documents(spark, folder))


def op4_toxicity_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.score(docs, toxicity.train(*toxicity.labelled_sample(docs, table(spark, folder, "labels"))))


def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, folder)).drop("kept")


def op6_warc_zip(spark: SparkSession, folder: str) -> DataFrame:
    return warc_zip.round_trip(spark, table(spark, folder, "pages")).drop("payload", "url")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    rules = quality_rules.learn_rules(quality_rules.labelled_sample(docs, table(spark, folder, "labels")))
    return quality_rules.judge(docs, rules)


def op7_html_tree_model(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_extract.extract(pages, html_extract.train(html_extract.training_pages(pages)))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, folder)))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked_search(documents(spark, folder), table(spark, folder, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_digest(licenses.scan_licenses(documents(spark, folder)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_pii_pseudonyms": op2_pii_pseudonyms,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity_windows": op4_toxicity_windows,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_warc_zip": op6_warc_zip,
    "op7_html_tree_model": op7_html_tree_model,
    "op9_quality_rules": op9_quality_rules,
    "op8_secret_scan": op8_secret_scan,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_license_scan": op13_license_scan,
}

SQL: dict[str, str] = {
    "op6_warc_zip": """
        with p as (select page_id, encode(coalesce(html, '')) as body from pages),
        d as (select page_id, octet_length(body) as payload_bytes, sha1(body) as payload_digest from p),
        m as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as latest from d)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id < latest then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id < latest then latest end as refers_to
        from m""",
    "op11_ranked_search": r"""
        with words as (
            select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents where text is not null),
        d as (select row_number() over () as r, doc_id, len(w) as n, w from words where len(w) > 0),
        t as (select count(*)::bigint as total, sum(n)::bigint as l from d),
        q as (
            select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        p as (
            select r, doc_id, n, term, count(*)::bigint as tf from (select r, doc_id, n, unnest(w) as term from d)
            where term in (select term from q) group by all),
        w as (select term, floor(1000 * ln((2 * total + 2) / (2 * df + 1)))::bigint as w
            from (select term, count(*) as df from p group by term), t),
        i as (select r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total) // l))) as impact from p join w using (term), t),
        s as (select item_id, r, doc_id, sum(impact)::bigint as score from q join i using (term) group by all having sum(impact) > 0),
        o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s)
        select item_id, rank::int as rank, doc_id, score from o where rank <= 10""",
}
