"""One registered query per operator: it applies the operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from contactlift.llm import sql
from contactlift.llm.store import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), weights=[5, 2, 1], share=1.0, most=3)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The rules of the query, and the site names that its blocklist holds under each domain they use.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URL_BLOCKLIST = [f"{name}.example.{top}/" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
                 for top in ("com", "net", "org")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_BLOCKLIST)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.pii import digest_columns, personal_data

    return digest_columns(personal_data(table(spark, sf_dir, "documents")))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.wrapper import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.chains import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.periodic import planted, run_digests

    return run_digests(table(spark, sf_dir, "documents"), planted)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from contactlift.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from contactlift.llm.tokens import token_digests

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


_QUERIES = [op1_mix_sources, op2_decontamination, op3_url_filter, op4_license_scan, op5_personal_data,
            op6_main_text, op7_lm_scores, op8_quality_rules, op9_near_duplicates, op10_repeated_passages,
            op11_periodic_runs, op12_importance_resampling, op13_token_files]


def _query(fn: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    return run


QUERIES = {fn.__name__: _query(fn) for fn in _QUERIES}
ORACLE: dict[str, str] = {
    "op3_url_filter": sql.url_filter(URL_RULES, URL_BLOCKLIST),
    "op9_near_duplicates": sql.near_duplicates(),
    "op11_periodic_runs": sql.periodic_runs(),
    "op12_importance_resampling": sql.importance_resampling(),
}
