"""The registered queries of the operators over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.llm import collocations, filter_audit, html_extract, jaccard_join, kneser_ney, mixing, neighbours, preference_format, quality_rules, sentence_pieces, sql, substring_dedup, token_files, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's prompt and completions, the masks as start-end lists."""
    def spans(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda x: F.concat_ws("-", x["start"], x["end"])), ",")

    pairs = preference_format.format_pairs(*preference_format.pairs_of_table(_table(spark, sf_dir, "conversations")))
    return pairs.select(F.col("pair").alias("conv_id"), F.col("n_common").cast("long"), "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", spans("rejected_mask").alias("rejected_mask"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search_table(_table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the sentences that repeat earlier documents, and the words removed."""
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"), count="removed_words")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(_table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' places, numbers and sums of ids, read from files written for the purpose."""
    import public_tokenizers

    written = token_files.write_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digests(spark, written)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_preference_format": op2_preference_format,
    "op3_neighbours": op3_neighbours,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_html_extract": op5_html_extract,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filter": op7_url_filter,
    "op8_mixing": op8_mixing,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_token_files": op11_token_files,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = sql.ORACLES
