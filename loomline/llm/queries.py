"""The queries opN_<name> over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, html_extract, langid, mixing, near_dedup, oracles, sentencepiece_bpe, sharding, substring_dedup, topk, url_filter

#: The rules that op9's contract states.
URL_RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")


#: The tokenizer's file, by its name in the folder of public tokenizers.
TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_rows(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.parse_rule(x) for x in URL_RULES]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_sentencepiece, op4_near_dedup, op5_jump_shards, op6_html_text, op7_suffix_dedup, op8_exact_topk, op9_url_filter, op10_pareto_mix)}

#: SQL gives no language model, no merges of a tokenizer and no template; tests hold those queries against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": oracles.OP1,
    "op4_near_dedup": oracles.OP4,
    "op5_jump_shards": oracles.OP5,
    "op7_suffix_dedup": oracles.OP7,
    "op8_exact_topk": oracles.OP8,
    "op9_url_filter": oracles.op9(URL_RULES),
    "op10_pareto_mix": oracles.OP10,
}
