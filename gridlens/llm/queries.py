"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlens.llm import alignment, bpe, embedding_dedup, html_extract, language_id, line_dedup, mixing, ngram_join, oracles, prefix_trie, quality_rules, secrets, sharding, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", language_id.held_out(F.col("doc_id")).alias("held_out")
    )
    languages, prototypes = language_id.train(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), languages, prototypes)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"), "n_random",
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages.select("page_id", "url", "html"), html_extract.train(pages))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.coded(docs, tokenizer_path(), digests=True)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_from_labels(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.apply_rules(docs, rules)
    return judged.select("doc_id", *quality_rules.BASE, "kept", "rule")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", *mixing.OUTPUTS)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
    )


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_by_ngrams(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path()).select("doc_id", *token_counts.OUTPUTS)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return aligned.documents.select("doc_id", *alignment.OUTPUTS)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secrets": op2_secrets,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_token_counts": op11_token_counts,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": oracles.EMBEDDING_DEDUP,
    "op9_line_dedup": oracles.LINE_DEDUP,
    "op10_ngram_join": oracles.NGRAM_JOIN,
    "op13_conversation_trie": prefix_trie.SQL,
}
