"""The registered query of each operator: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinflow.llm import alignment, backoff, bpe, egojoin, html, kdtree, paragraphs, quality, secrets, simhash, spelling, sstable, tiling
from basinflow.llm.common import new_folder, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


def op4_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kdtree.assign(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, split_pattern()), path))


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sstable.write(table(spark, sf_dir, "documents"), new_folder(spark, "ids"), tokenizer_file("byte_bpe_50k.json"), split_pattern())
    return sstable.read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.all_repeats(table(spark, sf_dir, "documents"), every=False)


def op11_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (tokenizer_file("byte_bpe_50k.json"), split_pattern(), tokenizer_file("piece_bpe_32k.model"))
    return alignment.scored(alignment.align_counted(table(spark, sf_dir, "documents"), *paths))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


QUERIES = {"op1_html": op1_html, "op2_sorted_tables": op2_sorted_tables, "op3_weak_labels": op3_weak_labels, "op4_kdtree": op4_kdtree, "op5_byte_bpe": op5_byte_bpe, "op6_simhash": op6_simhash, "op7_secrets": op7_secrets, "op8_embeddings": op8_embeddings, "op9_tiling": op9_tiling, "op10_paragraphs": op10_paragraphs, "op11_backoff": op11_backoff, "op12_alignment": op12_alignment, "op13_spelling": op13_spelling}
#: The others cannot be written in SQL (trees, tokenizers, fingerprints, expectation maximisation,
#: tilings) or only as a join of all pairs of paragraphs; tests hold them against brute force.
SQL: dict[str, str] = {
    "op8_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept FROM v JOIN reach ON reach.a = vec_id GROUP BY vec_id""",
}
