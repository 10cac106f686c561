"""The queries of the corpus operators, one for each, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, materialize, table

#: The policy of op1: verdict, host, path prefix.
POLICY = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


PII_KEY = "spark.weir.pii.key"


def pii_key(spark: SparkSession) -> str:
    """The key of the pseudonyms: the setting `spark.weir.pii.key`. Where it is unset, a random one is drawn and set for the session, so
    that nobody else can turn its pseudonyms back; applications whose pseudonyms are to agree have to set one."""
    if not spark.conf.get(PII_KEY, None):
        spark.conf.set(PII_KEY, token_hex(32))
    return spark.conf.get(PII_KEY)


#: op1: a family edge counts as this part of a link. Pages with links to their own host only are joined by nothing else.
FAMILY = 0.25


def op1_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every page, over links between hosts and, as a second kind of edge, between a host and its parent domain."""
    from .url_trust import judge

    return judge(table(spark, sf_dir, "pages"), POLICY, family=FAMILY)


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, and what was found, for each document."""
    from .pseudonyms import pseudonymize

    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii_key(spark))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), F.array_join(F.transform("pii", lambda x: x["kind"]), ",").alias("kinds"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict, train

    docs, held = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 3, 1)
    return predict(docs, train(docs.filter(~held)), carry={"held_out": held})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents, train

    docs, held = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").filter(~held).select("doc_id", F.col("toxic").alias("label"))
    return score_documents(docs, train(docs, labels), carry={"held_out": held})


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import measure_documents, score_documents, train

    held = held_out(F.col("doc_id"), 3, 1)
    measured = materialize(measure_documents(table(spark, sf_dir, "documents"), carry={"held_out": held}), "quality-statistics")
    labels = table(spark, sf_dir, "labels").filter(~held).select("doc_id", F.col("quality").alias("label"))
    return score_documents(measured, train(measured, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near matches of every document, beside what op8_decontamination (whose columns its SQL fixes) has."""
    from .decontamination import decontaminate

    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=16)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "n_near", F.array_join("near_items", ",").alias("near_items"), "contaminated")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import judge

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("kept_share", 6).alias("kept_share"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import mine

    return mine(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", label, F.col("embedding"))


def queries() -> dict:
    numbered = (op1_url_trust, op2_pseudonyms, op3_language_id, op4_toxicity, op5_token_counts, op6_quality, op7_near_duplicates, op8_decontamination, near_matches, op9_bpe_codec, op10_line_rules, op11_packing, op12_collocations, op13_hard_negatives)
    return {f.__name__: f for f in numbered}


def oracle_sql() -> dict:
    """The others rest on trained models, keyed permutations, BPE merges, online packing or iterated ranks, which SQL can't express."""
    from . import oracles

    return {"op7_near_duplicates": oracles.NEAR_DUPLICATES, "op8_decontamination": oracles.DECONTAMINATION, "near_matches": oracles.NEAR_MATCHES, "op10_line_rules": oracles.line_rules(), "op12_collocations": oracles.COLLOCATIONS, "op13_hard_negatives": oracles.HARD_NEGATIVES}
