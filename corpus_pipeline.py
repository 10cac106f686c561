"""From raw documents to token ids: toxicity, near duplicates, benchmark contamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last
return the columns of documents, with further columns of docs carried along. A stage drops rows only by its own
decision: toxic documents, all but one of a group of near duplicates, contaminated documents.

Cases, for every stage: null and empty texts are not toxic, not duplicates and not contaminated, and stay (the last stage
gives them no ids); texts are read whole, however long; rows without a doc_id can be toxic, and otherwise stay; columns
beside doc_id and text may be named like an operator's outputs and stay as they are; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import bpe_codec, decontamination, near_duplicates, pseudonyms, toxicity
from weir.llm.queries import pii_key, vocabulary
from weir.llm.shared import held_out, materialize, sifted, table, without

#: Names of columns that a stage adds and takes off again.
SCORE, FOUND = "_weir_toxicity", "_weir_pii"


def _columns(rows: DataFrame, of: DataFrame) -> DataFrame:
    return rows.select(*(f"`{c}`" for c in of.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold of operator 4; each row is judged by its own text.

    Nulls, empty texts: kept, unless a model without any clean label calls all toxic. Repeated rows share one verdict.
    """
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.add_scores(docs, toxicity.train(docs, labels), score=SCORE)
    return _columns(scored.filter(F.col(SCORE) < toxicity.THRESHOLD), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of operator 7: the one with the least doc_id.

    Of rows that repeat that doc_id (equal or not: they are one document there), the one whose content has the least hash
    stays, so that runs agree. Texts without words are in no group: of such, too, one row of a doc_id stays.
    """
    judged = materialize(near_duplicates.deduplicate(docs), "duplicates")
    kept = without(docs, materialize(judged.filter(~F.col("kept")).select("doc_id").distinct(), "dropped"), ["doc_id"])
    repeated = materialize(judged.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return _columns(kept, docs)
    row = F.struct(*(f"`{c}`" for c in docs.columns))
    least = sifted(docs, repeated, ["doc_id"]).join(repeated.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.xxhash64("text"), F.to_json(row))).alias("_row"))
    return _columns(without(kept, repeated, ["doc_id"]), docs).unionByName(least.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 8 doesn't find contaminated by the benchmark. An empty benchmark drops none; repeated rows go together."""
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _columns(without(docs, materialize(judged.filter("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct(), "contaminated"), ["doc_id"]), docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with format-preserving pseudonyms in their texts (n_chars follows the new text); null texts stay null."""
    hidden = pseudonyms.pseudonymize(docs, key=pii_key(spark), findings=FOUND).drop(FOUND)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source (where there are such columns), n_tokens and the token ids of each document; none for null and empty texts."""
    carried = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    ids = bpe_codec.encode_documents(docs.select(*carried, "text"), vocabulary("word_bpe_49k.json"))
    return ids.select(*carried, F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("bpe", encode),
]

#: SQL can't express the stages (trained models, keyed permutations, BPE); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
