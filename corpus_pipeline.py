"""A training corpus from raw documents: language, exact copies, near copies, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
back as the next stage's ``docs``; all but the last return the columns of ``documents``.

Defined results: documents without any letter (null and empty texts too) are rejected by
the first stage; a missing language is filled in by the prediction; rows that repeat id and
text count as copies; secrets are masked and n_chars follows the masked text; the last
stage returns one row for each piece of a sequence.  Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm import exact_dedup, langid, near_dedup, packing, secret_scan
from concordia.llm._common import materialize, table, work_tables

#: Dropped rows (16 bytes each) that are broadcast at most; more are shuffled.
BROADCAST_ROWS = 200_000


#: Columns of documents; others are carried along under names of their own, for they may be named like results.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns renamed by their places."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in COLUMNS else f"__own_{k}") for k, c in enumerate(docs.columns)])


def restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of what became of shielded(docs)."""
    return found.select(*[F.col(c if c in COLUMNS else f"__own_{k}").alias(c) for k, c in enumerate(docs.columns)])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones among them teach."""
    found = langid.identify(shielded(docs), langid.learn(docs)).filter(F.col("lang_pred") != langid.UNDETERMINED)
    return restored(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each group of equal texts."""
    found = exact_dedup.deduplicate(shielded(docs))
    single = found.filter(F.col("group_size") == 1)
    # a row can be there twice, id and text alike
    chosen = found.filter(F.col("kept") & (F.col("group_size") > 1)).dropDuplicates(["doc_id", "text_sha256"])
    return restored(single.unionByName(chosen), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    gone = near_dedup.near_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("text_fp").alias("__fp")).distinct()
    gone = materialize(gone, "near-copies")
    few = gone.count() <= BROADCAST_ROWS
    same = F.xxhash64("text").eqNullSafe(F.col("__fp")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of secrets masked."""
    found = secret_scan.scan(shielded(docs))
    found = found.withColumn("masked", secret_scan.redact(F.col("text"), F.col("spans")))
    changed = F.size("spans") > 0
    found = found.withColumn("n_chars", F.when(changed, F.length("masked").cast("long")).otherwise(F.col("n_chars")))
    return restored(found.withColumn("text", F.col("masked")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express suffix automata, sketches' verification or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; work tables of stages that are done with go."""
    docs = table(spark, sf_dir, "documents")
    with work_tables(spark) as keep:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
