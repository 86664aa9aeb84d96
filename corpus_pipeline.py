"""A training corpus from raw documents: toxic ones out, near copies out, repeated passages
out, sources mixed to weights, and the rest packed into sequences.

STAGES lists the stages in order.  Each function takes (spark, docs, sf_dir) and returns a
DataFrame, which run() writes as Parquet and rereads as the next one's docs; all but the
last return the columns of documents, further ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import jaccard, mixing, packing, phrase_dedup, toxicity
from papyra.llm.common import Stash, fresh, table


def _apart(docs: DataFrame, own: tuple[str, ...]):
    """docs with its columns of an operator's own names renamed, and what puts a frame's columns back as they were."""
    names = {c: fresh(docs, c) for c in docs.columns if c.lower() in own}
    return docs.withColumnsRenamed(names), lambda out: out.select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go; the model learns from the labelled documents.

    A null or empty text is scored as one without toxic words.  Rows that repeat a doc_id, or
    have none, are scored each by their own text; an empty table stays one.
    """
    model = toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows, back = _apart(docs, ("score", "toxic_spans"))
    return back(toxicity.scored(rows, model).where(F.col("score") < toxicity.THRESHOLD))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8, the one with the smallest doc_id stays.

    Rows that repeat a doc_id are told apart by their texts; of equal ones, and of linked
    ones with one doc_id, one stays.  Documents without words are linked with nothing,
    those without doc_id all stay.
    """
    return jaccard.firsts(docs, words=5, num=80, den=100)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words or more that stand earlier in the corpus are cut out; texts left empty go.

    Null texts and texts without words stay as they are.  Rows that repeat a doc_id do not
    take from each other; rows without doc_id stay whole.
    """
    rows, back = _apart(docs, ("n_words", "n_removed", "kept_sha256"))
    out = phrase_dedup.deduplicated(rows).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(out)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document that the mix takes twice is two rows.

    A null source is one; a null text has no words.  Rows equal in doc_id and text are taken
    together, others each for itself.
    """
    return mixing.mixed_documents(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, every window in the corpus's mixture.

    A null or empty text is its end id; rows that repeat a doc_id, or have none, are packed each.
    """
    return packing.packed(docs, packing.tokenizer_path(), with_ids=False)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages are a trained model, iterated components and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash = Stash(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash.put(stage(spark, docs, sf_dir), name)
        stash.release()
    return docs
