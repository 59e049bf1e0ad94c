"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. A stage sees only what the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.llm import bpe, line_dedup, minhash, mixing, toxicity
from harrier.llm.common import checkpoint, content_order, fold, read


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half; labels of the fold that op7 holds out teach nothing here either."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels").where(~F.coalesce(fold(5) == 0, F.lit(False))))
    scored = toxicity.score(docs.withColumnRenamed("score", "__own_score") if "score" in docs.columns else docs, model, [F.col(f"`{c}`") for c in ("__own_score" if c == "score" else c for c in docs.columns)])
    kept = scored.where("score < 0.5").drop("score")
    return kept.withColumnRenamed("__own_score", "score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document, or an earlier place of their own, holds to one edit.

    Documents of which only blank lines are left go, those that were blank before stay, and so do null and
    empty texts. Of rows equal in doc_id and text the first in order of the other columns keeps its lines; null
    ids come last. An empty table stays empty.
    """
    return line_dedup.deduplicated(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of texts alike to 0.8 on runs of five words.

    Of rows equal in id and text the first in order of the other columns stays. Rows without an id count after
    all others, those of one text as one document. Null and empty texts are alike to nothing.
    """
    no_id = F.col("doc_id").isNull()
    late = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()), F.lit(1 << 61))
    keyed = docs.withColumn("__key", F.coalesce("doc_id", late))
    found = minhash.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), size=5, percent=80)
    ids = found.where("kept").select(F.col("doc_id").alias("__id")).distinct()
    rows = keyed.join(ids, F.col("__key") == F.col("__id"), "left_semi")
    same = Window.partitionBy("__key", F.xxhash64("text")).orderBy(no_id, content_order(docs, "doc_id", "text"))
    return rows.withColumn("__n", F.row_number().over(same)).where("__n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources holds them, a row for each reading of a text; a null source is one of its own, the last.

    Null, empty and blank texts have no words and no row. Ties and copies fall in order of content, so reruns
    agree. An empty table stays empty.
    """
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: doc_id, n_tokens, and the SHA-256 of its ids and of the bytes they decode to."""
    return bpe.op2_bpe(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", without_repeated_lines),
    ("near-dedup", one_of_each_group),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: SQL cannot express the learned and the iterative stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else checkpoint(docs), sf_dir)
    return docs
