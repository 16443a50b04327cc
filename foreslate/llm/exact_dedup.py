"""Exact dedup: group by a 128-bit content hash, compare bytes, keep the smallest id.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import documents, free_names, text_or_empty

#: A run of white space that is not already one plain space.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of blank, tab, or line-break characters becomes one space."""
    return F.regexp_replace(text, UNEVEN_SPACE, " ")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``__id, __norm, __hash`` of every row; other columns, of whatever name, stay out."""
    return (
        docs.select(F.col(id_col).alias("__id"), normalised(text_or_empty(text_col)).alias("__norm"))
        .withColumn("__hash", F.unhex(F.md5("__norm")))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by the md5 of the normalised text; the normalised text is
    itself the second grouping key, so different texts under one hash never
    merge.  The grouping is combined before its shuffle: a text that holds a
    third of all rows crosses it once per map task.  The verdicts go back to
    the rows by digest alone, without texts; a hot digest there is split by
    AQE's skew join.

    Null text counts as empty; empty texts form one group.  A repeated row (same
    id and text) is the same document: its copies share one verdict and count
    in ``group_size``.  A null id never is the smallest unless its whole group
    has none (then ``keep_id`` is null and its rows are kept).  No rows give no rows.
    """
    rows = keyed(docs, id_col, text_col)
    groups = (
        rows.groupBy("__hash", "__norm")
        .agg(F.min("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))
        .select("__hash", F.unhex(F.sha2("__norm", 256)).alias("__sha"), "__keep", "__size")
    )
    small = rows.select("__id", "__hash", F.unhex(F.sha2("__norm", 256)).alias("__sha"))
    return small.join(groups, ["__hash", "__sha"]).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns untouched; of repeated rows, one.

    A row is repeated when another has its id and its normalised text.  Columns may have any
    other names.
    """
    row_id, row_sha, kept_id, kept_sha = free_names(docs, "__row_id", "__row_sha", "__kept_id", "__kept_sha")
    kept = (
        keyed(docs, id_col, text_col).groupBy("__hash", "__norm").agg(F.min("__id").alias("__keep"))
        .select(F.col("__keep").alias(kept_id), F.unhex(F.sha2("__norm", 256)).alias(kept_sha))
    )
    sha = F.unhex(F.sha2(normalised(text_or_empty(text_col)), 256))
    same = F.col(row_id).eqNullSafe(F.col(kept_id)) & (F.col(row_sha) == F.col(kept_sha))
    return (
        docs.withColumns({row_id: F.col(id_col), row_sha: sha})
        .join(kept, same, "left_semi")
        .dropDuplicates([row_id, row_sha]).drop(row_id, row_sha)
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


QUERIES = {"op9_exact_dedup": op9_exact_dedup}

ORACLE_SQL = {"op9_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""}
