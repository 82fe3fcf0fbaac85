"""Exact deduplication by content sort, DataFrame operations only.

Normalised texts are range-partitioned by sampled splitters (leading characters, then a hash,
so that samples stay short) and sorted outside memory by these and the whole text; equal texts
become neighbours, and a sort aggregate compares neighbours in full. A text that
would outgrow a partition (found by a count of 64-bit hashes, which only balances load) skips
the range shuffle: its copies are first aggregated where they are read.

Defined results: a null text counts as empty; empty texts form one group; of equal texts the
longest original stays, then the smallest id; rows that repeat a document belong to its group
and count in its size; a null id stays only if no other row of its group is as long. No rows
in, no rows out. Columns other than the id and the text don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, id_and_text, named, partitions


#: Leading code points that splitters compare; beyond them a hash does, then the whole text.
HEAD = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def digest(norm: Column) -> Column:
    """Never null, so that a join on it needs no filter that normalises every text once more."""
    return F.coalesce(F.sha2(norm, 256), F.lit(""))


def frequent_hashes(docs: DataFrame, text: Column, parts: int) -> list[int]:
    """Hashes of normalised texts that hold over 1/(4 x parts) of all rows: at most 4 x parts."""
    counts = docs.groupBy(F.xxhash64(normalised(text)).alias("h")).agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(100), F.col("total") / (4 * parts))
    total = docs.agg(F.count("*").alias("total"))
    return [r.h for r in counts.join(F.broadcast(total)).where(F.col("n") > least).select("h").collect()]


def sorted_groups(docs: DataFrame, text_col: str, aggregates: list[Column]) -> DataFrame:
    """One row for each distinct normalised text: ``norm`` and the aggregates, which merge."""
    parts = partitions(docs.sparkSession)
    text = named(text_col)
    hot = frequent_hashes(docs, text, parts)
    is_hot = F.xxhash64(normalised(text)).isin(hot) if hot else F.lit(False)
    rest = docs.where(~is_hot) if hot else docs
    norm = normalised(text)
    splitters = [F.substring(norm, 1, HEAD), F.xxhash64(norm)]  # what the driver samples stays short
    ordered = rest.repartitionByRange(parts, *splitters).groupBy(splitters[0].alias("head"), splitters[1].alias("tail"), norm.alias("norm"))
    groups = ordered.agg(*aggregates).drop("head", "tail")
    if hot:
        groups = groups.unionByName(docs.where(is_hot).groupBy(normalised(text).alias("norm")).agg(*aggregates))
    return groups


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = id_and_text(docs, id_col, text_col)
    best = F.max(F.struct(F.char_length("text").alias("chars"), (-F.col("doc_id")).alias("minus_id"))).alias("best")
    groups = sorted_groups(rows, "text", [best, F.count("*").alias("group_size")]).select(
        digest(F.col("norm")).alias("text_sha256"), (-F.col("best.minus_id")).alias("keep_id"), "group_size"
    )
    members = rows.select("doc_id", digest(normalised(F.col("text"))).alias("text_sha256"))
    return members.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; each group's row rides through the sort."""
    order = F.struct(F.coalesce(F.char_length(named(text_col)), F.lit(0)), -named(id_col))
    whole = F.max_by(F.struct(*[named(c) for c in docs.columns]), order).alias("row")
    return sorted_groups(docs, text_col, [whole]).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
