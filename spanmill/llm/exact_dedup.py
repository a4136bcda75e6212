"""Exact deduplication by skew-safe combining.

Three stages, each comparing whole normalised texts, never digests alone:

1. every task combines the equal texts it has read (map-side aggregation by digest *and* text): a text leaves a task once,
2. tasks are dealt over ``salts`` sub-groups, and a digest's local winners are merged within each sub-group, so a text
   that every task holds arrives in ``salts`` places with a share of the tasks' winners,
3. the winners of a digest's sub-groups, at most ``salts`` of a text, are combined, again by text.

Every digest goes this way, however many rows it has; nothing has to be known of the hot ones beforehand. Rows then find
their winner by digest. A digest that stands for two different texts (possible only with a broken or shortened digest)
is detected and its rows are matched by whole text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructType

from spanmill.session import cut

#: Sub-groups of a digest. With T tasks a sub-group merges at most T / SALTS winners of a text, the last stage SALTS.
SALTS = 64


def normalise(text: Column) -> Column:
    r"""Each run of [\x20\x09-\x0D] becomes one space; null counts as empty. Single spaces need no replacing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256_hex(norm: Column) -> Column:
    return F.sha2(norm, 256)


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and equal to each other. Texts of any length are compared whole. Rows without an id never
    win over rows with one (keep_id is null only if the whole group has none). Ties: rows that repeat an id and its text
    all count in group_size and share one verdict. Other columns are not read, whatever their names. No rows give no rows.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("_norm")).withColumn("_key", digest(F.col("_norm")))
    ids = cut(keyed.select("doc_id", "_key", *([] if digest is sha256_hex else [sha256_hex(F.col("_norm")).alias("_sha")])))
    # The salt is that of the task, so the partial aggregate before the shuffle leaves one row of a text in each task.
    salted = keyed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    merged = salted.groupBy("_key", "_salt", "_norm").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    winners = cut(merged.groupBy("_key", "_norm").agg(F.min("_first").alias("keep_id"), F.sum("_rows").alias("group_size")).select("_key", "keep_id", "group_size"))
    ambiguous = winners.groupBy("_key").count().where("count > 1").select("_key")
    plain = ids
    if not ambiguous.isEmpty():  # by whole text for these
        rows = keyed.join(ambiguous, "_key", "left_semi")
        groups = rows.groupBy("_key", "_norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        by_text = rows.join(groups, ["_key", "_norm"]).select("doc_id", "keep_id", "group_size", sha256_hex(F.col("_norm")).alias("_sha"))
        plain, winners = ids.join(ambiguous, "_key", "left_anti"), winners.join(ambiguous, "_key", "left_anti")
    sha = F.col("_key") if digest is sha256_hex else F.col("_sha")
    found = plain.join(winners, "_key").select("doc_id", "keep_id", "group_size", sha.alias("_sha"))
    if plain is not ids:
        found = found.unionByName(by_text)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that of the smallest id; columns as in docs.

    The verdict is on the row, by id and digest of the text, so other rows of a dropped row's id stay, and so do rows
    without an id. Null texts count as empty, of which one row stays; texts of any length are read whole. Ties: of rows
    that repeat id and text, the smallest by text and the other columns that can be ordered stays. Extra columns are kept,
    whatever their names. No rows give no rows.
    """
    verdicts = cut(dedup_exact(docs, id_col, text_col))
    held = set_aside(docs)
    keyed = held.withColumns({"_row_id": F.col(f"_k_{id_col}"), "_row_sha": sha256_hex(normalise(F.col(f"_k_{text_col}")))})
    named = lambda v: v.select(F.col("doc_id").alias("_row_id"), F.col("text_sha256").alias("_row_sha"))
    dropped = named(verdicts.where(~F.col("kept")))
    again = cut(named(verdicts.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")))
    kept = one_row_each(keyed.join(dropped, _same_row(keyed, dropped), "left_anti"), again, ["_row_id", "_row_sha"], held.schema, f"_k_{text_col}")
    return brought_back(kept, docs)


def set_aside(docs: DataFrame) -> DataFrame:
    """docs with its columns under names that an operator's own cannot clash with."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_k_{c}") for c in docs.columns])


def brought_back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`_k_{c}`").alias(c) for c in docs.columns])


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["_row_id"].eqNullSafe(right["_row_id"]) & (left["_row_sha"] == right["_row_sha"])


def one_row_each(rows: DataFrame, again: DataFrame, keys: list[str], schema: StructType, text_col: str) -> DataFrame:
    """rows, in the columns of schema, with one row for each of again's keys: the smallest by text and the other columns that can
    be ordered. Combined before the shuffle, so a key of very many rows takes a row from each task."""
    names = schema.names
    if again.isEmpty():
        return rows.select(*names)
    same = None
    for k in keys:
        one = rows[k].eqNullSafe(again[k])
        same = one if same is None else same & one
    order = [text_col, *[f.name for f in schema if isinstance(f.dataType, AtomicType) and f.name != text_col]]
    one = rows.join(again, same, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_one"))
    return rows.join(again, same, "left_anti").select(*names).unionByName(one.select("_one.*"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
