"""Merkle fingerprints of documents: paragraphs, sections, root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import id_ranges, shuffle_width, table
from tickloom.llm.registry import query


def paragraph_hashes(text: Column) -> Column:
    """array<array<string>>: a hash per paragraph (line) of every section (block between blank lines)."""
    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.sha2(F.concat(F.lit("p"), p), 256)))


def section_hashes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: F.sha2(F.concat(F.lit("s"), F.array_join(s, "")), 256))


def root_hash(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("d"), F.array_join(sections, "")), 256)


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Add {prefix}paragraphs, {prefix}sections and {prefix}root for the string column ``text`` (null: empty).

    Splitting loses nothing, so two texts have equal roots when they are equal and, up to SHA-256,
    only then.
    """
    df = df.withColumn(f"{prefix}paragraphs", paragraph_hashes(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(f"{prefix}sections", section_hashes(F.col(f"{prefix}paragraphs")))
    return df.withColumn(f"{prefix}root", root_hash(F.col(f"{prefix}sections")))


def likeness(a: str, b: str) -> Column:
    """Share of distinct tree nodes that the trees with prefixes ``a`` and ``b`` have in common: 1 for equal roots only."""
    na, nb = (F.array_distinct(F.concat(F.flatten(F.col(f"{x}paragraphs")), F.col(f"{x}sections"), F.array(F.col(f"{x}root")))) for x in (a, b))
    return (F.lit(2) * F.size(F.array_intersect(na, nb))).cast("double") / (F.size(na) + F.size(nb))


def located_edits(a: str, b: str) -> Column:
    """array<struct<section, paragraph>>: places (from 0) in tree ``b`` whose paragraph is not in tree ``a``; equal sections are passed over whole."""
    known = F.flatten(F.col(f"{a}paragraphs"))
    per_section = F.transform(F.col(f"{b}paragraphs"), lambda ps, i: F.when(
        F.array_contains(F.col(f"{a}sections"), F.element_at(F.col(f"{b}sections"), (i + 1).cast("int"))), F.array().cast("array<struct<section:int,paragraph:int>>")
    ).otherwise(F.filter(F.transform(ps, lambda p, j: F.when(~F.array_contains(known, p), F.struct(i.cast("int").alias("section"), j.cast("int").alias("paragraph")))), lambda x: x.isNotNull())))
    return F.flatten(per_section)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the following document in descending id order, after the last that of the first.

    One shuffle by id range (cuts from approximate quantiles, at most ``buckets``; they only balance the
    work). The first row of each range is also sent, as a tail, to the range that it follows, so the
    lookup never crosses a range. Null ids come last; equal ids are ordered by a hash of the text;
    null text counts as empty; a lone document follows itself.
    """
    spark = docs.sparkSession
    n = buckets or min(16384, 4 * shuffle_width(spark))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.xxhash64("text").alias("c"))
    # null ids come last in descending order: their range is below the lowest
    rows = rows.withColumn("_key", key).withColumn("_bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(id_ranges(docs, id_col, n)(F.col("doc_id"))))

    heads = rows.groupBy("_bucket").agg(F.max("_key").alias("_head"))
    up = Window.orderBy("_bucket")
    ends = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_head", F.coalesce(F.lead("_bucket").over(up), F.min("_bucket").over(ends)).alias("_follows"))
    # at most one head per range, n in all
    rows = rows.join(F.broadcast(heads), F.col("_key") == F.col("_head"), "left")
    here = F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("tail"))
    there = F.when(F.col("_follows").isNotNull(), F.struct(F.col("_follows").alias("at"), F.lit(True).alias("tail")))
    rows = rows.withColumn("_to", F.explode(F.array_compact(F.array(here, there)))).select("doc_id", "text", "_key", "_to.at", "_to.tail")
    order = Window.partitionBy("at").orderBy(F.col("tail"), F.col("_key").desc())
    return rows.withColumn("next_text", F.lead("text").over(order)).filter(~F.col("tail")).select("doc_id", "text", "next_text")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
e AS (SELECT *, left(text, (length(text) - length(text) // 2)::BIGINT) || left(nxt, (length(text) // 2)::BIGINT) AS edited FROM n),
p AS (SELECT *, list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda x: sha256('p' || x))) AS tp,
                list_transform(string_split(edited, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda x: sha256('p' || x))) AS ep,
                list_transform(string_split(nxt, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda x: sha256('p' || x))) AS np FROM e),
s AS (SELECT *, list_transform(tp, lambda x: sha256('s' || array_to_string(x, ''))) AS ts, list_transform(ep, lambda x: sha256('s' || array_to_string(x, ''))) AS es,
                list_transform(np, lambda x: sha256('s' || array_to_string(x, ''))) AS ns FROM p),
r AS (SELECT *, sha256('d' || array_to_string(ts, '')) AS tr, sha256('d' || array_to_string(es, '')) AS er, sha256('d' || array_to_string(ns, '')) AS nr FROM s),
x AS (SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, tr, er,
             list_distinct(flatten(tp) || ts || [tr]) AS t, list_distinct(flatten(ep) || es || [er]) AS e, list_distinct(flatten(np) || ns || [nr]) AS n FROM r)
SELECT doc_id, n_chars, edited_sha256, tr AS fingerprint, er AS edited_fingerprint,
       (2 * len(list_intersect(t, e)))::DOUBLE / (len(t) + len(e)) AS near_edited, (2 * len(list_intersect(t, n)))::DOUBLE / (len(t) + len(n)) AS near_next
FROM x
"""


@query("op5_merkle_fingerprints", OP5_SQL)
def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("_half", half)
    rows = rows.withColumn("_edited", F.concat(F.expr("substring(text, 1, int(n_chars) - _half)"), F.expr("substring(next_text, 1, _half)")))
    rows = with_tree(with_tree(with_tree(rows, "text", "_t_"), "_edited", "_e_"), "next_text", "_n_")
    return rows.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), F.col("_t_root").alias("fingerprint"), F.col("_e_root").alias("edited_fingerprint"),
                       likeness("_t_", "_e_").alias("near_edited"), likeness("_t_", "_n_").alias("near_next"))
