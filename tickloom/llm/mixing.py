"""Mixing sources to target weights by hash-random order and exact budget cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import shuffle_width, table, word_count
from tickloom.llm.registry import query
from tickloom.session import cut_lineage

WEIGHTS = (5, 2, 1)


def source_targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """Word target of each source.

    ``totals``: one row per source with columns source and source_size. Sources in code-point order,
    null last, take ``weights`` in turn and share the sum of all sizes; no target goes above
    ``max_epochs`` times its source, and what is cut off goes to the others by weight. Sources sorted
    by size over weight reach their limit in that order, so running sums give the final level at
    once. The windows see one row per source, a list as long as the mixture's own recipe.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("_w", w.cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    below, upward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.select("source", "source_size", "_w", F.sum("source_size").over(every).alias("_total"),
                 F.coalesce(F.sum("source_size").over(below) * max_epochs, F.lit(0)).alias("_capped"),
                 F.sum("_w").over(upward).alias("_weights"), F.row_number().over(order).alias("_n"))
    t = t.withColumn("_full", F.col("source_size") * max_epochs * F.col("_weights") <= F.col("_w") * (F.col("_total") - F.col("_capped")))
    first_open = F.min(F.when(~F.col("_full"), F.struct("_n", "_total", "_capped", "_weights"))).over(every)
    t = t.withColumn("_open", first_open)
    share = (F.col("_w") * (F.col("_open._total") - F.col("_open._capped"))).cast("double") / F.col("_open._weights")
    capped = F.col("_open").isNull() | (F.col("_n") < F.col("_open._n"))
    return t.select("source", "source_size", F.when(capped, (F.col("source_size") * max_epochs).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3, seed: int = 0, id_col: str = "doc_id", source_col: str = "source",
        text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """How many words of every document the mix takes.

    Each row gets a hash key of (seed, id). A source is sorted by that key in ``ranges`` equal key
    ranges: totals per range give offsets by a running sum per source, a window inside one range
    gives the rest, so a source with a third of all rows is spread like the others. The budget
    floor(target) takes whole epochs and then the front of the sorted source, cut at the exact word.

    Returns doc_id, text_hash, source, size, source_size, target, taken, epochs (whole copies) and tail_words
    (words of one more, partial copy; 0 or size away from the cut). Null text or no words: size 0 and
    taken 0. A null source is a source of its own. Null or repeated ids: the rows tie on the key and
    are ordered by size; each row is counted. Empty table: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    ranges = ranges or max(1024, 4 * shuffle_width(spark))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), word_count(F.col(text_col)).alias("size"), key.alias("_key"))
    place = F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * ranges, 32)
    rows = cut_lineage(rows.select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_src"), place.alias("_range")))

    blocks = rows.groupBy("_src", "_range").agg(F.max("source").alias("source"), F.sum("size").alias("_block"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("_block").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_block").over(before), F.lit(0)))
    blocks = blocks.join(targets.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).drop("source", "_name", "_block")

    inside = Window.partitionBy("_src", "_range").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(blocks, ["_src", "_range"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs).withColumn("_rest", budget - F.col("epochs") * F.col("source_size"))
    tail = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_start") - F.col("_in"))).cast("long")
    rows = rows.withColumn("tail_words", tail)
    taken = F.col("epochs") * F.col("size") + F.col("tail_words")
    return rows.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.alias("taken"), "epochs", "tail_words")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = 3, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents of the mix, each row as often as the mix takes it; all columns are returned.

    Documents stay whole: the one at the cut of its source comes in whole, so a source passes its budget
    by less than one document. Equal rows are taken as one row as often as all of them together.
    """
    takes = mix(docs, weights, max_epochs, seed, id_col, source_col, text_col)
    copies = (F.col("epochs") + (F.col("tail_words") > 0).cast("long")).alias("n")
    takes = takes.select("doc_id", "text_hash", "source", copies).filter("n > 0").groupBy("doc_id", "text_hash", "source").agg(F.sum("n").alias("_copies"))
    takes = takes.select(F.col("doc_id").alias("_take_id"), F.col("text_hash").alias("_take_hash"), F.col("source").alias("_take_source"), "_copies")
    mark = "_hash_of_text"
    rows = docs.withColumn(mark, F.xxhash64(text_col)).dropDuplicates([id_col, mark, source_col])
    same = rows[id_col].eqNullSafe(F.col("_take_id")) & (rows[mark] == F.col("_take_hash")) & rows[source_col].eqNullSafe(F.col("_take_source"))
    rows = rows.join(takes, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return rows.select(docs.columns)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('0:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source ASC NULLS LAST) AS n, (sum(source_size) OVER ())::BIGINT AS total,
             coalesce(3 * sum(source_size) OVER (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
             (sum(w) OVER (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws FROM w),
f AS (SELECT min(n) AS n FROM o WHERE NOT 3 * source_size * ws <= w * (total - capped)),
t AS (SELECT o.source, o.source_size, CASE WHEN f.n IS NULL OR o.n < f.n THEN (3 * o.source_size)::DOUBLE
             ELSE (o.w * (p.total - p.capped))::DOUBLE / p.ws END AS target
      FROM o CROSS JOIN f LEFT JOIN o p ON p.n = f.n),
r AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken,
       epochs::BIGINT AS epochs, greatest(0, least(size, budget - epochs * source_size - start))::BIGINT AS tail_words
FROM e
"""


@query("op1_mix_sources", OP1_SQL)
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs", "tail_words")
