"""Quality rules from tokeniser fertility: characters per token, byte fallback and token entropy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import table
from tickloom.llm.registry import query
from tickloom.llm.wordtable import WordTable, by_size, segment_sums
from tickloom.session import cut_lineage

VOCABULARY = "piece_bpe_32k.model"

# First and last code points of the main blocks of each script.
SCRIPT_BLOCKS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
SCRIPTS = ["none", *SCRIPT_BLOCKS]

#: Metrics with the step of the grid on which quartiles are taken and the least width of a quartile range.
METRICS = {"chars_per_token": (1 / 32, 0.25), "byte_share": (1 / 256, 0.02), "token_entropy": (1 / 32, 0.25)}
#: Source of the bands from all documents; no group is named so.
ALL = "*"
#: Quartile ranges from the quartile to the limit, below and above. Of 7,783 plain documents of sf0.1 (base rules
#: passed; no symbols, digits, capitals throughout) the farthest lies 1.54 below in characters per token and 2.22
#: above in entropy; random letters lie 1.64 to 2.37 and base64-like text about 3 below.
REACH = {"chars_per_token": (1.6, 4.0), "byte_share": (4.0, 4.0), "token_entropy": (4.0, 2.5)}
SIGNALS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
           "chars_per_token double, byte_share double, token_entropy double, script string")


@lru_cache(maxsize=1)
def _script_of() -> np.ndarray:
    out = np.zeros(0x30000, np.uint8)
    for k, blocks in enumerate(SCRIPT_BLOCKS.values(), 1):
        for a, b in blocks:
            out[a:b + 1] = k
    return out


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[WordTable, np.ndarray]:
    """Table of words, and which ids are single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = WordTable(lambda words: sp.encode([w.decode() for w in words], num_threads=1))
    return table, np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


def repeated_words(slots: np.ndarray, n_words: np.ndarray, width: int = 8) -> np.ndarray:
    """Per text: words inside ``width``-word windows that the text has more than once. Texts lie one after the other in ``slots``."""
    ends = np.cumsum(n_words)
    n_windows = np.maximum(n_words - width + 1, 0)
    if not n_windows.sum():
        return np.zeros(len(n_words), np.int64)
    text = np.repeat(np.arange(len(n_words)), n_windows)
    at = np.repeat(ends - n_words - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(len(text))
    with np.errstate(over="ignore"):
        mixed = (slots.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(width):
            key = (key ^ mixed[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    edge = np.zeros(int(ends[-1]) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + width, -1)
    return segment_sums((np.cumsum(edge)[:-1] > 0).astype(np.int64), n_words)


def _duplicate_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(texts: list[str], vocabulary: str) -> pd.DataFrame:
    """Signals of whole texts; null, empty and wordless texts have zeros and the script ``none``."""
    words_of, is_byte = _vocabulary(vocabulary)
    rows = []
    for run in by_size(texts):
        data = [t.encode("utf-8", "replace") for t in run]
        split = [d.split() for d in data]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        slots = words_of.slots([w for ws in split for w in ws])
        ids, per_word = words_of.ids(slots)
        n_tokens = segment_sums(per_word, n_words)
        word_chars, symbols, duplicates, script = [], [], [], []
        for t, d in zip(run, data):
            word_chars.append(len(t) - (len(d) - len(d.translate(None, b" \t\n\x0b\x0c\r"))))
            symbols.append(len(d) - len(d.translate(None, b"#*$%&|<>")))
            duplicates.append(_duplicate_lines(d))
            points = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
            seen = np.bincount(_script_of()[np.minimum(points, 0x2FFFF)], minlength=len(SCRIPTS))
            script.append(SCRIPTS[int(np.argmax(seen[1:])) + 1] if seen[1:].any() else "none")
        text = np.repeat(np.arange(len(run)), n_tokens)
        pair, count = np.unique(text * len(is_byte) + ids, return_counts=True)
        part = count / n_tokens[pair // len(is_byte)]
        entropy = np.bincount(pair // len(is_byte), -part * np.log2(part), minlength=len(run))
        some = np.maximum(n_tokens, 1)
        rows.append(pd.DataFrame({
            "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": duplicates, "n_repeat_words": repeated_words(slots, n_words),
            "n_tokens": n_tokens, "chars_per_token": np.array(word_chars) / some, "byte_share": segment_sums(is_byte[ids].astype(np.int64), n_tokens) / some,
            "token_entropy": np.abs(entropy), "script": script}))
    return pd.concat(rows, ignore_index=True)


def signals(text: str | Column, vocabulary: str | None = None) -> Column:
    """Struct of the signals of a text column."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf(SIGNALS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield measure(list(b), path) if len(b) else pd.DataFrame(columns=[x.split()[0] for x in SIGNALS.split(", ")])

    return run(F.col(text) if isinstance(text, str) else text)


def _sources(cells: DataFrame, min_docs: int) -> DataFrame:
    """(_group, _class, _source, _from): the cells whose documents give each cell its band.

    A cell with fewer than ``min_docs`` documents takes in the next length classes of its group on both
    sides, one more at a time; if the whole group has too few, the length classes of all documents (the
    source ``*``) in the same way, and all of them at last. There is a row for each pair of length
    classes of a group at most.
    """
    everything = cells.groupBy(F.col("_class").alias("_from")).agg(F.sum("docs").alias("docs"))
    inside = cells.select("_group", F.col("_class").alias("_from"), "docs")
    near = cells.select("_group", "_class").join(inside, "_group").withColumn("_source", F.col("_group"))
    near = near.unionByName(cells.select("_group", "_class").crossJoin(everything).withColumn("_source", F.lit(ALL)))
    near = near.withColumn("far", F.abs(F.col("_class") - F.col("_from"))).withColumn("all", F.col("_source") == ALL)
    near = near.withColumn("upto", F.sum("docs").over(Window.partitionBy("_group", "_class", "all").orderBy("far").rangeBetween(Window.unboundedPreceding, 0)))
    by, enough = Window.partitionBy("_group", "_class"), F.col("upto") >= min_docs
    near = near.withColumn("own", F.min(F.when(enough & ~F.col("all"), F.col("far"))).over(by)).withColumn("any", F.min(F.when(enough & F.col("all"), F.col("far"))).over(by))
    take = F.when(F.col("own").isNotNull(), ~F.col("all") & (F.col("far") <= F.col("own"))).otherwise(F.col("all") & (F.col("any").isNull() | (F.col("far") <= F.col("any"))))
    return near.filter(take).select("_group", "_class", "_source", "_from")


def fit_bands(measured: DataFrame, reach: dict[str, tuple[float, float]] = REACH, min_docs: int = 30) -> DataFrame:
    """Rejection bands by _group and _class: quartiles of each metric, widened by ``reach`` quartile ranges on each side.

    All measured documents count. Values are counted on a fixed grid first, so quartiles come from
    sums that merge in any order: the same bands in every run, and no group is gathered. Cells with
    fewer than ``min_docs`` documents say little about what is usual and get the band of the nearest
    coarser level (``_sources``), so every cell has a band.
    """
    group = ["_group", "_class"]
    step = F.element_at(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*[F.lit(s) for s, _ in METRICS.values()])), F.col("metric"))
    least = F.element_at(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*[F.lit(w) for _, w in METRICS.values()])), F.col("metric"))
    long = measured.select(*group, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.floor(F.col(m) / s).alias("bin")) for m, (s, _) in METRICS.items()])).alias("x"))
    bins = cut_lineage(long.groupBy(*group, "x.metric", "x.bin").agg(F.count("*").alias("n")))
    cells = bins.filter(F.col("metric") == next(iter(METRICS))).groupBy(*group).agg(F.sum("n").alias("docs"))
    counts = bins.select(F.col("_group").alias("_source"), F.col("_class").alias("_from"), "metric", "bin", "n")
    counts = counts.unionByName(counts.groupBy("_from", "metric", "bin").agg(F.sum("n").alias("n")).withColumn("_source", F.lit(ALL)))
    bins = _sources(cells, min_docs).join(counts, ["_source", "_from"]).groupBy(*group, "metric", "bin").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*group, "metric")
    bins = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("total", F.sum("n").over(by))
    quarter = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin"))) * F.max(step)
    bands = bins.groupBy(*group, "metric").agg(quarter(0.25).alias("q1"), quarter(0.75).alias("q3"), F.max(least).alias("least"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.col("least"))
    below, above = (F.element_at(F.map_from_arrays(F.array(*map(F.lit, METRICS)), F.array(*[F.lit(float(reach[m][k])) for m in METRICS])), F.col("metric")) for k in (0, 1))
    bands = bands.select(*group, "metric", (F.col("q1") - width * below).alias("low"), (F.col("q3") + width * above).alias("high"))
    return bands.groupBy(*group).agg(*[F.max(F.when(F.col("metric") == m, F.struct("low", "high"))).alias(f"band_{m}") for m in METRICS])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: str | None = None, vocabulary: str | None = None, reach: dict[str, tuple[float, float]] = REACH) -> DataFrame:
    """Signals and verdict of every document.

    Bands hold per script (or per value of the column ``group``) and per doubling of the token count,
    because entropy grows with length. base_failed: fewer than 20 words, or over 30 % of the words in
    repeated 8-word windows. kept: not base_failed and inside every band of its cell; cells with few
    documents take their bands from neighbouring lengths, the whole group or all documents.

    Returns doc_id, text_hash, the signals, base_failed, kept and reasons (metrics out of band). Null,
    empty and wordless texts: zeros, script none, base_failed. A null group value is a group. Repeated
    rows each get a row. Empty table: no rows. Other columns are not read.
    """
    label = F.lit(None).cast("string") if group is None else F.col(group).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), label.alias("_label"), signals(text_col, vocabulary).alias("s"))
    rows = rows.select("doc_id", "text_hash", "_label", "s.*")
    rows = rows.withColumn("_group", F.col("script") if group is None else F.coalesce(F.concat(F.lit("="), "_label"), F.lit(""))).drop("_label")
    rows = cut_lineage(rows.withColumn("_class", F.when(F.col("n_tokens") > 0, F.floor(F.log2("n_tokens"))).otherwise(F.lit(-1)).cast("int")))
    bands = fit_bands(rows.filter("n_tokens > 0"), reach)
    rows = rows.join(bands, ["_group", "_class"], "left")
    out = [F.when((F.col(m) < F.col(f"band_{m}.low")) | (F.col(m) > F.col(f"band_{m}.high")), F.lit(m)) for m in METRICS]
    rows = rows.withColumn("reasons", F.array_compact(F.array(*out)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
    return rows.select("doc_id", "text_hash", *[x.split()[0] for x in SIGNALS.split(", ")], "base_failed", "kept", "reasons")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all columns."""
    good = judge(docs, id_col, text_col, **options).filter("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_hash").alias("_keep_hash")).distinct()
    mark = "_hash_of_text"
    rows = docs.withColumn(mark, F.xxhash64(text_col))
    return rows.join(good, rows[id_col].eqNullSafe(F.col("_keep_id")) & (rows[mark] == F.col("_keep_hash")), "left_semi").drop(mark)


@query("op7_fertility_rules")
def op7_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("text_hash")
