"""Runs of words that repeat with a period, found by block convolution, and texts with the repeats taken out."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, table
from tickloom.llm.ntt import LARGEST, PRIMES, squared_differences
from tickloom.llm.registry import query

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text whose words are looked at together, and transform elements in work at a time.
GROUP_BYTES, ELEMENTS = 1 << 21, 1 << 18
FAR = np.int64(1) << 60


def next_distances(ids: np.ndarray) -> np.ndarray:
    """Distance from each word to its next occurrence; FAR if there is none."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.full(len(ids), FAR)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def first_zeros(ids: np.ndarray, blocks: np.ndarray, base: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Least distance at which each block occurs again, from size / 2 + 1 (from 1 for blocks of two) to size; 0 if at none.

    The block of ``size`` words is slid over the window that follows it, and a distance counts when
    its sum of squared differences is zero. The sums are exact: they are below
    size x (words of the document)^2, and are taken modulo as many primes as the product needs.
    ``base``, ``words``: id of the first word of the block's document and its number of words.
    """
    lo = size // 2 + 1 if size > 2 else 1
    out = np.zeros(len(blocks), np.int64)
    step = max(1, ELEMENTS // (2 * size))
    for at in range(0, len(blocks), step):
        s, origin, n = blocks[at:at + step], base[at:at + step, None], words[at:at + step, None]
        spots = s[:, None] + np.arange(lo, 2 * size)
        inside = spots < origin + n
        window = np.where(inside, ids[np.minimum(spots, len(ids) - 1)] - origin, n)  # n is the id of no word
        block = ids[s[:, None] + np.arange(size)] - origin
        rows, bound, modulus = np.arange(len(s)), size * int(n.max()) ** 2, 1
        zero = np.ones((len(s), size - lo + 1), bool)
        for prime, root, _ in PRIMES:
            zero[rows] &= squared_differences(block[rows], window[rows], prime, root) == 0
            rows, modulus = rows[zero[rows].any(1)], modulus * prime
            if modulus > bound or not len(rows):
                break
        else:
            raise ValueError("a text has too many words for exact sums")
        found = zero.any(1)
        out[at:at + step][found] = lo + zero[found].argmax(1)
    return out


def _stretch(ids: np.ndarray, at: np.ndarray, period: np.ndarray, way: int, step: int) -> np.ndarray:
    """How many words a region goes on with its period: to the left of ``at`` (way -1) or from ``at`` to the right (way 1)."""
    length, todo = np.zeros(len(at), np.int64), np.arange(len(at))
    ahead = np.arange(step)
    while len(todo):
        spot = (at[todo] + way * length[todo])[:, None] + (ahead if way > 0 else -1 - ahead)
        other = spot - way * period[todo, None]
        fits = (spot >= 0) & (spot < len(ids)) & (other >= 0) & (other < len(ids))
        same = fits & (ids[np.clip(spot, 0, len(ids) - 1)] == ids[np.clip(other, 0, len(ids) - 1)])
        whole = same.all(1)
        length[todo] += np.where(whole, step, (~same).argmax(1))
        todo = todo[whole]
    return length


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``ids``), length and period of every run, sorted by start, then period.

    ``ids`` are the words of documents that lie one after the other, ``sizes`` their lengths; a word's id
    is the place of its first occurrence in the document. For each scale B = 2, 4, 8 ... blocks of B words
    begin every B / 2 words. A run of smallest period q, B / 2 < q <= B, has four periods and so holds
    such a block together with the q words after it. There the least distance at which the block
    occurs again is q: with a lesser one q would not be the smallest period. The distance is a seed and
    is stretched to both sides. A block of which some word comes again only beyond B has no occurrence,
    and a block deep inside a known run has no new one; neither is transformed.
    """
    ends = np.cumsum(sizes)
    runs = np.zeros((0, 3), np.int64)  # start, end, period
    reach, size = next_distances(ids), 2
    while size < 2 * max(1, int(sizes.max(initial=0)) // LEAST_PERIODS) or size == 2:
        if 2 * size > LARGEST:
            raise ValueError("a text has too many words for its longest periods")
        half = size // 2
        blocks = np.flatnonzero(np.maximum(reach[1:], reach[:-1]) <= size) * half
        known, upto, period = _covered(runs)
        if len(runs):
            spot = np.searchsorted(known, blocks, "right") - 1
            blocks = blocks[(spot < 0) | (upto[spot] < blocks + 2 * size)]
        doc = np.searchsorted(ends, blocks, "right")
        zero = first_zeros(ids, blocks, ends[doc] - sizes[doc], sizes[doc], size)
        s, d = blocks[zero > 0], zero[zero > 0]
        if len(runs) and len(s):  # a multiple of a known run's period
            spot = np.searchsorted(known, s, "right") - 1
            s, d = (x[(spot < 0) | (upto[spot] < s + size + d) | (d % period[spot] > 0)] for x in (s, d))
        if len(s):
            begins = np.concatenate([[True], (s[1:] != s[:-1] + half) | (d[1:] != d[:-1])])
            first, last = np.flatnonzero(begins), np.append(np.flatnonzero(begins)[1:], len(s)) - 1
            left, right, d = s[first], s[last] + size + d[last], d[first]
            step = max(8, min(half, 256))
            left, right = left - _stretch(ids, left, d, -1, step), right + _stretch(ids, right, d, 1, step)
            long = right - left >= np.maximum(LEAST_WORDS, LEAST_PERIODS * d)
            new = np.stack([left[long], right[long], d[long]], 1)
            runs = np.concatenate([runs, new])
            order = np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))
            runs = runs[order]
            runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(1)])] if len(runs) else runs
        even = len(reach) // 2 * 2
        reach, size = np.maximum(reach[0:even:2], reach[1:even:2]), size * 2
    order = np.lexsort((runs[:, 2], runs[:, 0]))
    start, end, period = runs[order].T
    return start, end - start, period


def _covered(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in order; the furthest end of the runs up to each, and the period of the run that has it."""
    order = np.argsort(runs[:, 0], kind="stable")
    start, end, period = runs[order].T
    upto = np.maximum.accumulate(end)
    holder = np.maximum.accumulate(np.where(end == upto, np.arange(len(end)), 0))
    return start, upto, period[holder]


def grouped(texts: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Texts in turn, about ``most`` bytes at a time; a longer text comes alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def word_ids(words: list[bytes]) -> np.ndarray:
    """Place of the first occurrence of each word."""
    known: dict[bytes, int] = {}
    return np.fromiter(map(known.setdefault, words, range(len(words))), np.int64, len(words))


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period) and collapsed text of every whole text.

    A run is a stretch of words with smallest period q and at least max(6, 4 q) words that neither
    neighbour extends. The collapsed text drops the words of a run after its first q and joins the others
    by one space. Null, empty and blank texts: no runs, empty collapsed text. Runs may overlap and
    lie inside each other. A document is worked on alone, so its rows are the same in any partitioning; equal and null ids
    and repeated rows give a row each. Time is about linear in the words (log^2 in the longest repeat); memory follows the
    longest text. Empty table: no rows. Other columns are not read.
    """
    ddl = f"doc_id {dict(docs.select(F.col(id_col).alias('i')).dtypes)['i']}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for texts in grouped((t.as_py() for t in b.column(1)), GROUP_BYTES):
                words = [t.split() for t in texts]  # bytes split at space and at the five controls from tab on
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                origin = np.cumsum(sizes) - sizes
                ids = np.concatenate([word_ids(w) + o for w, o in zip(words, origin.tolist())])
                start, length, period = find_runs(ids, sizes)
                stays = np.zeros(len(ids) + 1, np.int64)
                np.add.at(stays, start + period, 1)
                np.add.at(stays, start + length, -1)
                stays = np.cumsum(stays)[:-1] == 0
                cuts = np.searchsorted(start, np.append(origin, len(ids)))  # runs of each document
                for i in np.flatnonzero(np.diff(cuts)).tolist():
                    words[i] = [w for w, ok in zip(words[i], stays[origin[i]:origin[i] + sizes[i]].tolist()) if ok]
                local = start - np.repeat(origin, np.diff(cuts))
                items = pa.StructArray.from_arrays([pa.array(x) for x in (local, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), items)
                text = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
                yield pa.record_batch([b.column(0).slice(done, len(texts)), pa.array(sizes), lists, text], names=["doc_id", "n_words", "runs", "collapsed"])
                done += len(texts)

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).mapInArrow(run, ddl)


def summary(rows: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length (then smallest start and period) and checksums of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                       F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which every tenth by checksum of the id has its words repeated from some place on, as the query prescribes.

    With h = crc32(id), g = h // 10: where h is divisible by 10 and there are n > 0 words, the p = 1 + (n - a) // (3 + g % 8)
    words from a = g % n on take turns until the end. Null ids and texts stay.
    """
    h: Column = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.expr("cast(null as long)").alias("g"))
    rows = rows.withColumn("g", F.when(h % 10 == 0, (h - h % 10) / 10).cast("long"))
    rows = rows.withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.expr("case when n > 0 then cast(g % n as int) end"))
    rows = rows.withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) as int)"))
    turns = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a + p - 1) div p as int))), 1, n - a)")
    made = F.array_join(F.concat(F.expr("slice(words, 1, a)"), turns), " ")
    return rows.select("doc_id", F.when(F.col("p").isNotNull(), made).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(collapse(with_planted_repeats(table(spark, sf_dir, "documents"))))
