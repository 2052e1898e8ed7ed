"""Token ids in Huffman-coded files of independent blocks."""

from __future__ import annotations

import re
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import id_ranges, merged_arrays, remove_path, scratch_path, shuffle_width, table
from tickloom.llm.huffman import Codebook, code_lengths
from tickloom.llm.registry import query
from tickloom.llm.wordtable import WordTable, segment_sums

VOCABULARY, END_ID = "word_bpe_49k.json", 1
BLOCK_IDS, EVERY, SLICES = 1 << 16, 64, 8

BLOCKS = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])
CODED = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary()), ("checkpoints", pa.binary())])
READ = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    names = {"int32": "int", "int64": "long", "binary": "binary", "string": "string", "double": "double", "bool": "boolean", "float": "float"}
    return ", ".join(f"`{f.name}` " + (f"array<{names[str(f.type.value_type)]}>" if pa.types.is_list(f.type) else names[str(f.type)]) for f in schema)


#: What may close a word and is then split from it in one run; no apostrophe (it starts contractions), no angle bracket (special ids).
SIGNS = b'.,;:!?#*$%&)"'
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")  # ASCII and Latin-1 letters in UTF-8
_UNPRINTED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
#: The characters by which a byte-level vocabulary writes the bytes.
BYTE_NAMES = "".join(chr(256 + _UNPRINTED.index(c)) if c in _UNPRINTED else chr(c) for c in range(256))


@lru_cache(maxsize=2)
def _words(path: str) -> WordTable:
    """Words between ASCII white space; the vocabulary's own splitting also breaks there, so ids of words add up to ids of texts.

    A word of Latin-1 letters, with or without closing signs, goes straight to the library's merges,
    provided that trial words show the vocabulary to fold case, to part letters from signs and to write bytes.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    merge = tok.model.tokenize
    known: dict[bytes, list[int]] = {}
    signs: dict[bytes, list[int]] = {}

    def whole(words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(words), 1000):
            part = [w.decode() for w in words[i:i + 1000]]
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            starts = np.cumsum(sizes) - sizes
            e = tok.encode(" ".join(part), add_special_tokens=False)
            ids = e.ids
            owner = np.searchsorted(starts, np.fromiter((a for a, _ in e.offsets), np.int64, len(ids)), "right")
            ends = np.searchsorted(owner, np.arange(1, len(part) + 1), "right").tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def encode(words: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = []
        for cache, most in ((known, 200_000), (signs, 20_000)):
            if len(cache) > most:
                cache.clear()
        for word in words:
            core = word.rstrip(SIGNS)
            if core.isalpha():
                low = core.lower()
            elif LATIN.fullmatch(core):
                low = core.decode().lower().encode()
            else:
                out.append(None)
                continue
            ids = known.get(low)
            if ids is None:
                ids = known[low] = [t.id for t in merge(charmap_decode(low, "strict", BYTE_NAMES)[0])]
            if len(core) < len(word):
                close = word[len(core):]
                if close not in signs:
                    signs[close] = whole([close])[0]
                ids = ids + signs[close]
            out.append(ids)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, whole([words[i] for i in rest])):
            out[i] = ids
        return out

    trial = [b"Thing.", b"INGS,", b"zqXjw", b"a.", b"Of", b"untitled,", *"Él\"! Straße.,*** ÇÀÿ&&& Ñandú) Þórðr$%# œuvre?! naïve;:".encode().split(), *(b"at" + SIGNS[k:k + 1] for k in range(len(SIGNS)))]
    if encode(trial) != whole(trial):
        return WordTable(whole)
    return WordTable(encode, 550_000)


def tokenize(texts: list[str | None], vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, each closed by the end id, one text after the other; and how many each has."""
    words = _words(vocabulary)
    split = [(t or "").encode().split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    ids, per_word = words.ids(words.slots([w for ws in split for w in ws]))
    lengths = segment_sums(per_word, n_words)
    return np.insert(ids, np.cumsum(lengths), END_ID), lengths + 1


def _token_blocks(vocabulary: str, n_ids: int):
    """Rows sorted by (range, id) -> blocks of about BLOCK_IDS ids, none across ranges, and at the end rows of id counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_ids, np.int64)
        number: dict[int, int] = {}

        def closed(rng: int, docs: list, texts: list) -> pa.RecordBatch:
            ids, lengths = tokenize(texts, vocabulary)
            counts[:] += np.bincount(ids, minlength=n_ids)
            number[rng] = number.get(rng, -1) + 1
            kind = np.uint16 if n_ids <= 1 << 16 else np.uint32
            return pa.record_batch([[rng], [number[rng]], [docs], [lengths.tolist()], [ids.astype(kind).tobytes()]], schema=BLOCKS)

        docs, texts, size, at = [], [], 0, None
        for b in batches:
            for rng, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if docs and (rng != at or size + len(text or "") > 3 * BLOCK_IDS):  # about three characters make an id
                    yield closed(at, docs, texts)
                    docs, texts, size = [], [], 0
                at = rng
                docs.append(doc)
                texts.append(text)
                size += len(text or "")
        if docs:
            yield closed(at, docs, texts)
            for k, part in enumerate(np.array_split(counts, SLICES)):
                yield pa.record_batch([[-1], [k], [None], [None], [part.tobytes()]], schema=BLOCKS)

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 16) -> None:
    """Encode all texts and write them under ``path`` in ascending id order.

    ``path``/codebook: (id, bits), which fixes the canonical code. ``path``/blocks: Parquet rows that each
    hold a block of whole documents: their range and number in it, document ids, lengths, the coded
    payload and a bit offset for every 64th id. A block needs the codebook and nothing else, so blocks
    are read in any order and in parallel. Code lengths come from the counts of all ids; the driver sees
    one count per vocabulary entry.

    Null and empty texts hold the end id only. Null document ids come first; equal ones are ordered by a
    hash of the text. An empty table gives an empty codebook and no block. Other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    n_ids = Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True)
    n = shuffle_width(spark)
    ranges = min(16384, 4 * n)
    where = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(id_ranges(docs, id_col, ranges)(F.col(id_col).cast("long")) + 1)
    rows = docs.select(where.alias("range"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartition(n, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    raw = scratch_path(spark, "token-blocks")
    rows.mapInArrow(_token_blocks(vocabulary, n_ids), ddl(BLOCKS)).write.option("compression", "zstd").parquet(raw)

    blocks = spark.read.parquet(raw)
    sums = merged_arrays(blocks.filter("range = -1").select(F.col("block").cast("int").alias("slice"), F.col("ids").alias("data")), np.add, np.int64, SLICES)
    counts = np.concatenate([sums[k] for k in range(SLICES)]) if sums else np.zeros(n_ids, np.int64)
    lengths = code_lengths(counts, limit)
    kept = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in kept], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(lengths)
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.uint16 if n_ids <= 1 << 16 else np.uint32)
                payload, checkpoints = book.encode(ids, EVERY)
                yield pa.record_batch([[r["range"]], [r["block"]], [r["doc_ids"]], [r["lengths"]], [len(ids)], [payload], [checkpoints.astype("<i8").tobytes()]], schema=CODED)

    blocks.filter("range >= 0").mapInArrow(code, ddl(CODED)).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    remove_path(spark, raw)


def read_codebook(spark: SparkSession, path: str) -> Codebook:
    rows = spark.read.parquet(f"{path}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return Codebook(lengths)


def decode_blocks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of every document, read back from the files."""
    book = read_codebook(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = book.decode(r["payload"], np.frombuffer(r["checkpoints"], "<i8"), r["n_ids"], EVERY)
                ends = np.cumsum(r["lengths"])
                yield pa.record_batch([r["doc_ids"], np.split(ids, ends[:-1])], schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return spark.read.parquet(f"{path}/blocks").select("doc_ids", "lengths", "n_ids", "payload", "checkpoints").mapInArrow(run, "doc_id long, ids array<int>")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, all from the files."""
    book = read_codebook(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data = book.decode(r["payload"], np.frombuffer(r["checkpoints"], "<i8"), r["n_ids"], EVERY).astype("<u4").tobytes()
                lengths = np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                k = len(lengths)
                crc = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.record_batch([[r["range"]] * k, [r["block"]] * k, r["doc_ids"], ends - lengths, lengths, crc], schema=READ)

    files = spark.read.parquet(f"{path}/blocks")
    docs = files.mapInArrow(run, ddl(READ))
    sizes = files.select("range", "block", "n_ids")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_range_start"))
    inside = Window.partitionBy("range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("range", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("_block_start")).join(ranges, "range")
    docs = docs.join(sizes, ["range", "block"])
    return docs.select("doc_id", (F.col("_range_start") + F.col("_block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


@query("op9_huffman_token_files")
def op9_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return index_of(spark, path)
