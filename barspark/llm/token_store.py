"""A store of token ids with one zstandard dictionary for all documents.

Format: a folder of Parquet files written by Spark's committer (any store that
Spark writes), one row per block of documents:

``part, block``      place of the block: blocks ascend by ``doc_id``
``dict_sha256``      hash of the dictionary that its frames need ("" for none)
``width``            bytes of an id, little-endian unsigned (2 or 4)
``doc_ids, n_tokens``  per document, in order
``offsets``          where each frame starts in ``frames``, and its end
``frames``           one zstandard frame per document, back to back

and a subfolder ``dictionary`` with the row ``sha256, body``. A single document
is read by its block's row and its own frame; no other frame is decompressed.
"""

from __future__ import annotations

import hashlib
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barspark.llm.common import Scratch, slices
from barspark.llm.tokens import broadcast_tokenizer, encoder, id_width, load_tokenizer

#: The dictionary is fitted on at most this many texts (those of least hash), of
#: a longer one on a window of that many characters at a hashed place. This
#: bounds what the driver gets and leaves out no text for its length.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 4096, 64 << 10
#: Bytes of one training sample; ids of a smaller corpus than LEAST_BYTES get no dictionary.
SAMPLE_BYTES, LEAST_BYTES = 1024, 4096
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4096
#: A block is about one row group, so that reading one row reads no other block.
ROW_GROUP_BYTES = 4 << 20
LEVEL = 3

_BLOCK = (
    "part long, block long, dict_sha256 string, width int, first_doc long, last_doc long, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, frames binary"
)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def train_dictionary(texts: DataFrame, tokenizer_text: str, width: int, end_id: int) -> bytes:
    """A dictionary of serialised id arrays; empty where the corpus has next to no ids.

    Texts of any length are drawn alike. Where the training finds nothing (say
    all rows are equal) the drawn ids themselves are the dictionary, and a
    warning says so.
    """
    # about twice the documents wanted pass the hash, so no task sends many more
    part = min(1.0, 2 * SAMPLE_DOCS / max(1, texts.count()))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1
    window = F.substring("text", at.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")
    drawn = texts.where((place <= int(part * (1 << 40))) & (F.col("text") != "")).select(window, place.alias("place"), "doc_id")
    few = drawn.orderBy("place", "doc_id").limit(SAMPLE_DOCS).select("text").collect()
    tokenizer = load_tokenizer(tokenizer_text)
    arrays = [
        np.array([*e.ids, end_id], dtype=f"<u{width}").tobytes()
        for e in tokenizer.encode_batch([r["text"] for r in few], add_special_tokens=False)
    ]
    samples = [a[i : i + SAMPLE_BYTES] for a in arrays for i in range(0, len(a), SAMPLE_BYTES)]
    held = sum(map(len, samples))
    if held < LEAST_BYTES:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, held // 4), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError as error:
        warnings.warn(f"no dictionary could be trained ({error}); the sample itself is the dictionary", stacklevel=2)
        return b"".join(dict.fromkeys(samples))[-DICTIONARY_BYTES:]


def _write(shared, body: bytes, width: int, end_id: int):
    sha = hashlib.sha256(body).hexdigest() if body else ""
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared)
        fitted = zstandard.ZstdCompressionDict(body) if body else None
        if fitted:
            fitted.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=fitted).compress
        part, block = TaskContext.get().partitionId(), 0
        ids: list = []
        n_tokens: list[int] = []
        offsets, frames = [0], []

        def flush() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = {
                "part": pa.array([part], pa.int64()),
                "block": pa.array([block], pa.int64()),
                "dict_sha256": pa.array([sha], pa.string()),
                "width": pa.array([width], pa.int32()),
                "first_doc": pa.array([min(known, default=None)], pa.int64()),
                "last_doc": pa.array([max(known, default=None)], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "n_tokens": pa.array([n_tokens], pa.list_(pa.int64())),
                "offsets": pa.array([offsets], pa.list_(pa.int64())),
                "frames": pa.array([b"".join(frames)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

        for batch in slices(batches, 4096):
            for doc, found in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                n_tokens.append(len(found) + 1)
                frames.append(pack(found.astype(f"<u{width}").tobytes() + end))
                offsets.append(offsets[-1] + len(frames[-1]))
                ids.append(doc)
                if offsets[-1] >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    block, ids, n_tokens, offsets, frames = block + 1, [], [], [0], []
        if ids:
            yield flush()

    return run


def write_token_store(
    docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1
) -> None:
    """Encode every whole text, append ``end_id``, and write the store to ``path``.

    Null texts count as empty (the end id alone); very long ones are encoded
    whole. Rows are written in ascending ``doc_id`` order (nulls first, repeated
    ids by a hash of the text, then the text) by one range exchange of the texts
    on id and hash, which also parts rows of one id; encoding and compression run
    after it, in the writing tasks. Other columns are not looked at. An empty
    table gives a store without blocks.
    """
    spark = docs.sparkSession
    shared = broadcast_tokenizer(spark, tokenizer_path)
    width = id_width(shared.value, end_id)
    texts = _texts(docs, id_col, text_col)
    body = train_dictionary(texts, shared.value, width, end_id)
    (
        texts.withColumn("h", F.xxhash64("text"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .drop("h")
        .mapInArrow(_write(shared, body, width, end_id), _BLOCK)
        .write.option("compression", "uncompressed")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(f"{path}/blocks")
    )
    spark.createDataFrame(
        [(hashlib.sha256(body).hexdigest() if body else "", bytearray(body))], "sha256 string, body binary"
    ).coalesce(1).write.parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["sha256"], bytes(row["body"])


def _unpacker(sha: str, body: bytes):
    if hashlib.sha256(body).hexdigest() != sha and body:
        raise ValueError("the dictionary does not match its hash")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body) if body else None)

    def unpack(row_sha: str, frame: bytes, width: int, n: int) -> bytes:
        if row_sha != sha:
            raise ValueError(f"a block needs dictionary {row_sha!r}; the store has {sha!r}")
        raw = d.decompress(frame)
        if len(raw) != n * width:
            raise ValueError("a frame does not hold as many ids as the index says")
        return np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()

    return unpack


def read_token_store(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    ``start`` counts the ids of all documents before. Its prefix sums are over
    blocks (per part, then per part's total), so no task sees all documents.
    ``with_ids`` adds the ids as little-endian unsigned 32-bit bytes.
    """
    sha, body = _dictionary(spark, path)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    schema = pa.schema(
        [("part", pa.int64()), ("block", pa.int64()), ("within", pa.int64()), ("doc_id", pa.int64())]
        + [("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        + ([("ids", pa.binary())] if with_ids else [])
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(sha, body)
        for batch in batches:
            for row in batch.to_pylist():
                view, at, out = memoryview(row["frames"]), 0, []
                for doc, n, a, b in zip(row["doc_ids"], row["n_tokens"], row["offsets"], row["offsets"][1:], strict=False):
                    raw = unpack(row["dict_sha256"], view[a:b], row["width"], n)
                    out.append((row["part"], row["block"], at, doc, n, zlib.crc32(raw), raw)[: len(schema)])
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema
                )

    kind = "part long, block long, within long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = blocks.mapInArrow(decode, kind)
    sizes = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_start"))
    before = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("block_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(parts, "part")
        .select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    )
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def fetch_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """Ids of a few documents: one job, which reads their blocks' rows and sends their frames alone."""
    sha, body = _dictionary(spark, path)
    unpack, out = _unpacker(sha, body), {doc: [] for doc in doc_ids}
    if not doc_ids:
        return out
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    wanted = F.array(*(F.lit(doc).cast("long") for doc in doc_ids))
    inside = blocks.where((F.col("first_doc") <= max(doc_ids)) & (F.col("last_doc") >= min(doc_ids)) & F.arrays_overlap("doc_ids", wanted))
    every = F.sequence(F.lit(0), F.size("doc_ids") - 1)
    found = inside.select("part", "block", "dict_sha256", "width", "doc_ids", "n_tokens", "offsets", "frames",
                          F.explode(F.filter(every, lambda i: F.array_contains(wanted, F.col("doc_ids")[i]))).alias("i"))
    frame = F.expr("substring(frames, CAST(offsets[i] + 1 AS INT), CAST(offsets[i + 1] - offsets[i] AS INT))")
    rows = found.select("part", "block", "i", "dict_sha256", "width", F.col("doc_ids")[F.col("i")].alias("doc_id"), F.col("n_tokens")[F.col("i")].alias("n"), frame.alias("frame"))
    for r in sorted(rows.collect(), key=lambda r: (r["part"], r["block"], r["i"])):
        out[r["doc_id"]].append(np.frombuffer(unpack(r["dict_sha256"], bytes(r["frame"]), r["width"], r["n"]), "<u4").tolist())
    return out


def store_and_read(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write a store to the shared folder and read every document back from it."""
    scratch = Scratch(docs.sparkSession, "token-store")
    path = scratch.path("store")
    write_token_store(docs, path, tokenizer_path, **options)
    return read_token_store(docs.sparkSession, path)
