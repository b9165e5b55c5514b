"""Token counts from the distinct pre-tokens, without ids.

1. Each task splits its texts into pre-tokens and keeps, for chunks of at most
   ``chunk_bytes`` of text, the distinct pre-tokens and every document's
   frequencies of them (packed, by place in the chunk's list). Written once.
2. The chunks' distinct pre-tokens are dealt by the pre-token and sorted: equal
   ones lie side by side, so each is counted by the library once, and its count
   goes to all (chunk, place) rows of it. A pre-token has a row per chunk, not
   per document, so a very common one is no hot key.
3. The counts meet their chunk's frequencies, and each document's tokens are
   the sum of frequency times count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import Scratch, slices
from barspark.llm.tokens import broadcast_tokenizer, load_tokenizer

CHUNK_BYTES = 48 << 20
#: Fixed value: the published pattern of byte-level BPE pre-tokens.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on which this pattern's library and the tokenizer's surely agree.
_PLAIN = regex.compile(r"[\x00-ɏ‐-‧€]*+")


class PreTokenizer:
    """Pre-tokens of whole texts, as the tokenizer file says.

    The plain byte-level pre-tokenizer is done by one pattern; texts with
    characters of other Unicode blocks, and all texts of other tokenizers, by the
    library's own pre-tokenizer. Strings of added tokens inside a text are
    pre-tokens of their own, as the library takes them out first.
    """

    def __init__(self, text: str):
        import json

        self.tokenizer = load_tokenizer(text)
        spec = json.loads(text)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer"):
            raise ValueError("a tokenizer that normalises is counted by encoding, not by pre-tokens")
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = sorted(added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if added else None
        self.find = regex.compile(BYTE_LEVEL).findall

    def split(self, text: str) -> list[str]:
        if self.cut and any(a in text for a in self.added):
            parts = self.cut.split(text)
            return [t for i, p in enumerate(parts) for t in ([p] if i % 2 else self.split(p)) if p]
        if self.plain and _PLAIN.fullmatch(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def _chunks(shared, chunk_bytes: int):
    schema = pa.schema(
        [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("n_distinct", pa.list_(pa.int64()))]
        + [("frequencies", pa.binary()), ("pre_tokens", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, pack = PreTokenizer(shared.value), zstandard.ZstdCompressor(level=3).compress
        number = TaskContext.get().partitionId() << 32
        place: dict[str, int] = {}
        ids: list = []
        sizes: list[int] = []
        distinct: list[int] = []
        at: list[np.ndarray] = []
        times: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            both = [np.concatenate(x).astype("<u4") if x else np.empty(0, "<u4") for x in (at, times)]
            # each document's places ascend: their steps, in planes of a byte, compress well
            raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes() for x in (np.diff(both[0], prepend=np.uint32(0)), both[1]))
            row = [[number], [ids], [sizes], [distinct], [pack(raw)], [list(place)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = pre.split(text) if text else []
                for t in found:
                    if t not in place:
                        place[t] = len(place)
                where, how_often = np.unique(np.fromiter(map(place.__getitem__, found), np.uint32, len(found)), return_counts=True)
                ids.append(doc)
                sizes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                distinct.append(len(where))
                at.append(where)
                times.append(how_often)
                held += sizes[-1] + 64
                if held >= chunk_bytes:
                    yield flush()
                    number, held = number + 1, 0
                    place, ids, sizes, distinct, at, times = {}, [], [], [], [], []
        if ids:
            yield flush()

    return run


def _count_once(shared):
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(shared.value)
        last, last_n = None, 0
        for batch in batches:
            names = batch.column(2).dictionary_encode()
            distinct = names.dictionary.to_pylist()
            new = [t for t in distinct if t != last]
            known = {last: last_n} | {
                t: len(e.ids)
                for i in range(0, len(new), 4096)
                for t, e in zip(new[i : i + 4096], tokenizer.encode_batch_fast(new[i : i + 4096], add_special_tokens=False), strict=True)
            }
            n = np.array([known[t] for t in distinct], dtype=np.int32)[names.indices.to_numpy()]
            if distinct:
                last = distinct[-1]
                last_n = known[last]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], schema=schema)

    return run


def _sum(frequencies: pa.Table, counts: pa.Table) -> pa.Table:
    n = np.zeros(counts.num_rows, dtype=np.int64)
    n[counts.column("place").to_numpy()] = counts.column("n").to_numpy()
    out: list[list] = [[], [], []]
    unpack = zstandard.ZstdDecompressor().decompress
    for row in frequencies.to_pylist():
        raw = np.frombuffer(unpack(row["frequencies"]), np.uint8).reshape(2, 4, -1)
        steps, times = (np.ascontiguousarray(x.T).view("<u4").reshape(-1) for x in raw)
        at = np.cumsum(steps, dtype=np.uint32)
        total = np.concatenate([[0], np.cumsum(n[at] * times)])
        ends = np.concatenate([[0], np.cumsum(row["n_distinct"])]).astype(np.int64)
        out[0] += row["doc_ids"]
        out[1] += row["n_bytes"]
        out[2] += (total[ends[1:]] - total[ends[:-1]]).astype(np.int64).tolist()
    return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "n_bytes", "n_tokens"), out, strict=True)})


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row's whole text.

    Counts are those of the library without added special tokens. Null and empty
    texts have 0 bytes and 0 tokens; a very long one is counted whole, in a chunk
    of its own; repeated rows have a row each; other columns are not looked at;
    an empty table gives no rows. The last step's groups are chunks: they hold
    ``chunk_bytes`` of text (or one longer document), however large the input.
    """
    scratch = Scratch(docs.sparkSession, "token-count")
    shared = broadcast_tokenizer(docs.sparkSession, tokenizer_path)
    PreTokenizer(shared.value)  # refuses an unfit file on the driver
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = (
        "chunk long, doc_ids array<long>, n_bytes array<long>, n_distinct array<long>, "
        "frequencies binary, pre_tokens array<string>"
    )
    chunks = scratch.table(own.mapInArrow(_chunks(shared, chunk_bytes), kind), "chunks", compression="zstd")
    counts = (
        chunks.select("chunk", F.posexplode("pre_tokens").alias("place", "pre_token"))
        .repartition("pre_token")
        .sortWithinPartitions("pre_token")
        .mapInArrow(_count_once(shared), "chunk long, place int, n int")
    )
    out = (
        chunks.drop("pre_tokens")
        .groupBy("chunk")
        .cogroup(counts.groupBy("chunk"))
        .applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    )
    out = scratch.table(out.withColumn("over_limit", F.col("n_tokens") > limit), "out")
    scratch.drop("chunks")
    return out
