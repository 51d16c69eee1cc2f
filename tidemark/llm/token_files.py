"""Token-id files: frequency-ranked ids in byte-aligned variable-length code, control bytes apart.

An id is written as its rank by falling frequency in the whole corpus, in 1 to 4 bytes, least first. Four lengths, two bits each, are a
control byte; control bytes and data bytes are separate columns of a block. Reading looks lengths up in a
table of the 256 control bytes and gathers all values of a block with numpy. A file is a Parquet part of blocks
(file, block, doc_ids, sizes, control, data), plus a table of ranks; files and blocks are in ascending order of doc_id.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import BATCH_BYTES, WordCache, text_ids
from tidemark.llm.common import Scratch, sliced, trimmed
from tidemark.llm.shingle_join import pack, unpack

#: Words that a worker keeps, in some 200 MB.
WORDS = 1_000_000
#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def pack_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    size = np.ones(len(values), np.uint8)
    for k in (8, 16, 24):
        size += values >= 1 << k
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    ends = np.cumsum(size, dtype=np.int64)
    data, at = np.empty(ends[-1] if len(ends) else 0, np.uint8), ends - size
    data[at] = values & 0xFF
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        data[at[more] + k] = values[more] >> (8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


def unpack_ids(control: bytes, data: bytes, count: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Library:
    """The ids of texts as the tokenizers library gives them, without the tokens that it puts around a text.

    Where the file's tokenizer is byte-level BPE, the library splits a text at its added tokens and then by the pattern of ``pretokens``, so that a
    pre-token alone has the ids that it has inside its text: only distinct ones are encoded. Texts with an added token, and all texts of other tokenizers, are given to the library whole.
    """

    def __init__(self, content: str, added_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec, self.own = json.loads(content), Tokenizer.from_str(content)
        self.own.encode_special_tokens = added_as_text
        self.added = [t["content"].encode() for t in spec.get("added_tokens") or () if not (added_as_text and t["special"])]
        split = spec.get("pre_tokenizer") or {}
        model = spec["model"]
        self.plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not any(spec.get(x) for x in ("normalizer", "truncation", "padding")) and model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.cache = WordCache(self.encode, WORDS)

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.own.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        whole = [i for i, t in enumerate(texts) if not self.plain or any(x in t for x in self.added)]
        if not whole:
            return text_ids(texts, self.cache)
        found = dict(zip(whole, self.encode([texts[i] for i in whole]), strict=True))
        flat, size = text_ids([b"" if i in found else t for i, t in enumerate(texts)], self.cache)
        parts = [np.array(found[i], np.int32) if i in found else x for i, x in enumerate(np.split(flat, np.cumsum(size)[:-1]))]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


@lru_cache(maxsize=2)
def _library(content: str, added_as_text: bool) -> Library:
    return Library(content, added_as_text)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", end: int = 0, added_as_text: bool = False) -> None:
    """Writes the files of all texts below ``path``, each text's ids followed by ``end``. tokenizer: the content of its file.

    A special token's string in a text is that token, as the library has it, or with ``added_as_text`` ordinary text. Null and empty texts have the end alone. A null doc_id comes first; rows that repeat one are in order of their text.
    """
    spark = docs.sparkSession
    parts, held = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.broadcast(tokenizer)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, file, block, total = _library(held.value, added_as_text), TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
        for part in sliced(batches, 1, BATCH_BYTES):
            flat, size = encode([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
            flat = np.insert(flat.astype(np.uint32), np.cumsum(size), np.uint32(end))
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([(size + 1).tolist()], pa.list_(pa.int64())), pa.array([pack(flat)], pa.binary())], names=["file", "block", "doc_ids", "sizes", "ids"])
            block += 1
            more = np.bincount(flat, minlength=len(total))
            more[: len(total)] += total
            total = more
        # The last row of a file is no block: how often the file has each id.
        yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([-1], pa.int32()), pa.array([None], pa.list_(pa.int64())), pa.array([None], pa.list_(pa.int64())), pa.array([pack(total)], pa.binary())], names=["file", "block", "doc_ids", "sizes", "ids"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total = unpack(blob, np.int64)
                seen = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    tokens = scratch.save(ordered.mapInArrow(trimmed(tokenise), "file int, block int, doc_ids array<long>, sizes array<long>, ids binary"), "tokens", large=True)
    counts = tokens.where("block < 0").select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # As many rows as the vocabulary has ids.
    rank_of = [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame([(k, i) for k, i in enumerate(rank_of)], "rank long, id long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    ranks = np.zeros(max(rank_of, default=0) + 1, np.uint32)
    ranks[rank_of] = np.arange(len(rank_of))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [pack_ids(ranks[unpack(blob, np.uint32)]) for blob in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array([x[k] for x in done], pa.binary()) for k in (0, 1))], names=["file", "block", "doc_ids", "sizes", "control", "data"])

    coded = tokens.where("block >= 0").mapInArrow(code, "file int, block int, doc_ids array<long>, sizes array<long>, control binary, data binary")
    coded.write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop("tokens")


def read_token_files(spark: SparkSession, path: str, each: Callable[[np.ndarray], int], kind: str = "value long") -> DataFrame:
    """(doc_id, start, n_tokens, value): ``each`` of a document's ids as unsigned 32-bit integers; start: ids of all documents before it."""
    blocks = spark.read.parquet(f"{path}/blocks")
    # As many rows as the vocabulary has ids.
    ids = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, doc_ids, sizes, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = np.cumsum(sizes)
                flat = ids[unpack_ids(control, data, int(ends[-1]))]
                values = [each(flat[b - n : b]) for b, n in zip(ends.tolist(), sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(sizes), pa.int32()), pa.array([block] * len(sizes), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - sizes), pa.array(sizes, pa.int64()), pa.array(values)], names=["file", "block", "doc_id", "inside", "n_tokens", kind.split()[0]])

    # A row per file meets in one window, the blocks of a file in another.
    own = blocks.select("file", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    files = own.groupBy("file").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("file", before(Window.orderBy("file")).alias("file_start"))
    starts = own.select("file", "block", before(Window.partitionBy("file").orderBy("block")).alias("block_start")).join(files, "file")
    docs = blocks.select("file", "block", "doc_ids", "sizes", "control", "data").mapInArrow(read, f"file int, block int, doc_id long, inside long, n_tokens long, {kind}")
    return docs.join(starts, ["file", "block"]).select("doc_id", (F.col("file_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", kind.split()[0])


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
