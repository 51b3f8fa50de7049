"""Token ids as binary files: a shared zstandard dictionary, one frame per document.

The files are Parquet tables whose rows are packs of some megabytes, so that
any store Spark writes to will do and a lost task leaves nothing behind. A
pack is complete in itself::

    b"PACK" | version, width of an id, 2 spare bytes | sha256 of the dictionary
    number of documents n (8) | ids before the pack in its file (8)
    n times: doc id (8), flags (1), ids before it in the pack (8), end of its frame (8)
    frames

All numbers are little-endian; flag 1 says that the doc id is null. The folder
``dictionary`` holds the dictionary, ``manifest`` the number of ids before each
file, so the place of an id in the whole output is the sum of three offsets.
"""

import hashlib
import logging
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moodlark.llm.tokens import as_bytes, ids_batch, slices, vocabulary_size
from moodlark.workspace import written

logger = logging.getLogger(__name__)

MAGIC, VERSION = b"PACK", 1
PACK_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
# Documents, and ids of each, that the dictionary is trained on. It affects sizes only.
SAMPLE_DOCUMENTS, SAMPLE_IDS = 2000, 1024
LEVEL = 6
_ENTRY = np.dtype([("id", "<i8"), ("flags", "u1"), ("before", "<u8"), ("end", "<u8")])
_HEAD = len(MAGIC) + 4 + 32 + 16


def _width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def encoded(docs: DataFrame, path: str, end: int, width: int, text: str, id: str) -> DataFrame:
    """``doc_id, ids``: each text's ids and the end id, as little-endian numbers of ``width`` bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    last = end.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = [raw + last for raw in ids_batch(as_bytes(batch.column(1)), path, width)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], schema=schema)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def trained_dictionary(ids: DataFrame, width: int) -> bytes:
    """A dictionary trained on the starts of a sample of id arrays; empty if that is too small.

    The sample is about ``SAMPLE_DOCUMENTS`` rows, those whose hashes are lowest,
    copies counted once: what the driver sees is bounded by that number. If most
    rows are copies, as many different texts are taken from all rows instead.
    """
    hash_, rows = F.xxhash64("ids"), ids.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(rows, 1))
    below = hash_ <= F.lit(int((share * 2 - 1) * (1 << 63)) - (share == 1.0))

    def starts_of(chosen: DataFrame) -> list[bytes]:
        starts = chosen.groupBy(hash_.alias("hash")).agg(F.min(F.substring("ids", 1, SAMPLE_IDS * width)).alias("ids"))
        return [bytes(r["ids"]) for r in starts.orderBy("hash").limit(2 * SAMPLE_DOCUMENTS).collect()]

    sample = starts_of(ids.where(below))
    if share < 1 and len(sample) < SAMPLE_DOCUMENTS // 10:
        sample = starts_of(ids)
    total = sum(map(len, sample))
    try:
        if len(sample) >= 16 and total >= 8 << 10:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 4), sample).as_bytes()
    except zstandard.ZstdError:
        pass
    # Samples too few, too alike or too short to learn from.
    logger.warning("no dictionary: %s different texts of %s rows; each frame stands alone", len(sample), rows)
    return b""


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, **shared)


@lru_cache(maxsize=4)
def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return zstandard.ZstdDecompressor(**shared)


def pack(rows: list[tuple[int | None, int, bytes]], before: int, width: int, dictionary: bytes) -> bytes:
    """A pack of (doc id, number of ids, frame); ``before`` is the number of ids before it."""
    index = np.zeros(len(rows), dtype=_ENTRY)
    index["id"] = [id or 0 for id, _, _ in rows]
    index["flags"] = [id is None for id, _, _ in rows]
    index["before"] = np.cumsum([0] + [n for _, n, _ in rows])[:-1]
    index["end"] = np.cumsum([len(frame) for _, _, frame in rows])
    head = MAGIC + bytes([VERSION, width, 0, 0]) + hashlib.sha256(dictionary).digest()
    return head + np.array([len(rows), before], dtype="<u8").tobytes() + index.tobytes() + b"".join(f for _, _, f in rows)


class Pack:
    """Reads a pack; one document's frame is found by the index, without the others."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        if data[:4] != MAGIC or data[4] != VERSION:
            raise ValueError("not a pack of this version")
        if data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the pack was written with another dictionary")
        self.width, self.data, self.dictionary = data[5], data, dictionary
        n, self.before = (int(x) for x in np.frombuffer(data, "<u8", 2, 40))
        self.index = np.frombuffer(data, _ENTRY, n, _HEAD)
        self.frames = _HEAD + self.index.nbytes

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, i: int) -> int | None:
        return None if self.index["flags"][i] else int(self.index["id"][i])

    def start(self, i: int) -> int:
        """Ids of the file before document ``i``."""
        return self.before + int(self.index["before"][i])

    def ids(self, i: int) -> np.ndarray:
        ends = self.index["end"]
        a, b = self.frames + int(ends[i - 1] if i else 0), self.frames + int(ends[i])
        return np.frombuffer(_decompressor(self.dictionary).decompress(self.data[a:b]), f"<u{self.width}")


_PACKS = pa.schema(
    [("file", pa.int32()), ("number", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_ids", pa.int64()), ("pack", pa.binary())]
)


def write_token_files(
    docs: DataFrame, folder: str, path: str, end: int, vocabulary: int | None = None, text: str = "text", id: str = "doc_id"
) -> None:
    """Write the token ids of all texts of ``docs`` to ``folder``, in ascending order of ``id``.

    Every whole text is encoded without added tokens, and ``end`` appended. A
    null text is empty: it has the end id alone. Null ids come first; rows of
    one id stand in order of their ids' hash, equal rows side by side. An
    empty table gives no packs. Other columns are ignored.

    Texts are encoded where they are read, once; only ids are moved, two or
    four bytes each, as the tokenizer's vocabulary and the end id need.
    ``vocabulary`` may ask for more room; an id that does not fit fails the job.
    """
    spark, width = docs.sparkSession, _width(max(vocabulary or 0, vocabulary_size(path), end + 1))
    ids = written(encoded(docs, path, end, width, text, id), "token-ids")
    dictionary = trained_dictionary(ids, width)
    # A literal needs no Python worker on the executor.
    spark.range(1).select(F.lit(bytearray(dictionary)).alias("dictionary")).coalesce(1).write.parquet(f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, int, bytes]] = []
        size = n_ids = 0

        def full() -> pa.RecordBatch:
            data = pack(held, before, width, dictionary)
            row = [[file], [number], [held[0][0]], [held[-1][0]], [n_ids], [data]]
            return pa.record_batch(row, schema=_PACKS)

        for batch in slices(batches, 1):
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frame = _compressor(dictionary).compress(raw)
                held.append((doc_id, len(raw) // width, frame))
                size, n_ids = size + len(frame) + _ENTRY.itemsize, n_ids + len(raw) // width
                if size >= PACK_BYTES:
                    yield full()
                    number, before, held, size, n_ids = number + 1, before + n_ids, [], 0, 0
        if held:
            yield full()

    schema = "file int, number int, first_id long, last_id long, n_ids long, pack binary"
    key = [F.col("doc_id"), F.xxhash64("ids").alias("_hash")]
    ordered = ids.select("doc_id", "ids", key[1]).repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    packs = ordered.select("doc_id", "ids").mapInArrow(run, schema)
    # Frames are compressed already.
    packs.write.option("compression", "none").parquet(f"{folder}/packs")
    stored = spark.read.schema(schema).parquet(f"{folder}/packs")
    files = stored.groupBy("file").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    # One row per file.
    files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).coalesce(1).write.parquet(f"{folder}/manifest")


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])


_DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_files(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    ``ids_crc32`` is taken over the ids as little-endian 32-bit numbers. With
    ``wanted``, only packs that may hold these ids are read, and only their
    frames decompressed. Null and repeated ids have a row for each document;
    files of an empty table give an empty table.
    """
    dictionary = read_dictionary(spark, folder)
    packs = spark.read.parquet(f"{folder}/packs")
    if wanted:
        inside = F.lit(False)
        for id in wanted:
            inside = inside | ((F.col("first_id") <= id) & (F.col("last_id") >= id))
        packs = packs.where(inside | F.col("first_id").isNull())
    chosen = frozenset(wanted) if wanted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A pack has megabytes, a batch many packs.
        for batch in slices(batches, 1):
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                read, rows = Pack(data, dictionary), []
                for i in range(len(read)):
                    if chosen is None or read.doc_id(i) in chosen:
                        ids = read.ids(i)
                        rows.append((read.doc_id(i), file, read.start(i), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                if rows:
                    yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=_DOCUMENTS)

    found = packs.select("file", "pack").mapInArrow(run, "doc_id long, file int, at long, n_tokens long, ids_crc32 long")
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", F.col("start").alias("file_start"))
    return found.join(manifest, "file").select("doc_id", (F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
