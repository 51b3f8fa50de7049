"""Batches of rows that readers see whole or not at all.

A batch is written to a folder of its own and then published: a small file
that lists the folders of its range of batches takes the place of the one
before. A batch that comes again is written beside its first copy, which
readers see until the new list is there. Finished ranges can be merged into
few files; folders that no list names any more are removed later, on demand.

One writer at a time: two that publish the same version of a list fail. A list
is put in place by renaming, which must not be done in parts (as in HDFS or on
a local disk).
"""

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Batches that share a list.
BATCHES_IN_RANGE = 1000
ROWS_IN_FILE = 1_000_000
BYTES_IN_FILE = 64 * 2**20
# Seconds after which a folder that is not listed may go.
KEPT_SECONDS = 24 * 3600


@dataclass(frozen=True)
class Entry:
    """A published folder: the batches it holds, first to last, and their rows."""

    folder: str
    first: int
    last: int
    rows: int


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder with the milliseconds they were changed at; none if it is not there."""
    system, at = _file_system(spark, folder)
    return {s.getPath().getName(): s.getModificationTime() for s in system.listStatus(at)} if system.exists(at) else {}


def _versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """By range, the versions of its list in ascending order."""
    found: dict[int, list[int]] = {}
    for name in _files(spark, f"{path}/lists"):
        if name.endswith(".json") and not name.startswith((".", "_")):
            at, version = name.removesuffix(".json").split("-")
            found.setdefault(int(at), []).append(int(version))
    return {at: sorted(versions) for at, versions in found.items()}


def _list_path(path: str, at: int, version: int) -> str:
    return f"{path}/lists/{at:09d}-{version:09d}.json"


_LIST = "folder string, first long, last long, rows long"


def _listed(spark: SparkSession, paths: list[str]) -> list[Entry]:
    if not paths:
        return []
    rows = spark.read.schema(_LIST).json(paths).where("folder IS NOT NULL").collect()
    return sorted((Entry(**row.asDict()) for row in rows), key=lambda e: e.first)


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """What is published, by batch: one entry for each batch, or for each merged range."""
    return _listed(spark, [_list_path(path, at, versions[-1]) for at, versions in _versions(spark, path).items()])


def _of_range(spark: SparkSession, path: str, at: int) -> list[Entry]:
    versions = _versions(spark, path).get(at)
    return _listed(spark, [_list_path(path, at, versions[-1])]) if versions else []


def _put(spark: SparkSession, path: str, at: int, listed: list[Entry]) -> None:
    """Make ``listed`` the list of a range; the one before it stays for readers that have found it."""
    versions = _versions(spark, path).get(at, [])
    version = versions[-1] + 1 if versions else 0
    target = _list_path(path, at, version)
    system, final = _file_system(spark, target)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lists/.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write("".join(json.dumps(asdict(e)) + "\n" for e in listed).encode() or b"{}\n")
    stream.close()
    if system.exists(final) or not system.rename(draft, final):
        raise RuntimeError(f"{target} was written by another job")
    for old in versions[:-1]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(_list_path(path, at, old)), False)


def write_folder(rows: DataFrame, path: str) -> tuple[str, int]:
    """Write ``rows`` to a fresh folder, which nobody sees yet; its name and their number."""
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{folder}")
    return folder, rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/data/{folder}").count()


def publish(spark: SparkSession, path: str, batch_id: int, folder: str, rows: int) -> None:
    """Let readers see a batch that was written, in place of an earlier copy of it.

    A batch whose range was merged is final: it cannot come again.
    """
    at = batch_id // BATCHES_IN_RANGE
    listed = _of_range(spark, path, at)
    if any(e.first <= batch_id <= e.last and e.first < e.last for e in listed):
        raise ValueError(f"batch {batch_id} was merged with others and is final")
    _put(spark, path, at, [*[e for e in listed if e.first != batch_id], Entry(folder, batch_id, batch_id, rows)])


def append(rows: DataFrame, path: str, batch_id: int) -> int:
    """Write and publish one batch; the number of its rows."""
    folder, n = write_folder(rows, path)
    publish(rows.sparkSession, path, batch_id, folder, n)
    return n


def read(spark: SparkSession, path: str, schema: StructType | None = None, of: list[Entry] | None = None) -> DataFrame:
    """The rows of all published batches, or of the entries ``of``. Without any, an empty table (of ``schema``)."""
    listed = entries(spark, path) if of is None else of
    reader = spark.read if schema is None else spark.read.schema(schema)
    if not listed:
        return spark.createDataFrame([], schema or StructType())
    return reader.parquet(*[f"{path}/data/{e.folder}" for e in listed])


def read_batch(spark: SparkSession, path: str, batch_id: int, schema: StructType) -> DataFrame:
    of = [e for e in _of_range(spark, path, batch_id // BATCHES_IN_RANGE) if e.first <= batch_id <= e.last]
    return read(spark, path, schema, of).where(F.col("batch_id") == batch_id)


def newest(spark: SparkSession, path: str, n: int) -> list[Entry]:
    """The last entries that hold ``n`` rows together, or all."""
    held, chosen = 0, []
    for entry in reversed(entries(spark, path)):
        if held >= n:
            break
        chosen.append(entry)
        held += entry.rows
    return chosen[::-1]


def _stored_bytes(spark: SparkSession, path: str, listed: list[Entry]) -> int:
    """Size of the folders of some entries, as stored."""
    found = [_file_system(spark, f"{path}/data/{e.folder}") for e in listed]
    return sum(system.getContentSummary(at).getLength() for system, at in found)


def merge(
    spark: SparkSession,
    path: str,
    order: tuple[str, ...] = ("batch_id", "seq"),
    rows_in_file: int = ROWS_IN_FILE,
    bytes_in_file: int = BYTES_IN_FILE,
) -> int:
    """Merge the batches of each range but the last into few files in ``order``; the number of merged ranges.

    One task writes a file, so files are bounded by rows and by bytes: what a
    task reads does not grow with the range, nor with the length of its texts.
    Readers see the same rows before and after. The old folders stay.
    """
    ranges = sorted(_versions(spark, path))
    merged = 0
    for at in ranges[:-1]:
        listed = _of_range(spark, path, at)
        if len(listed) > 1:
            rows = read(spark, path, of=listed)
            files = max(1, -(-sum(e.rows for e in listed) // rows_in_file), -(-_stored_bytes(spark, path, listed) // bytes_in_file))
            folder, n = write_folder(rows.repartitionByRange(files, *order).sortWithinPartitions(*order), path)
            _put(spark, path, at, [Entry(folder, listed[0].first, listed[-1].last, n)])
            merged += 1
    return merged


def remove_unlisted(spark: SparkSession, path: str, older_than: float = KEPT_SECONDS) -> int:
    """Delete folders that no list names, if they are older than so many seconds; their number.

    The list before the last one counts too: a reader may just have found it.
    """
    kept = {e.folder for at, versions in _versions(spark, path).items() for e in _listed(spark, [_list_path(path, at, v) for v in versions])}
    before, gone = (time.time() - older_than) * 1000, 0
    for name, changed in _files(spark, f"{path}/data").items():
        if name not in kept and changed <= before:
            system, at = _file_system(spark, f"{path}/data/{name}")
            gone += bool(system.delete(at, True))
    return gone
