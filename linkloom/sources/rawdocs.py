"""Raw-record files: ``doc_<id> 1F <length> 1F <html> 1E ...``, 17 at the end of each file.

Records are framed by Spark expressions.  A Python data source only moves the bytes: its writer
rolls files by size inside each task, its reader streams byte ranges of files, so neither holds
more than a chunk and one record.

A commit is one small file, the journal, that names the prepared files, the names they get and the
files that go.  Until it is there readers see what was there before; from then on they see what it
says, wherever its files lie.  The writer then carries it out and removes it, and if it can't, the
next writer of the folder does.  A folder has one writer at a time.

Where only Spark reaches the store (hdfs, viewfs and the like), Spark's own writer and reader move the
bytes, each file as one row, which bounds its size; the commit is the same.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from linkloom.files import SparkFiles, resolved
from linkloom.schemas import (
    FIELD_SEPARATOR,
    FILE_END,
    FILE_PREFIX,
    FILE_SUFFIX,
    MAX_FILE_SIZE,
    RAWDOC,
    RECORD_SEPARATOR,
)

FORMAT = "rawdocs"
_SEPARATORS = "".join(map(chr, (FILE_END, RECORD_SEPARATOR, FIELD_SEPARATOR)))
_SPLIT_SIZE = 64 * 1024 * 1024
_CHUNK = 4 * 1024 * 1024
_BATCH_BYTES = 8 * 1024 * 1024
_RENAMERS = 32
_JOURNAL = "_journal.json"
#: Schemes that pyarrow opens by itself, on any machine.
_DIRECT = ("file", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss")
#: Longest file that Spark's writer and reader move as one row; only a longer record has a longer one.
_ROW_BYTES = 32 * 1024 * 1024
_ROW_FILE = re.compile(r"part-(\d+)-.*-c(\d+)\.txt")


# ---- framing -------------------------------------------------------------------------------


def encode_records(
    pages: DataFrame, length_mode: str = "decimal", on_separator: str = "error"
) -> DataFrame:
    """``id, record``: the framed bytes of each page with HTML.

    ``length_mode="decimal"`` writes the UTF-8 length as text, ``"low_byte"`` its lowest byte.
    A separator inside the HTML would break the frame: ``on_separator`` raises or strips it.
    """
    if length_mode not in ("decimal", "low_byte"):
        raise ValueError(f"unknown length_mode {length_mode!r}")
    if on_separator not in ("error", "strip"):
        raise ValueError(f"unknown on_separator {on_separator!r}")
    page_id = "id" if "id" in pages.columns else "page_id"
    html = F.col("html")
    if on_separator == "strip":
        html = without_separators(html)
    else:
        message = F.concat(F.lit("separator byte in the HTML of document "), F.col("id").cast("string"))
        html = F.when(html.rlike(f"[{_SEPARATORS}]"), F.raise_error(message)).otherwise(html)
    rows = (
        pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))
        .select(F.col(page_id).cast("long").alias("id"), "html")
        .select("id", html.alias("html"))
    )
    return rows.select("id", _record(length_mode).alias("record"))


def without_separators(html: Column) -> Column:
    """HTML without the bytes that frame records."""
    return F.translate(html, _SEPARATORS, "")


def _record(length_mode: str) -> Column:
    def raw(code: int) -> Column:
        return F.unhex(F.lit(f"{code:02X}"))

    length = F.octet_length("html")
    if length_mode == "decimal":
        size = F.encode(length.cast("string"), "UTF-8")
    else:
        size = F.unhex(F.lpad(F.hex(length.bitwiseAND(F.lit(255)).cast("long")), 2, "0"))
    return F.concat(
        F.encode(F.concat(F.lit("doc_"), F.col("id").cast("string")), "UTF-8"),
        raw(FIELD_SEPARATOR),
        size,
        raw(FIELD_SEPARATOR),
        F.encode("html", "UTF-8"),
        raw(RECORD_SEPARATOR),
    )


# ---- data source ---------------------------------------------------------------------------


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^s3[an]://", "s3://", path)  # Spark's names for it
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class _TaskFiles(WriterCommitMessage):
    part: int
    files: list[str]
    sizes: list[int]
    records: int


class _RollingFiles:
    """Files of one task; a new one starts when the next record would exceed the limit."""

    def __init__(self, filesystem: fs.FileSystem, stem: str, limit: int):
        self.filesystem, self.stem, self.limit = filesystem, stem, limit
        self.names: list[str] = []
        self.sizes: list[int] = []
        self.out = None
        self.size = self.records = 0

    def add(self, data: memoryview, ends: np.ndarray) -> None:
        """Records that lie one after the other in ``data``; ``ends`` has where each ends."""
        first = begin = 0
        while first < len(ends):
            last = int(np.searchsorted(ends, begin + self.limit - self.size, side="right"))
            if last <= first:
                if self.size:
                    self.close()
                    continue
                last = first + 1  # longer than the limit: a file of its own
            if self.out is None:
                self.names.append(f"{self.stem}-{len(self.names):06d}")
                self.out = self.filesystem.open_output_stream(self.names[-1], buffer_size=_CHUNK)
            end = int(ends[last - 1])
            self.out.write(data[begin:end])
            self.size += end - begin
            self.records += last - first
            first, begin = last, end

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes([FILE_END]))
            self.out.close()
            self.sizes.append(self.size + 1)
            self.out, self.size = None, 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"]
        self.limit = int(options.get("maxfilesize", MAX_FILE_SIZE))
        self.prefix = options.get("fileprefix") or FILE_PREFIX
        self.suffix = options.get("filesuffix") or FILE_SUFFIX
        self.overwrite = overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        filesystem, root = _open_fs(self.path)
        task = TaskContext.get()
        filesystem.create_dir(f"{root}/{self.staging}", recursive=True)
        # The attempt number keeps a retried or speculative task apart from the first one.
        stem = f"{root}/{self.staging}/{task.partitionId():06d}-{task.taskAttemptId()}"
        files = _RollingFiles(filesystem, stem, self.limit)
        for batch in iterator:
            records = batch.column(batch.schema.get_field_index("record")).cast(pa.large_binary())
            if len(records):
                _, offsets, data = records.buffers()
                ends = np.frombuffer(offsets, np.int64)[records.offset : records.offset + len(records) + 1]
                files.add(memoryview(data)[ends[0] : ends[-1]], ends[1:] - ends[0])
        files.close()
        return _TaskFiles(task.partitionId(), files.names, files.sizes, files.records)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        tasks = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        staged = [(posixpath.basename(name), size) for m in tasks for name, size in zip(m.files, m.sizes)]
        self.commit_staged(*_open_fs(self.path), staged)

    def commit_staged(self, filesystem: fs.FileSystem | SparkFiles, root: str, staged: list[tuple[str, int]]) -> None:
        """Give the prepared files (name, size) their places, in this order."""
        filesystem.create_dir(root, recursive=True)
        _carry_out(filesystem, root)  # what a writer before this one has left undone
        numbered = re.compile(re.escape(self.prefix) + r"(\d+)" + re.escape(self.suffix))
        present = {
            info.base_name: int(m.group(1))
            for info in filesystem.get_file_info(fs.FileSelector(root))
            if (m := numbered.fullmatch(info.base_name))
        }
        start = 0 if self.overwrite else max(present.values(), default=-1) + 1
        moves = [
            (f"{self.staging}/{name}", f"{self.prefix}{start + i}{self.suffix}", size)
            for i, (name, size) in enumerate(staged)
        ]
        gone = set(present) - {target for _, target, _ in moves} if self.overwrite else set()
        journal = {"staging": self.staging, "moves": moves, "gone": sorted(gone)}
        beside = f"{root}/{self.staging}-journal"
        with filesystem.open_output_stream(beside) as out:
            out.write(json.dumps(journal).encode())
        filesystem.move(beside, f"{root}/{_JOURNAL}")
        _carry_out(filesystem, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.drop_staged(*_open_fs(self.path))

    def drop_staged(self, filesystem: fs.FileSystem | SparkFiles, root: str) -> None:
        journal = _journal(filesystem, root)
        if journal is None or journal["staging"] != self.staging:  # else it is committed
            _drop_folder(filesystem, f"{root}/{self.staging}")


def _journal(filesystem: fs.FileSystem, root: str) -> dict | None:
    try:
        with filesystem.open_input_stream(f"{root}/{_JOURNAL}") as source:
            return json.loads(source.read())
    except FileNotFoundError:
        return None


def _carry_out(filesystem: fs.FileSystem, root: str) -> None:
    """Do what the folder's journal says, if there is one; it may have been done in part before."""
    journal = _journal(filesystem, root)
    if journal is None:
        return

    def move(names: list) -> None:
        source = f"{root}/{names[0]}"
        if filesystem.get_file_info(source).type == fs.FileType.File:
            filesystem.move(source, f"{root}/{names[1]}")

    def delete(name: str) -> None:
        if filesystem.get_file_info(f"{root}/{name}").type == fs.FileType.File:
            filesystem.delete_file(f"{root}/{name}")

    with ThreadPoolExecutor(_RENAMERS) as pool:
        list(pool.map(move, journal["moves"]))
        list(pool.map(delete, journal["gone"]))
    filesystem.delete_file(f"{root}/{_JOURNAL}")
    _drop_folder(filesystem, f"{root}/{journal['staging']}")


def _drop_folder(filesystem: fs.FileSystem, folder: str) -> None:
    if filesystem.get_file_info(folder).type == fs.FileType.Directory:
        filesystem.delete_dir(folder)


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int
    last: bool = True
    #: Name that a file named in a journal gets, and may have by now.
    moved: str = ""


# The length is decimal text or one byte of any value, the HTML holds no separator.
_FRAME = re.compile(rb"doc_(-?[0-9]+)\x1f([0-9]+|[\x00-\xff])\x1f([^\x1e\x1f]*)\x1e")
_NEXT = re.compile(rb"\x1edoc_-?[0-9]+\x1f")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.prefix = options.get("fileprefix") or FILE_PREFIX
        self.suffix = options.get("filesuffix") or FILE_SUFFIX
        self.split = int(options.get("splitsize", _SPLIT_SIZE))

    def partitions(self) -> list[InputPartition]:
        filesystem, root = _open_fs(self.path)
        ranges = [
            _Range(path, begin, min(begin + self.split, size), begin + self.split >= size, moved)
            for path, size, moved in self._files(filesystem, root)
            for begin in range(0, max(size, 1), self.split)
        ]
        return ranges or [_Range("", 0, 0)]

    def _files(self, filesystem: fs.FileSystem, root: str) -> Iterator[tuple[str, int, str]]:
        """Path and size of each committed file, and the path that it is about to get."""
        found = [i for i in filesystem.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file]
        journals = {f: _journal(filesystem, f) for f in (posixpath.dirname(i.path) for i in found if i.base_name == _JOURNAL)}
        if None in journals.values():  # one was carried out meanwhile: look again
            yield from self._files(filesystem, root)
            return
        hidden = set()
        for folder, journal in journals.items():
            for staged, target, size in journal["moves"]:
                hidden.add(f"{folder}/{target}")
                if self._ours(target):
                    yield f"{folder}/{staged}", size, f"{folder}/{target}"
            hidden |= {f"{folder}/{name}" for name in journal["gone"]}
        for info in found:
            if self._ours(info.base_name) and "/_staging-" not in info.path and info.path not in hidden:
                yield info.path, info.size, ""

    def _ours(self, name: str) -> bool:
        return name.startswith(self.prefix) and name.endswith(self.suffix)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        """Records that begin in ``[start, end)``; the last one may reach beyond ``end``."""
        if not partition.path:
            return
        filesystem, _ = _open_fs(self.path)
        with _opened(filesystem, partition) as source:
            yield from _batches(source, partition)


def _batches(source: pa.NativeFile | io.BytesIO, partition: _Range) -> Iterator[pa.RecordBatch]:
    ids, lengths, htmls, held = [], [], [], 0
    for number, length, html in _frames(source, partition):
        if not _fits(length, html):
            raise ValueError(f"document {number.decode()} of {partition.path} has {len(html)} bytes, not as stored")
        ids.append(f"doc_{number.decode()}")
        lengths.append(len(html))
        htmls.append(html.decode("utf-8"))
        held += len(html)
        if held >= _BATCH_BYTES:
            yield _batch(ids, lengths, htmls)
            ids, lengths, htmls, held = [], [], [], 0
    if ids:
        yield _batch(ids, lengths, htmls)


def _opened(filesystem: fs.FileSystem, part: _Range) -> pa.NativeFile:
    try:
        return filesystem.open_input_file(part.path)
    except FileNotFoundError:
        if not part.moved:
            raise
        return filesystem.open_input_file(part.moved)


def _fits(length: bytes, html: bytes) -> bool:
    """Whether the stored length, decimal text or the low byte alone, is that of the HTML."""
    return length == b"%d" % len(html) or length == bytes([len(html) & 255])


def _batch(ids: list[str], lengths: list[int], htmls: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.array(htmls, pa.string())],
        names=["id", "length", "html"],
    )


def _frames(source: pa.NativeFile | io.BytesIO, part: _Range) -> Iterator[tuple[bytes, bytes, bytes]]:
    # Start one byte early: a record that begins at ``start`` follows the separator before it.
    offset = max(part.start - 1, 0)
    source.seek(offset)
    held = b""
    aligned = part.start == 0
    ended = False
    while not ended:
        chunk = source.read(_CHUNK)
        ended = not chunk
        held += chunk
        if not aligned:
            found = _NEXT.search(held)
            if found is None:
                # Keep enough to see a separator whose record head is cut by the chunk's end.
                drop = max(len(held) - 64, 0)
                held, offset = held[drop:], offset + drop
                if offset >= part.end:
                    return
                continue
            held, offset, aligned = held[found.start() + 1 :], offset + found.start() + 1, True
        at = 0
        while frame := _FRAME.match(held, at):
            if offset + at >= part.end:
                return
            yield frame.groups()
            at = frame.end()
        held, offset = held[at:], offset + at
        if held[:1] == bytes([FILE_END]):
            if held[1:] or source.read(1):
                raise ValueError(f"bytes after the end mark at byte {offset} of {part.path}")
            return
        if offset >= part.end and not part.last:
            return
    # The file has ended without its mark, or in the middle of a record.
    if aligned or (part.last and held[-1:] != bytes([FILE_END])):
        raise ValueError(f"broken record or no end mark at byte {offset} of {part.path}")


class RawDocs(DataSource):
    """``spark.read/write.format("rawdocs")`` after :func:`register`."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RAWDOC.simpleString()

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawDocs)


# ---- stores that only Spark reaches ----------------------------------------------------------


def _direct(path: str) -> bool:
    return path.partition(":")[0] in _DIRECT


def _whole_files(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column(0).drop_null().to_pylist():
                if held and size + len(record) > limit:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])
                    held, size = [], 0
                held.append(record)
                size += len(record)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])

    return run


def _write_by_spark(records: DataFrame, path: str, options: dict[str, str], mode: str) -> None:
    """As the data source does, but each file is a row of Spark's text writer, which adds the end mark."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    writer, system = _Writer({"path": path, **options}, mode == "overwrite"), SparkFiles(records.sparkSession)
    folder = f"{path}/{writer.staging}"
    files = records.select("record").mapInArrow(_whole_files(min(writer.limit, _ROW_BYTES)), "file binary")
    try:
        (
            files.select(F.col("file").cast("string").alias("value"))
            .write.option("lineSep", chr(FILE_END))
            .option("compression", "none")
            .option("maxRecordsPerFile", "1")
            .text(folder)
        )
        found = [(m, i) for i in system.get_file_info(fs.FileSelector(folder)) if i.size and (m := _ROW_FILE.fullmatch(i.base_name))]
        found.sort(key=lambda f: (int(f[0][1]), int(f[0][2])))
        writer.commit_staged(system, path, [(i.base_name, i.size) for _, i in found])
    except BaseException:
        writer.drop_staged(system, path)
        raise


def _read_by_spark(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """As the data source does, but each file is a row; files that a journal names are read where they lie now."""
    found = [name for name, _, _ in _Reader({"path": path, **options})._files(SparkFiles(spark), path)]
    if not found:
        return spark.createDataFrame([], RAWDOC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*batch.columns):
                data = data.as_buffer()
                yield from _batches(io.BytesIO(data), _Range(name.as_py(), 0, data.size))

    return spark.read.format("binaryFile").load(found).select("path", "content").mapInArrow(run, RAWDOC)


# ---- order over all files -------------------------------------------------------------------

_UNEVEN = 2  # times the mean
_ROWS_PER_TASK = 10_000  # some hundred megabytes of HTML


def _by_id_ranges(ids: DataFrame, records: DataFrame, partitions: int | None) -> DataFrame:
    """Range-partition the records by id.

    ``repartitionByRange`` samples its input, which would read, join and encode all HTML twice.
    Ids come from a counter, so equal ranges are about equally full; a count over the id column
    alone confirms that, and sampling remains for ids that are not.
    """
    ids = ids.select(F.col("id" if "id" in ids.columns else "page_id").cast("long").alias("id"))
    low, high, total = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    if low is None:
        return records.coalesce(1)
    count = partitions or -(-total // _ROWS_PER_TASK)
    width = -(-(high - low + 1) // count)
    part = F.expr(f"CAST((id - {low}L) div {width}L AS INT)")
    fullest = ids.groupBy(part.alias("part")).count().agg(F.max("count")).first()[0]
    if fullest * count > _UNEVEN * max(total, count):
        return records.repartitionByRange(count, "id")
    return records.repartitionById(count, part)


def _shared(spark: SparkSession, path: str) -> str:
    """The path as executors must open it: named with its file system, and not a local one on a cluster.

    What lies below ``spark.checkpoint.dir`` is shared, whatever its file system.
    """
    path = resolved(spark, path)
    if path.startswith("file:") and not spark.conf.get("spark.master", "").startswith("local"):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root or not path.startswith(resolved(spark, root).rstrip("/") + "/"):
            raise ValueError(f"{path} is a local folder, which executors do not share")
    return path


def _for_spark(prefix: str | None) -> None:
    if (prefix or FILE_PREFIX).startswith(("_", ".")):
        raise ValueError(f"Spark's reader passes over files named {prefix}...")


# ---- public sink and source ----------------------------------------------------------------


def write_rawdocs(
    pages: DataFrame,
    path: str,
    max_file_size: int | None = MAX_FILE_SIZE,
    file_prefix: str | None = None,
    file_suffix: str | None = None,
    length_mode: str = "decimal",
    on_separator: str = "error",
    order: str = "global",
    partitions: int | None = None,
    mode: str = "append",
    ids: DataFrame | None = None,
) -> None:
    """Write pages as record files in id order, rolled at ``max_file_size`` bytes.

    ``order="global"`` range-partitions by id, so that file numbers follow the ids over all files
    (with ``partitions=1`` exactly as one sequential writer rolls them).  ``order="local"`` sorts
    inside the present partitions only and saves the shuffle of all HTML.  The ranges are taken
    from ``ids``, a cheap table that holds all ids of ``pages`` (and may hold more), or else from
    ``pages`` itself.  Readers see all files of the job or none; ``mode="overwrite"`` replaces all
    files of the same prefix and suffix, and if it is broken off the old ones or the new ones are whole.
    On a store that only Spark reaches, files of several records hold at most 32 MiB.
    """
    if order not in ("global", "local"):
        raise ValueError(f"unknown order {order!r}")
    records = encode_records(pages, length_mode, on_separator)
    if order == "global":
        records = _by_id_ranges(pages if ids is None else ids, records, partitions)
    records, path = records.sortWithinPartitions("id"), _shared(pages.sparkSession, path)
    options = {
        "maxfilesize": str(max_file_size or MAX_FILE_SIZE),
        "fileprefix": file_prefix or FILE_PREFIX,
        "filesuffix": file_suffix or FILE_SUFFIX,
    }
    if not _direct(path):
        _for_spark(file_prefix)
        _write_by_spark(records, path, options, mode)
        return
    register(pages.sparkSession)
    records.write.format(FORMAT).mode(mode).options(**options).save(path)


def read_rawdocs(
    spark: SparkSession,
    path: str,
    file_prefix: str | None = None,
    file_suffix: str | None = None,
    split_size: int = _SPLIT_SIZE,
) -> DataFrame:
    """Records of :func:`write_rawdocs` as ``id`` (``doc_<n>``), ``length``, ``html``."""
    path = _shared(spark, path)
    options = {"fileprefix": file_prefix or FILE_PREFIX, "filesuffix": file_suffix or FILE_SUFFIX}
    if not _direct(path):
        _for_spark(file_prefix)
        return _read_by_spark(spark, path, options)
    register(spark)
    return spark.read.format(FORMAT).options(splitsize=str(split_size), **options).load(path)
