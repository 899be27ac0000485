"""Small files and folder names on whatever file system Spark uses, from the driver."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    system, place = _place(spark, path)
    if not system.exists(place):
        return []
    return [status.getPath().getName() for status in system.listStatus(place)]


def resolved(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of Spark's default file system where it has none."""
    system, place = _place(spark, path)
    return system.makeQualified(place).toString()


def lasting_id(spark: SparkSession, folder: str) -> str:
    """An id that is kept in ``folder``: made at the first call, read at later ones."""
    system, place = _place(spark, folder)
    known = [n.removeprefix("run-") for n in folder_names(spark, folder) if n.startswith("run-")]
    if known:
        return min(known)
    run = uuid.uuid4().hex[:12]
    system.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(place, f"run-{run}"))
    return run


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that is in it."""
    system, place = _place(spark, path)
    system.delete(place, True)


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file in one step, whole or not at all; False if there is one of that name.

    The text is written beside it and moved there by an operation that never replaces, so of
    several callers one succeeds, on local disks and on file systems whose rename is atomic.
    """
    system, place = _place(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    system.mkdirs(place.getParent())
    beside = hadoop.Path(place.getParent(), f"_{place.getName()}-{uuid.uuid4().hex}")
    stream = system.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if place.toUri().getScheme() in (None, "file") and system.getUri().getScheme() == "file":
            os.link(beside.toUri().getPath(), place.toUri().getPath())
        else:
            rename = spark._jvm.java.lang.reflect.Array.newInstance(
                spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
            )
            context = hadoop.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(beside, place, rename)
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        return False
    finally:
        system.delete(beside, False)
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    system, place = _place(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to a name that is not taken; False if ``source`` is gone."""
    system, place = _place(spark, source)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
    system.mkdirs(hadoop.getParent())
    return system.exists(place) and system.rename(place, hadoop)


class SparkFiles:
    """What a commit needs of pyarrow's file systems, on any store that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @staticmethod
    def _info(status) -> fs.FileInfo:
        kind = fs.FileType.Directory if status.isDirectory() else fs.FileType.File
        return fs.FileInfo(status.getPath().toString(), kind, size=status.getLen())

    def get_file_info(self, what: str | fs.FileSelector) -> fs.FileInfo | list[fs.FileInfo]:
        selected = isinstance(what, fs.FileSelector)
        system, place = _place(self.spark, what.base_dir if selected else what)
        if not system.exists(place):
            if selected:
                raise FileNotFoundError(what.base_dir)
            return fs.FileInfo(what, fs.FileType.NotFound)
        if not selected:
            return self._info(system.getFileStatus(place))
        found = [self._info(status) for status in system.listStatus(place)]
        if what.recursive:
            below = [i.path for i in found if i.type == fs.FileType.Directory]
            found += [i for path in below for i in self.get_file_info(fs.FileSelector(path, recursive=True))]
        return found

    def create_dir(self, path: str, recursive: bool = True) -> None:
        system, place = _place(self.spark, path)
        system.mkdirs(place)

    def open_input_stream(self, path: str) -> io.BytesIO:
        text = read_text(self.spark, path)
        if text is None:
            raise FileNotFoundError(path)
        return io.BytesIO(text.encode())

    @contextmanager
    def open_output_stream(self, path: str) -> Iterator[io.BytesIO]:
        held = io.BytesIO()
        yield held
        system, place = _place(self.spark, path)
        stream = system.create(place, True)
        stream.write(bytearray(held.getvalue()))
        stream.close()

    def move(self, source: str, target: str) -> None:
        """A file that has the target's name goes first: not all stores replace it."""
        system, place = _place(self.spark, source)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        system.delete(hadoop, False)
        if not system.rename(place, hadoop):
            raise OSError(f"{source} can't be renamed to {target}")

    def delete_file(self, path: str) -> None:
        remove(self.spark, path)

    delete_dir = delete_file
