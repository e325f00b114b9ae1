"""Journal files: frames of length (4 bytes, big-endian), entry and CRC32 (8 bytes) of both."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: an entry is shorter than this.
MOST = 20_971_520


def frame(entry: Column) -> Column:
    """Frame of a binary entry."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(entry)), 8, "0"))
    body = F.concat(size, entry)
    return F.concat(body, F.unhex(F.lpad(F.hex(F.crc32(body)), 16, "0")))


def check_frame(data: Column) -> Column:
    """Null for a whole frame, else TOO_SHORT, BAD_LENGTH or BAD_CRC."""
    n = F.octet_length(data)
    size = F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("long")
    body, crc = F.substring(data, F.lit(1), n - 8), F.conv(F.hex(F.substring(data, n - 7, F.lit(8))), 16, 10)
    return F.when(n < 13, "TOO_SHORT").when((size < 1) | (size >= MOST) | (size != n - 12), "BAD_LENGTH").when(F.crc32(body).cast("string") != crc.cast("string"), "BAD_CRC")


def entry_of(data: Column) -> Column:
    return F.substring(data, F.lit(5), F.octet_length(data) - 12)


def frames_of(data: bytes) -> Iterator[tuple[int, bytes, str | None]]:
    """Offset, entry and error of each frame of a file, up to a short read or an error."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">i", data, at)
        if n < 1 or n >= MOST:
            yield at, b"", "BAD_LENGTH"
            return
        if at + 12 + n > len(data):
            return
        (crc,) = struct.unpack_from(">q", data, at + 4 + n)
        good = zlib.crc32(data[at : at + 4 + n]) == crc
        yield at, data[at + 4 : at + 4 + n], None if good else "BAD_CRC"
        if not good:
            return
        at += 12 + n


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = list(frames_of(content))
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())],
                names=["path", "at", "entry", "error"],
            )


def read_journal(spark: SparkSession, path: str, name: str = "journal") -> DataFrame:
    """rank, path, at, entry and error of the frames of a journal and its rotated backups (name.1, name.2, ...).

    The oldest backup, of the highest rank, comes first, the live file (rank 0) last. A file is one task: journals are
    rotated at a bounded size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}*").load(path).select("path", "content")
    files = files.where(F.regexp_like(F.element_at(F.split("path", "/"), -1), F.lit(f"^{re.escape(name)}(\\.[0-9]+)?$")))
    rank = F.coalesce(F.try_to_number(F.regexp_extract("path", r"\.(\d+)$", 1), F.lit("999999999")).cast("int"), F.lit(0))
    rows = files.mapInArrow(_read, "path string, at long, entry binary, error string")
    return rows.withColumn("rank", rank)


def log_order() -> Window:
    return Window.orderBy(F.col("rank").desc(), "at")


def shift_backups(files: DataFrame) -> DataFrame:
    """New names at a rotation: every rank moves up by one, from the highest down."""
    return files.select("rank", (F.col("rank") + 1).alias("new_rank")).orderBy(F.col("rank").desc())


class Journal:
    """A journal of one participant, written by the driver: entries are appended as frames to a live file of bounded size.

    Once the live file has passed `threshold` bytes it becomes name.1 and older backups move up by one, from the
    oldest down. The live file is replaced by a rename, so a reader sees it whole, before or after.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "journal", threshold: int = 1 << 20):
        self.spark, self.path, self.name, self.threshold = spark, path.rstrip("/"), name, threshold

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _live(self) -> bytes:
        fs, at = self._at(self.name)
        if not fs.exists(at):
            return b""
        data = fs.open(at)
        content = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(data))
        data.close()
        return content

    def append(self, entries: Iterable[bytes]) -> int:
        """Append entries in order, rotating where the size asks for it; returns how many rotations that took."""
        live, rotations, fresh = bytearray(self._live()), 0, False
        for entry in entries:
            if not 0 < len(entry) < MOST:
                raise ValueError("an entry has at least one byte and fewer than the bound")
            if len(live) > self.threshold:
                self._put(live)
                self.rotate()
                live, rotations = bytearray(), rotations + 1
            body = struct.pack(">i", len(entry)) + entry
            live += body + struct.pack(">q", zlib.crc32(body))
            fresh = True
        if fresh:
            self._put(live)
        return rotations

    def _put(self, data: bytearray) -> None:
        fs, new = self._at(f"_{self.name}.new")
        out = fs.create(new, True)
        out.write(data)
        out.close()
        at = self._at(self.name)[1]
        fs.delete(at, False)
        fs.rename(new, at)

    def backups(self) -> list[int]:
        """Ranks of the backups, from the oldest (highest) down."""
        fs, folder = self._at("")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((int(m[1]) for n in names if (m := re.fullmatch(re.escape(self.name) + r"\.(\d+)", n))), reverse=True)

    def rotate(self) -> None:
        for rank in [*self.backups(), 0]:
            fs, at = self._at(f"{self.name}.{rank}" if rank else self.name)
            fs.rename(at, self._at(f"{self.name}.{rank + 1}")[1])
