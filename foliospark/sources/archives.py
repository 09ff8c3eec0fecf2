"""Zip archives as a data source: partitions planned from central directories, members read by range.

The driver reads the directory at each archive's end, and groups members into partitions of GROUP_BYTES; a task reads the bytes
of its members and nothing else, so an archive may have any size and lies in as many tasks as it needs. Rows are
(path, member, content, error), as ``files.archive_members`` gives them for archives in cells.

Paths are what pyarrow's file systems open: local and mounted folders, hdfs, s3, gs.

Defined results: hidden files and unknown suffixes are passed over; members beyond the first ``most`` of an archive, ones of more
than ``most_bytes``, and ones that are encrypted, broken or packed in unknown ways are rows with an error; an
archive without known members, and a file that is none, is one row with an error.
"""

from __future__ import annotations

import bz2
import struct
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.functions.dims import ARCHIVE_LIMIT, ARCHIVE_SUFFIXES
from foliospark.settings import settings
from foliospark.ship import ship
from foliospark.sources.files import MEMBER_BYTES

#: Packed bytes, and members, that one task reads.
GROUP_BYTES, GROUP_MEMBERS = 64 << 20, 1000
#: Directories that the driver reads at a time.
READERS = 32


@dataclass
class Group(InputPartition):
    """Members (name, offset, packed, size, method, flags, crc) of one archive, and rows that are errors already."""

    path: str
    members: list[tuple[str, int, int, int, int, int, int]]
    errors: list[tuple[str | None, str]]


def known(name: str) -> bool:
    last = name.split("/")[-1]
    return not name.startswith("__MACOSX") and not last.startswith(".") and name.lower().rsplit(".", 1)[-1] in ARCHIVE_SUFFIXES


def _groups(system: fs.FileSystem, path: str, most: int, group_bytes: int) -> list[Group]:
    try:
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            found = [x for x in z.infolist() if known(x.filename)]
    except (zipfile.BadZipFile, OSError, ValueError):  # ValueError: places beyond the file's ends
        return [Group(path, [], [(None, "not a zip file")])]
    if not found:
        return [Group(path, [], [(None, "no supported file")])]
    groups, held = [Group(path, [], [(x.filename, f"more than {most} files") for x in found[most:]])], 0
    for x in found[:most]:
        if groups[-1].members and (held + x.compress_size > group_bytes or len(groups[-1].members) >= GROUP_MEMBERS):
            groups.append(Group(path, [], []))
            held = 0
        groups[-1].members.append((x.filename, x.header_offset, x.compress_size, x.file_size, x.compress_type, x.flag_bits, x.CRC))
        held += x.compress_size
    return groups


def _member(f, offset: int, packed: int, size: int, method: int, flags: int, crc: int, most_bytes: int) -> tuple[bytes | None, str | None]:
    """A member's bytes, or what keeps it from being read. What unpacks to more than its size says is cut off and fails its sum."""
    if size > most_bytes:
        return None, f"more than {most_bytes} bytes"
    broken = None, "cannot be read"
    if flags & 1:
        return broken
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        return broken
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(offset + 30 + name + extra)
    data = f.read(packed)
    try:
        if method == zipfile.ZIP_DEFLATED:
            data = zlib.decompressobj(-15).decompress(data, most_bytes + 1)
        elif method == zipfile.ZIP_BZIP2:
            data = bz2.BZ2Decompressor().decompress(data, most_bytes + 1)
        elif method != zipfile.ZIP_STORED:
            return broken
    except (zlib.error, OSError):
        return broken
    if len(data) > most_bytes:
        return None, f"more than {most_bytes} bytes"
    return (data, None) if len(data) == size and zlib.crc32(data) == crc else broken


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most, self.most_bytes = int(options.get("most", ARCHIVE_LIMIT)), int(options.get("most_bytes", MEMBER_BYTES))
        self.group_bytes = int(options.get("group_bytes", GROUP_BYTES))

    def partitions(self) -> list[Group]:
        system, at = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        paths = sorted(x.path for x in found if x.type == fs.FileType.File)
        with ThreadPoolExecutor(READERS) as pool:
            groups = [g for gs in pool.map(lambda p: _groups(system, p, self.most, self.group_bytes), paths) for g in gs]
        return groups or [Group(at, [], [])]

    def read(self, partition: Group) -> Iterator[tuple[str, str | None, bytes | None, str | None]]:
        for member, error in partition.errors:
            yield partition.path, member, None, error
        if partition.members:
            system, _ = fs.FileSystem.from_uri(self.path)
            with system.open_input_file(partition.path) as f:
                for name, *where in partition.members:
                    yield partition.path, name, *_member(f, *where, self.most_bytes)


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").option("most", …).load(path)`` once it is registered."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "path string, member string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def members(spark: SparkSession, path: str, most: int | None = None, most_bytes: int = MEMBER_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(path, member, content, error) of the archives under path, or of one archive."""
    ship(spark)
    spark.dataSource.register(ZipMembers)
    most = settings(spark).archive_limit if most is None else most
    return spark.read.format("zip_members").options(most=most, most_bytes=most_bytes, group_bytes=group_bytes).load(path)
