"""ZIP and TAR archives as a data source: ``spark.read.format("archive").load(folder)``.

A row for each member: archive (its path below the folder), member, size, content. An
archive is never one row and need not be one task: large ones are dealt by member ranges.
Filters on archive, member and size are pushed down, so that members are left
out before they are unpacked. The sink writes an archive for each name, under temporary names until the job commits.

Options: ``content`` (false: names and sizes alone, nothing is unpacked), ``suffix`` (members that end so, whatever
their case), ``splitBytes``. Members with unsafe names fail the read. File systems are those that pyarrow opens.
"""

from __future__ import annotations

import re
import tarfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from cuelake.sources.files import CONTENTS, batches_of, unsafe

SCHEMA = "archive string, member string, size long, content binary"
#: Bytes of archives that a task reads, about.
SPLIT_BYTES = 64 << 20
#: What the reader hands over at a time, about.
OUT_BYTES, OUT_ROWS = 4 << 20, 1000
_KINDS = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda x, v: x == v, ds.EqualNullSafe: lambda x, v: x == v, ds.In: lambda x, v: x in v,
    ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v, ds.LessThan: lambda x, v: x < v, ds.LessThanOrEqual: lambda x, v: x <= v,
    ds.StringStartsWith: lambda x, v: x.startswith(v), ds.StringEndsWith: lambda x, v: x.endswith(v), ds.StringContains: lambda x, v: v in x,
}


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"archive": pa.string(), "member": pa.string(), "size": pa.int64(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


@dataclass
class Range(ds.InputPartition):
    """Parts (archive, part, of so many) of archives that a task reads."""

    parts: list[tuple[str, int, int, int]]


def _member_name(info: zipfile.ZipInfo) -> str:
    """Names that are not marked as UTF-8 are read as UTF-8, else as GB 18030, if they can be."""
    if info.flag_bits & 0x800:
        return info.filename
    try:
        raw = info.filename.encode("cp437")
    except UnicodeEncodeError:
        return info.filename
    for charset in ("utf-8", "gb18030"):
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            pass
    return info.filename


class ArchiveReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.content = options.get("content", "true").lower() != "false"
        self.suffix = options.get("suffix", "").lower()
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, ds.IsNotNull) and f.attribute in (("archive",), ("member",), ("size",)):
                continue  # they never are
            if type(f) in _TESTS and f.attribute in (("archive",), ("member",), ("size",)) and getattr(f, "value", None) is not None:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _wanted(self, **values: object) -> bool:
        return all(_TESTS[kind](values[name], v) for name, kind, v in self.tests if name in values)

    def partitions(self) -> Sequence[ds.InputPartition]:
        """Archives by their size alone: none is opened here."""
        fs, root = _opened(self.path)
        whole = fs.get_file_info(root)
        found = [whole] if whole.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out, parts, held = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            name = f.base_name if f.path == root else f.path[len(root) :].lstrip("/")
            if f.type != pafs.FileType.File or not name.lower().endswith(_KINDS) or any(p.startswith(("_", ".")) for p in name.split("/")) or not self._wanted(archive=name):
                continue
            many = max(1, -(-f.size // self.split)) if name.lower().endswith((".zip", ".tar")) else 1
            for k in range(many):
                parts.append((name, k, many, f.size))
                held += f.size // many
                if held >= self.split:
                    out.append(Range(parts))
                    parts, held = [], 0
        return out + ([Range(parts)] if parts else []) or [Range([])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """Members in batches of OUT_BYTES of content or OUT_ROWS rows, about."""
        held, size = [], 0
        for row in self._members(partition):
            held.append(row)
            size += len(row[3] or b"")
            if size >= OUT_BYTES or len(held) >= OUT_ROWS:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _members(self, partition: Range) -> Iterator[tuple]:
        fs, root = _opened(self.path)
        for name, k, of, size in partition.parts:
            path = root if fs.get_file_info(root).type == pafs.FileType.File else f"{root}/{name}"
            with fs.open_input_file(path) as f:
                members = self._zip if name.lower().endswith(".zip") else self._tar
                for at, member, length, unpack in members(f):
                    if unsafe(member):
                        raise ValueError(f"unsafe member {member} in {name}")
                    mine = min(of - 1, at * of // max(1, size)) == k
                    if mine and member.lower().endswith(self.suffix) and self._wanted(member=member, size=length):
                        yield name, member, length, unpack() if self.content else None

    @staticmethod
    def _zip(f) -> Iterator[tuple]:
        with zipfile.ZipFile(f) as z:
            for info in sorted(z.infolist(), key=lambda i: i.header_offset):
                if not info.is_dir():
                    yield info.header_offset, _member_name(info), info.file_size, lambda info=info: z.read(info)

    @staticmethod
    def _tar(f) -> Iterator[tuple]:
        with tarfile.open(fileobj=f) as t:
            for m in t:
                if m.isfile():
                    yield m.offset, m.name, m.size, lambda m=m: t.extractfile(m).read()


@dataclass
class Written(ds.WriterCommitMessage):
    archives: list[tuple[str, str]]


class ArchiveWriter(ds.DataSourceWriter):
    """Rows archive, member, content to a ZIP for each archive. An archive's rows are of one task and
    together: ``write_archives`` sees to that."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = _opened(self.path)
        folder = f"{root}/_temporary-{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(folder, recursive=True)
        done: list[tuple[str, str]] = []
        now = stream = packed = None
        try:
            for row in iterator:
                if row["archive"] != now:
                    if packed:
                        packed.close()
                        stream.close()
                    now = row["archive"]
                    if unsafe(now) or now in [a for a, _ in done]:
                        raise ValueError(f"archive {now} has an unsafe name, or its rows are not together")
                    done.append((now, f"{folder}/{len(done)}.zip"))
                    stream = fs.open_output_stream(done[-1][1])
                    packed = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                if unsafe(row["member"]):
                    raise ValueError(f"unsafe member {row['member']}")
                # a fixed time, so that a task that runs again writes the same bytes
                packed.writestr(zipfile.ZipInfo(row["member"]), bytes(row["content"]), zipfile.ZIP_DEFLATED)
        finally:
            if packed:
                packed.close()
                stream.close()
        return Written(done)

    def commit(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        fs, root = _opened(self.path)
        moved = [pair for m in messages if m for pair in m.archives]
        names = [a for a, _ in moved]
        if len(set(names)) < len(names):
            raise ValueError("rows of one archive are in several tasks")
        there = [f.path for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and "/_temporary-" not in f.path]
        if not self.overwrite and (again := {f"{root}/{a}" for a in names} & set(there)):
            raise ValueError(f"{sorted(again)[0]} is there already")
        if self.overwrite:
            for path in there:
                fs.delete_file(path)
        for name, path in moved:
            if "/" in name:
                fs.create_dir(f"{root}/{name.rsplit('/', 1)[0]}", recursive=True)
            fs.move(path, f"{root}/{name}")
        self._clean(fs, root)

    def abort(self, messages: list[ds.WriterCommitMessage | None]) -> None:
        self._clean(*_opened(self.path))

    def _clean(self, fs: pafs.FileSystem, root: str) -> None:
        folder = f"{root}/_temporary-{self.job}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class ArchiveSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, path: str, suffix: str = "", content: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """archive, member, size, content of the archives below a folder, or of one archive."""
    register(spark)
    return spark.read.format("archive").option("suffix", suffix).option("content", str(content).lower()).option("splitBytes", split_bytes).load(path)


def write_archives(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows (archive, member, content) to ZIP archives in a folder."""
    register(rows.sparkSession)
    with batches_of(rows.sparkSession, CONTENTS):
        rows.select("archive", "member", "content").repartition("archive").sortWithinPartitions("archive", "member").write.format("archive").mode(mode).save(path)
