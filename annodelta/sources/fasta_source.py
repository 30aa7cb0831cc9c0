"""Data sources for indexed FASTA: plain text by byte ranges, the block table of BGZF, and a sink with a commit step.

Plain text: an input partition is a stretch of the index (whole contigs, together about ``splitBytes``) or some chunks of
one long contig. It names its stretch by index bytes, so plans stay small however many contigs there are. A filter on
``contig`` is taken over where the session allows it.
BGZF: each byte range finds the first block that begins in it by itself and lists its blocks; nothing walks the whole file.
Sink: tasks write below ``_temporary``; the commit moves what succeeded and adds a ``.fai`` beside every file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from annodelta.operators.genome import CHUNK_BASES

SPLIT_BYTES = 16 << 20
READ_BASES = 1 << 20
BLOCKS_PER_RUN = 64
BLOCK_BYTES = 65536
#: How every BGZF block begins, by position, and the size of its header.
BGZF_MARKS = ((0, b"\x1f\x8b\x08\x04"), (10, b"\x06\x00BC\x02\x00"))
BGZF_HEADER = 18
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def qualified(spark: SparkSession, path: str) -> str:
    """A path without scheme lies on the session's default file system, as for Spark's own sources."""
    default = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
    return path if "://" in path or default.startswith("file:") else default.rstrip("/") + "/" + path.lstrip("/")


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and "://" not in path:
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path else (pafs.LocalFileSystem(), path)


def open_file(path: str) -> pa.NativeFile:
    filesystem, name = locate(path)
    return filesystem.open_input_file(name)


def indexed_files(path: str, fai: str) -> list[tuple[str, str]]:
    """(text, index) of one file, or of all indexed files of a folder."""
    filesystem, name = locate(path)
    if filesystem.get_file_info(name).type != pafs.FileType.Directory:
        return [(path, fai or path + ".fai")]
    names = sorted(f.base_name for f in filesystem.get_file_info(pafs.FileSelector(name)) if f.base_name.endswith(".fai"))
    return [(f"{path}/{n.removesuffix('.fai')}", f"{path}/{n}") for n in names]


@dataclass(frozen=True)
class Contig:
    name: str
    bases: int
    offset: int
    line_bases: int
    line_width: int

    def byte(self, base: int) -> int:
        """Where a base stands in the file."""
        return self.offset + base // self.line_bases * self.line_width + base % self.line_bases


def index_lines(fai: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, Contig]]:
    """(first byte, byte behind, contig) of the index lines that begin in [start, end), one block in memory at a time."""
    with open_file(fai) as handle:
        stop = handle.size() if end is None else end
        handle.seek(start)
        at, rest = start, b""
        while at + len(rest) < stop:
            block = handle.read(min(1 << 20, stop - at - len(rest)))
            if not block:
                break
            *lines, rest = (rest + block).split(b"\n")
            if at + sum(len(x) + 1 for x in lines) + len(rest) >= stop and rest:
                lines, rest = [*lines, rest], b""
            for line in lines:
                after = at + len(line) + 1
                fields = line.decode().rstrip("\r").split("\t")
                if len(fields) >= 5:
                    yield at, after, Contig(fields[0], *map(int, fields[1:5]))
                at = after


@dataclass
class FastaRange(InputPartition):
    """Index bytes [start, end) of a file; ``count`` chunks from ``first`` on of its only contig, or all (-1)."""

    fasta: str
    fai: str
    start: int
    end: int
    first: int = 0
    count: int = -1


class FastaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = indexed_files(options["path"], options.get("fai", ""))
        self.chunk = int(options.get("chunk", CHUNK_BASES))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.wanted: set[str] | None = None

    def _has(self, contig: Contig) -> bool:
        return contig.bases > 0 and (self.wanted is None or contig.name in self.wanted)

    def partitions(self) -> list[FastaRange]:
        return [part for fasta, fai in self.files for part in self._ranges(fasta, fai)] or [FastaRange("", "", 0, 0)]

    def _ranges(self, fasta: str, fai: str) -> Iterator[FastaRange]:
        start, end, size = None, 0, 0
        for at, after, contig in index_lines(fai):
            if not self._has(contig):
                continue
            if contig.bases > self.split:
                per = max(1, self.split // self.chunk)
                for low in range(0, -(-contig.bases // self.chunk), per):
                    yield FastaRange(fasta, fai, at, after, low, per)
                continue
            if start is not None and size + contig.bases > self.split:
                yield FastaRange(fasta, fai, start, end)
                start, size = None, 0
            start = at if start is None else start
            end, size = after, size + contig.bases
        if start is not None:
            yield FastaRange(fasta, fai, start, end)

    def read(self, part: FastaRange) -> Iterator[pa.RecordBatch]:
        if not part.fasta:
            return
        names, numbers, texts, held = [], [], [], 0
        with open_file(part.fasta) as handle:
            for _, _, contig in index_lines(part.fai, part.start, part.end):
                if not self._has(contig) or (part.count < 0 and contig.bases > self.split):
                    continue  # long contigs inside a stretch have ranges of their own
                total = -(-contig.bases // self.chunk)
                last = total if part.count < 0 else min(total, part.first + part.count)
                step = max(1, READ_BASES // self.chunk)
                for low in range(part.first, last, step):
                    high = min(low + step, last)
                    text = self._text(handle, contig, low * self.chunk, min(high * self.chunk, contig.bases))
                    names += [contig.name] * (high - low)
                    numbers += range(low, high)
                    texts += [text[k:k + self.chunk] for k in range(0, len(text), self.chunk)]
                    held += len(text)
                    if held >= READ_BASES:
                        yield self._batch(names, numbers, texts)
                        names, numbers, texts, held = [], [], [], 0
        if names:
            yield self._batch(names, numbers, texts)

    def _text(self, handle: pa.NativeFile, contig: Contig, start: int, stop: int) -> str:
        first = contig.byte(start)
        handle.seek(first)
        text = handle.read(contig.byte(stop - 1) + 1 - first).translate(None, b"\r\n").decode("ascii")
        if len(text) != stop - start:
            raise ValueError(f"the index does not fit the text of contig {contig.name}")
        return text

    def _batch(self, names: list[str], numbers: list[int], texts: list[str]) -> pa.RecordBatch:
        places = pa.array([n * self.chunk + 1 for n in numbers], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(numbers, pa.int64()), places, pa.array(texts, pa.string())],
            names=["contig", "chunk_id", "chunk_start", "seq"])


class FilteringFastaReader(FastaReader):
    """Plans no range of a contig that an equality or a list leaves out."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("contig",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


class FastaSource(DataSource):
    """Options: path (a file or a folder of indexed files), fai, chunk, splitBytes, pushdown."""

    @classmethod
    def name(cls) -> str:
        return "indexed_fasta"

    def schema(self) -> str:
        return "contig string, chunk_id long, chunk_start long, seq string"

    def reader(self, schema) -> DataSourceReader:
        return (FilteringFastaReader if self.options.get("pushdown") == "true" else FastaReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FastaWriter(self.options["path"], overwrite)


@dataclass
class ByteRange(InputPartition):
    number: int
    start: int
    end: int


def block_length(data: bytes, at: int) -> int:
    """Size of the block whose header stands at ``at``, 0 if none does."""
    if len(data) < at + BGZF_HEADER or any(data[at + k:at + k + len(mark)] != mark for k, mark in BGZF_MARKS):
        return 0
    return struct.unpack_from("<H", data, at + 16)[0] + 1


def first_block(data: bytes, at_end: bool) -> int | None:
    """Where the first block begins: at a header whose own length leads to another one, or to the end of the file."""
    at = data.find(BGZF_MARKS[0][1])
    while at >= 0:
        length = block_length(data, at)
        after = at + length
        if length and (block_length(data, after) or (at_end and after == len(data))):
            return at
        at = data.find(BGZF_MARKS[0][1], at + 1)
    return None


class BlockReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[ByteRange]:
        with open_file(self.path) as handle:
            size = handle.size()
        return [ByteRange(n, at, min(at + self.split, size)) for n, at in enumerate(range(0, size, self.split))]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        """The blocks that begin in a range: how much text they hold, and runs of (place, text before it in the range, blocks)."""
        with open_file(self.path) as handle:
            handle.seek(part.start)
            data = handle.read(part.end - part.start + 2 * BLOCK_BYTES)  # the last block and the header behind it
            at_end = part.start + len(data) == handle.size()
        own = part.end - part.start
        at = first_block(data, at_end)
        runs, text, blocks, begin = [], 0, 0, (0, 0)
        while at is not None and at < min(own, len(data)):
            length = block_length(data, at)
            if not length or at + length > len(data):
                raise ValueError(f"no block of compressed text at byte {part.start + at}")
            if blocks == 0:
                begin = (part.start + at, text)
            text += struct.unpack_from("<I", data, at + length - 4)[0]
            at, blocks = at + length, blocks + 1
            if blocks == BLOCKS_PER_RUN:
                runs.append((*begin, blocks))
                blocks = 0
        if blocks:
            runs.append((*begin, blocks))
        yield part.number, text, runs


class BlockSource(DataSource):
    """Options: path, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_blocks"

    def schema(self) -> str:
        return "number int, text_bytes long, runs array<struct<at: long, inner: long, blocks: int>>"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


@dataclass
class WrittenFile(WriterCommitMessage):
    name: str | None
    index: str | None


class FastaWriter(DataSourceArrowWriter):
    """Rows of (id, text) as records of one line each."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        task = TaskContext.get()
        filesystem, folder = locate(self.path)
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.job}.fa"
        batches = (batch for batch in iterator if batch.num_rows)
        first = next(batches, None)
        if first is None:
            return WrittenFile(None, None)
        scratch = f"{folder}/_temporary/{self.job}"
        filesystem.create_dir(scratch, recursive=True)
        offset = 0
        with filesystem.open_output_stream(f"{scratch}/{name}") as text, filesystem.open_output_stream(
                f"{scratch}/{name}.fai") as index:
            for batch in chain([first], batches):
                for key, bases in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    head, body = f">{key}\n".encode(), bases.encode("ascii")
                    text.write(head + body + b"\n")
                    index.write(f"{key}\t{len(body)}\t{offset + len(head)}\t{len(body)}\t{len(body) + 1}\n".encode())
                    offset += len(head) + len(body) + 1
        return WrittenFile(name, name + ".fai")

    def commit(self, messages: list[WrittenFile | None]) -> None:
        filesystem, folder = locate(self.path)
        filesystem.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in filesystem.get_file_info(pafs.FileSelector(folder)):
                if old.type == pafs.FileType.File and old.base_name.endswith((".fa", ".fai")):
                    filesystem.delete_file(old.path)
        for message in messages:
            if message is not None and message.name:
                # The index goes last: readers list indexes, so a text without one is not seen.
                for name in (message.name, message.index):
                    filesystem.move(f"{folder}/_temporary/{self.job}/{name}", f"{folder}/{name}")
        self._clean(filesystem, folder)
        with filesystem.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[WrittenFile | None]) -> None:
        self._clean(*locate(self.path))

    def _clean(self, filesystem: pafs.FileSystem, folder: str) -> None:
        scratch = f"{folder}/_temporary/{self.job}"
        if filesystem.get_file_info(scratch).type == pafs.FileType.Directory:
            filesystem.delete_dir(scratch)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)
    spark.dataSource.register(BlockSource)
