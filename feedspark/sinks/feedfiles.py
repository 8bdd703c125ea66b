"""Feeds as files: a data source for documents in numbered parts.

Writing expects the parts of a feed in one partition and in order, as ``formats.save`` deals
them out. A task streams them into one file per feed and holds one part at a time. Files are
written aside and moved into place when all tasks have ended, so a lost task leaves nothing.
Reading cuts files at byte ranges, so that one large file is read by many tasks.

Paths may be of any store that Arrow's file systems reach.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "feedfiles"
ASIDE = "_writing"
SLICE_PARTS = 128
LONGEST_NAME = 200


def file_name(feed_id: str, extension: str) -> str:
    """The feed's id, quoted; a digest of it where that is too long for a file system."""
    name = quote(feed_id, safe="")
    if len(name) > LONGEST_NAME:
        name = hashlib.sha256(feed_id.encode()).hexdigest()
    return f"{name}.{extension}"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


class FeedFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        store, root = stores.FileSystem.from_uri(self.path)
        folder = f"{root}/{ASIDE}/{self.run}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        files: list[str] = []
        current, last, out = None, -1, None
        for batch in iterator:
            columns = [batch.column(n).to_pylist() for n in ("feed_id", "extension", "part_no", "body")]
            for feed_id, extension, part_no, body in zip(*columns, strict=True):
                name = file_name(feed_id, extension)
                if name != current:
                    if out is not None:
                        out.close()
                    if name in files:
                        raise ValueError(f"parts of {feed_id!r} are not together")
                    current, last, out = name, -1, store.open_output_stream(f"{folder}/{name}")
                    files.append(name)
                if part_no <= last:
                    raise ValueError(f"parts of {feed_id!r} are not in order")
                last = part_no
                out.write(body.encode("utf-8"))
        if out is not None:
            out.close()
        return Written(folder, files)

    def commit(self, messages) -> None:
        store, root = stores.FileSystem.from_uri(self.path)
        if self.overwrite:
            for info in store.get_file_info(stores.FileSelector(root)):
                if info.is_file:
                    store.delete_file(info.path)
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{message.folder}/{name}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*stores.FileSystem.from_uri(self.path))

    def _clear(self, store, root: str) -> None:
        own = f"{root}/{ASIDE}/{self.run}"
        if store.get_file_info(own).type != stores.FileType.NotFound:
            store.delete_dir(own)


@dataclass
class Slice(InputPartition):
    file: str
    start: int
    end: int


class FeedFileReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Slice]:
        store, root = stores.FileSystem.from_uri(self.path)
        step = self.part_bytes * SLICE_PARTS
        files = [i for i in store.get_file_info(stores.FileSelector(root)) if i.is_file]
        return [Slice(i.path, at, min(i.size, at + step)) for i in sorted(files, key=lambda i: i.path) for at in range(0, i.size, step)]

    def read(self, partition: Slice):
        """Parts of at most ``part_bytes``; a letter belongs to the part in which it starts."""
        store, _ = stores.FileSystem.from_uri(self.path)
        feed_id = unquote(partition.file.rsplit("/", 1)[-1].rsplit(".", 1)[0])
        with store.open_input_file(partition.file) as file:
            for at in range(partition.start, partition.end, self.part_bytes):
                size = min(self.part_bytes, partition.end - at)
                data = file.read_at(size + 3, at)
                lead = _inside(data, 0)
                stop = size + _inside(data, size)
                body = data[lead:stop].decode("utf-8")
                yield pa.RecordBatch.from_pylist([{"feed_id": feed_id, "part_no": at // self.part_bytes, "body": body}])


def _inside(data: bytes, at: int) -> int:
    """How many bytes from ``at`` on belong to a letter that starts before."""
    count = 0
    while at + count < len(data) and count < 3 and data[at + count] & 0xC0 == 0x80:
        count += 1
    return count


class FeedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "feed_id string, part_no bigint, body string"

    def reader(self, schema) -> FeedFileReader:
        return FeedFileReader(self.options["path"], int(self.options.get("part_bytes", 64 << 10)))

    def writer(self, schema, overwrite: bool) -> FeedFileWriter:
        return FeedFileWriter(self.options["path"], overwrite)
