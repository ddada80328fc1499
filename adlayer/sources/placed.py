"""One file written by many tasks: each row is bytes and the offset that they belong at.

Where the path is on a file system that all machines mount, each task writes
its bytes at their own places of one hidden file, and the commit puts the head
before them and gives the file its name. Elsewhere, or with layout `parts`, each
task writes parts of its own, and the commit writes a manifest that readers
take; files that it doesn't name don't count. Either way no byte of a row goes
through the driver, a task that runs again writes the same bytes to the same
places, and what fails changes nothing that readers see.

Tasks also give statistics of what they wrote, zones: the least and greatest
value of some columns over a run of records. They are kept beside the file, or
in the manifest, and let a reader pass by what a filter can't match.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows of a placed table: count records from number first on; lows and highs: of the zoned columns, over these.
PLACED = "at long, data binary, first long, count long, lows array<double>, highs array<double>"
MANIFEST, ZONES = "_manifest.json", ".zones.json"
#: Bytes of a zone, about.
ZONE = 8 << 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", path))


@dataclass
class Zone:
    first: int
    count: int
    lows: list[float]
    highs: list[float]
    bytes: int = 0


@dataclass
class _Wrote(WriterCommitMessage):
    bytes: int = 0
    zones: list[Zone] = field(default_factory=list)
    parts: list[tuple[int, int, str, int]] = field(default_factory=list)  # (first record, records, name, bytes)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.hidden, self.parts = options["path"], options["hidden"], options["layout"] == "parts"
        self.name = self.hidden.rpartition(".")[2]
        self.head, self.bytes, self.size = bytes.fromhex(options["head"]), int(options["bytes"]), int(options["size"])
        self.names, self.zone = json.loads(options["zoned"]), int(options["zone"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done = _Wrote()
        try:
            self._write(iterator, done)
        except BaseException:
            self._close()
            self._remove(done)
            raise
        return done

    def _write(self, iterator: Iterator[pa.RecordBatch], done: _Wrote) -> None:
        put = self._part if self.parts else self._place
        for batch in iterator:
            at, first, count = (batch.column(c).to_pylist() for c in ("at", "first", "count"))
            lows, highs = (batch.column(c).to_pylist() for c in ("lows", "highs"))
            for i, data in enumerate(batch.column("data")):
                raw = data.as_buffer()
                put(done, at[i], first[i], count[i], raw)
                done.bytes += raw.size
                last = done.zones[-1] if done.zones else None
                if last and last.first + last.count == first[i] and last.bytes + raw.size <= self.zone:
                    last.count, last.bytes = last.count + count[i], last.bytes + raw.size
                    last.lows, last.highs = list(map(min, last.lows, lows[i])), list(map(max, last.highs, highs[i]))
                elif self.names:
                    done.zones.append(Zone(first[i], count[i], lows[i], highs[i], raw.size))
        self._close()

    def _remove(self, done: _Wrote) -> None:
        """Deletes a task's parts; its bytes in the one file go with that."""
        system, root = filesystem(self.path)
        for _, _, name, _ in done.parts:
            system.delete_file(f"{root}/{name}")

    def _place(self, done: _Wrote, at: int, first: int, count: int, raw: pa.Buffer) -> None:
        if not hasattr(self, "_file"):
            self._file = os.open(filesystem(self.hidden)[1], os.O_WRONLY)  # it is there until the write ends or fails
        left = memoryview(raw)
        while left:
            n = os.pwrite(self._file, left, at)
            left, at = left[n:], at + n

    def _part(self, done: _Wrote, at: int, first: int, count: int, raw: pa.Buffer) -> None:
        last = done.parts[-1] if done.parts else None
        if not last or last[0] + last[1] != first or last[3] > (64 << 20):
            self._close()
            system, root = filesystem(self.path)
            system.create_dir(root)
            last = (first, 0, f"part-{self.name}-{uuid.uuid4().hex}", 0)
            self._out = system.open_output_stream(f"{root}/{last[2]}")
            done.parts.append(last)
        self._out.write(raw)
        done.parts[-1] = (last[0], last[1] + count, last[2], last[3] + raw.size)

    def _close(self) -> None:
        if hasattr(self, "_file"):
            os.fsync(self._file)
            os.close(self._file)
            del self._file
        if hasattr(self, "_out"):
            self._out.close()
            del self._out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        own = [m for m in messages if m is not None]
        found = sum(m.bytes for m in own)
        if self.bytes >= 0 and found != self.bytes:
            self.abort(messages)
            raise OSError(f"tasks wrote {found} bytes of {self.bytes}")
        system, at = filesystem(self.path)
        zones = sorted((z.first, z.count, z.lows, z.highs) for m in own for z in m.zones)
        stated = {"size": self.size, "head": self.head.hex(), "columns": self.names, "zones": zones}
        if self.parts:
            stated["parts"] = sorted(p for m in own for p in m.parts)
            system.create_dir(at)
            self._say(system, f"{at}/{MANIFEST}", stated)
            named = {name for _, _, name, _ in stated["parts"]}
            for old in system.get_file_info(fs.FileSelector(at)):
                if old.base_name.startswith("part-") and old.base_name not in named:
                    system.delete_file(old.path)
            return
        hidden = filesystem(self.hidden)[1]
        out = os.open(hidden, os.O_WRONLY)
        os.pwrite(out, self.head, 0)
        os.ftruncate(out, self.size)
        os.close(out)
        if os.path.lexists(f"{at}{ZONES}"):
            os.unlink(f"{at}{ZONES}")  # the old ones don't hold from here on
        os.replace(hidden, at)
        if self.names:
            self._say(system, f"{at}{ZONES}", stated)

    def _say(self, system: fs.FileSystem, at: str, stated: dict) -> None:
        hidden = f"{at}.{uuid.uuid4().hex}"
        with system.open_output_stream(hidden) as out:
            out.write(json.dumps(stated).encode())
        system.move(hidden, at)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if not self.parts:
            hidden = filesystem(self.hidden)[1]
            if os.path.exists(hidden):
                os.unlink(hidden)
            return
        system, root = filesystem(self.path)
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.name}-"):
                system.delete_file(f.path)


class PlacedBytes(DataSource):
    """A sink for rows of PLACED."""

    @classmethod
    def name(cls) -> str:
        return "placed_bytes"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


def shared(path: str) -> bool:
    """Whether path is on a mounted file system, so that tasks can write into one file."""
    return isinstance(filesystem(path)[0], fs.LocalFileSystem)


def write_placed(rows: DataFrame, path: str, head: bytes, size: int, content: int = -1, zoned: list[str] | None = None, layout: str = "auto", zone: int = ZONE) -> None:
    """Writes rows (PLACED) as the file path of `size` bytes, head first, over what is there.

    content: the bytes that all rows have; another number is an error, if it is
    given. Places that no row has are zeros. zoned: the columns of lows and
    highs. layout: one file, parts, or auto.
    """
    spark = rows.sparkSession
    spark.dataSource.register(PlacedBytes)
    layout = ("one" if shared(path) else "parts") if layout == "auto" else layout
    folder, _, name = path.rpartition("/")
    options = {"path": path, "hidden": f"{folder}/.{name}.{uuid.uuid4().hex}", "layout": layout, "head": head.hex(), "size": str(size), "bytes": str(content), "zoned": json.dumps(zoned or []), "zone": str(zone)}
    if layout == "one":
        with open(filesystem(options["hidden"])[1], "xb"):
            pass
    try:
        rows.write.format("placed_bytes").mode("append").options(**options).save()
    except BaseException:
        _Writer(options | {"bytes": "-1"}).abort([])  # if the job didn't come as far as that
        raise
