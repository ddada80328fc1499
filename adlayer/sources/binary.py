"""Binary files of records, catalogues, lattices and trajectories.

All have records of one size, so a file is read in slices of bytes, each by a
task of its own. Filters reach the source: those on a record's number become
runs of records, those on columns that the writer kept zones of pass by what
can't match, and within a slice only rows that match become Arrow rows. Where a
path is one that only Spark opens, files come whole through binaryFile.

Writers number the rows in their order; each task packs its rows and puts them
at their own places (sources.placed).
"""

from __future__ import annotations

import io
import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.expressions import ev_from_mev
from ..operators.ordered import numbered
from ..schemas import EVENTS, LANES, LATTICE, MAX_SPECIES, REACTIONS, VACANT
from ..staging import stage
from .placed import MANIFEST, PLACED, ZONE, ZONES, filesystem, write_placed

# Magic numbers and packed layouts of the formats.
ENERGY_MAGIC, BIMOLECULAR_MAGIC = b"OC20E003", b"OC20BI03"
ENERGY = np.dtype([("species", "u1"), ("energy_mev", "<i4"), ("sid", "<u4"), ("has_real_ea", "u1"), ("real_ea_mev", "<i4"), ("metal", "u1"), ("facet", "<u2")])
BIMOLECULAR = np.dtype([("species_a", "u1"), ("species_b", "u1"), ("energy_mev", "<i4"), ("sid", "<u4"), ("ea_mev", "<i4"), ("metal", "u1"), ("facet", "<u2"), ("is_dissociative", "u1")])
KINDS = {b"KMCSTAT1": "static", b"KMCOCC01": "gated"}
BLOCK = np.dtype([("rate_q16", "<u4", LANES), ("bin_id", "u1", LANES), ("transition_a", "<u2", LANES), ("transition_b", "<u2", LANES), ("is_bimolecular", "u1", LANES)])
BLOCK_BYTES, HEADER_BYTES = 320, 64
PADDED = np.dtype({"names": BLOCK.names, "formats": [BLOCK[n] for n in BLOCK.names], "offsets": [BLOCK.fields[n][1] for n in BLOCK.names], "itemsize": BLOCK_BYTES})
EVENT = np.dtype([("sim_time", "<f8"), ("site_idx", "<u4"), ("reaction_id", "<u4")])
PAGE_BYTES = 4096
CHUNK = 1 << 16
#: Bytes of a file that one task reads, about.
SLICE = 64 << 20


class FormatError(ValueError):
    pass


def species_in(header: bytes) -> list[tuple[int, str]]:
    """(bit, name) of each species from a catalogue's header."""
    count, at, found = header[8], 9, []
    if count > MAX_SPECIES:
        raise FormatError(f"{count} species are more than {MAX_SPECIES}")
    for _ in range(count):
        if at + 2 > HEADER_BYTES or at + 2 + header[at + 1] > HEADER_BYTES:
            raise FormatError("a species name runs over the header's end")
        bit, size = header[at], header[at + 1]
        try:
            name = header[at + 2 : at + 2 + size].decode()
        except UnicodeDecodeError:
            raise FormatError("a species name isn't UTF-8") from None
        if bit.bit_count() != 1:
            raise FormatError(f"species bit {bit:#04x} is not one-hot")
        found.append((bit, name))
        at += 2 + size
    if len({b for b, _ in found}) < count or len({n for _, n in found}) < count:
        raise FormatError("a species bit or name is declared more than once")
    return found


def species_header(kind: str, species: list[tuple[int, str]]) -> bytes:
    body = bytes([len(species)]) + b"".join(bytes([bit, len(name.encode())]) + name.encode() for bit, name in species)
    magic = next(m for m, k in KINDS.items() if k == kind)
    if len(species) > MAX_SPECIES or len(body) > HEADER_BYTES - 8:
        raise FormatError("the species don't fit in the header")
    made = (magic + body).ljust(HEADER_BYTES, b"\0")
    species_in(made)
    return made


@dataclass
class Catalogue:
    """kind: static or gated; reactions as in schemas.REACTIONS, unused lanes of the last block left out."""

    kind: str
    species: list[tuple[int, str]]
    reactions: DataFrame


def catalogue_head(head: bytes) -> tuple[str, list[tuple[int, str]]]:
    """(kind, species) from a catalogue's first bytes."""
    if len(head) < HEADER_BYTES or head[:8] not in KINDS:
        raise FormatError("not a catalogue file")
    return KINDS[head[:8]], species_in(head[:HEADER_BYTES])


def _content(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


@dataclass(frozen=True)
class Slices:
    """How files of one kind are cut into records.

    kind: energies, bimolecular, events, lattice or catalogue, whose records are
    its blocks; sites: of a lattice; strict: whether its file must have exactly
    those; padding: whether the lanes that fill a catalogue's last block are given.
    """

    kind: str
    sites: int = 0
    strict: bool = False
    padding: bool = False

    @property
    def layout(self) -> np.dtype:
        return {"energies": ENERGY, "bimolecular": BIMOLECULAR, "events": EVENT, "lattice": np.dtype("u1"), "catalogue": PADDED}[self.kind]

    @property
    def begin(self) -> int:
        return {"energies": 12, "bimolecular": 12, "catalogue": HEADER_BYTES}.get(self.kind, 0)

    @property
    def number(self) -> tuple[str, int] | None:
        """The column that numbers the rows by their place, and how many a record has."""
        return {"events": ("ord", 1), "lattice": ("site_idx", 1), "catalogue": ("reaction_id", LANES)}.get(self.kind)

    def count(self, head: bytes, size: int) -> int:
        """Records of a file, from its first bytes and its size."""
        if self.kind == "events":
            return size // EVENT.itemsize
        if self.kind == "lattice":
            if self.strict and size != self.sites:
                raise FormatError(f"{size} bytes are not {self.sites} sites")
            return self.sites
        if self.kind == "catalogue":
            catalogue_head(head)
            if (size - HEADER_BYTES) % BLOCK_BYTES:
                raise FormatError(f"the body is not a whole number of {BLOCK_BYTES}-byte blocks")
            return (size - HEADER_BYTES) // BLOCK_BYTES
        magic = ENERGY_MAGIC if self.kind == "energies" else BIMOLECULAR_MAGIC
        if len(head) < 12 or head[:8] != magic:
            raise FormatError(f"not a {magic.decode()} file")
        (count,) = struct.unpack_from("<I", head, 8)
        if size < 12 + count * self.layout.itemsize:
            raise FormatError(f"the header counts {count} records; the file has {size} bytes")
        return count

    def columns(self, data: bytes, at: int, n: int) -> dict[str, np.ndarray]:
        """The columns of n records' bytes, the first of which is number `at`."""
        if self.kind == "lattice":
            return {"site_idx": np.arange(at, at + n), "state": np.frombuffer(data.ljust(n, b"\0"), np.uint8).astype(np.int32)}
        rows = np.frombuffer(data, self.layout, n)
        if self.kind == "events":
            real = np.flatnonzero(np.ascontiguousarray(rows["sim_time"]).view("<u8") != 0)
            rows = rows[real]
            return {"ord": real + at, "sim_time": rows["sim_time"].copy(), "site_idx": rows["site_idx"].astype(np.int64), "reaction_id": rows["reaction_id"].astype(np.int32)}
        if self.kind == "catalogue":
            lanes = {x: rows[x].reshape(-1) for x in BLOCK.names}
            real = np.flatnonzero((lanes["rate_q16"] > 0) | self.padding)
            kinds = {"rate_q16": np.int64, "is_bimolecular": np.bool_}
            return {"reaction_id": (real + at * LANES).astype(np.int32)} | {x: lanes[x][real].astype(kinds.get(x, np.int32)) for x in BLOCK.names}
        return {x: rows[x].astype(np.int64 if x == "sid" else np.int32) for x in self.layout.names}

    def batches(self, file: io.RawIOBase | pa.NativeFile, first: int, count: int, begin: int | None = None, keep: list[Filter] = []) -> Iterator[pa.RecordBatch]:  # noqa: B006
        """Records first to first + count - 1 of an open file, whose record 0 is at `begin`; of their rows those that match `keep`."""
        width = self.layout.itemsize
        file.seek((self.begin if begin is None else begin) + first * width)
        chunk = max(1, CHUNK // (self.number[1] if self.number else 1))
        for at in range(first, first + count, chunk):
            n = min(chunk, first + count - at)
            found = self.columns(file.read(n * width), at, n)
            for f in keep:
                fine = _matches(f, found[f.attribute[0]])
                if not fine.all():
                    found = {x: v[fine] for x, v in found.items()}
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found.values()], list(found))


_ORDERED = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def _matches(f: Filter, values: np.ndarray) -> np.ndarray:
    if isinstance(f, In):
        return np.isin(values, np.array([x for x in f.value if x is not None]))
    return _ORDERED[type(f)](values, f.value)


def _may_match(f: Filter, low: float, high: float) -> bool:
    """Whether a value from low to high can match."""
    if isinstance(f, In):
        return any(x is not None and low <= x <= high for x in f.value)
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    return bool(_ORDERED[type(f)](high if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else low, f.value))


def _runs(filters: list[Filter], each: int, count: int) -> list[tuple[int, int]]:
    """(first, count) runs of the `count` records that have rows with these numbers, `each` a record."""
    low, high, ids = 0, count * each - 1, None
    for f in filters:
        if isinstance(f, (EqualTo, In)):
            own = {x for x in (f.value if isinstance(f, In) else (f.value,)) if x is not None}
            ids = own if ids is None else ids & own
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            low = max(low, math.floor(f.value) + 1 if isinstance(f, GreaterThan) else math.ceil(f.value))
        else:
            high = min(high, math.ceil(f.value) - 1 if isinstance(f, LessThan) else math.floor(f.value))
    if ids is None:
        return [(low // each, high // each - low // each + 1)] if low <= high else []
    found: list[tuple[int, int]] = []
    for at in sorted({x // each for x in ids if low <= x <= high}):
        if found and sum(found[-1]) == at:
            found[-1] = (found[-1][0], found[-1][1] + 1)
        else:
            found.append((at, 1))
    return found


@dataclass
class _Slice(InputPartition):
    """Runs (first, count) of a file's records; number: of the record at begin."""

    path: str
    begin: int
    number: int
    runs: list[tuple[int, int]]


class _SliceReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.cut = Slices(options["kind"], int(options["sites"]), options["strict"] == "true", options["padding"] == "true")
        self.path, self.bytes = options["path"], int(options["slice"])
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with a number are used; Spark looks at all filters once more."""
        number = (int, float)
        for f in filters:
            fine = all(isinstance(x, number) or x is None for x in f.value) if isinstance(f, In) else type(f) in _ORDERED and isinstance(f.value, number)
            if fine and len(f.attribute) == 1 and f.attribute[0] not in ("has_real_ea", "is_dissociative", "is_bimolecular"):
                self.filters.append(f)
            yield f

    def _kept(self, count: int, stated: dict | None) -> list[tuple[int, int]]:
        """Runs of a file's records that may match: by their numbers, and by the zones kept of them."""
        runs, number = [(0, count)], self.cut.number
        if number:
            runs = _runs([f for f in self.filters if f.attribute[0] == number[0]], number[1], count)
        zones = (stated or {}).get("zones")
        if not zones:
            return runs
        at = {c: i for i, c in enumerate(stated["columns"])}
        own = [f for f in self.filters if f.attribute[0] in at]
        fine = [(first, n) for first, n, lows, highs in zones if all(_may_match(f, lows[at[f.attribute[0]]], highs[at[f.attribute[0]]]) for f in own)]
        out: list[tuple[int, int]] = []
        for first, n in runs if number else [(0, count)]:
            for x, m in fine:
                low, high = max(first, x), min(first + n, x + m)
                if low < high:
                    if out and sum(out[-1]) == low:
                        out[-1] = (out[-1][0], out[-1][1] + high - low)
                    else:
                        out.append((low, high - low))
        return out

    def partitions(self) -> list[InputPartition]:
        system, path = filesystem(self.path)
        info = system.get_file_info(path)
        named = system.get_file_info(f"{path}/{MANIFEST}").is_file
        found: list[InputPartition] = []
        for f in [info] if info.is_file or named else sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
            if named:
                stated = self._stated(system, f"{path}/{MANIFEST}")
                head, size = bytes.fromhex(stated["head"]), stated["size"]
                pieces = [(f"{path}/{name}", 0, first, n) for first, n, name, _ in stated["parts"]]
            elif f.is_file and not f.base_name.endswith(ZONES) and not f.base_name.startswith((".", "_")):
                stated = self._stated(system, f"{f.path}{ZONES}", f)
                with system.open_input_file(f.path) as opened:
                    head, size = opened.read(HEADER_BYTES), f.size
                pieces = [(f.path, self.cut.begin, 0, None)]
                if stated and (stated["size"], stated["head"]) != (size, head[: len(stated["head"]) // 2].hex()):
                    stated = None
            else:
                continue
            count = self.cut.count(head, size)
            kept = self._kept(count, stated)
            for name, begin, first, n in pieces:
                end = count if n is None else first + n
                found += self._slices(name, begin, first, [(max(x, first), min(x + m, end) - max(x, first)) for x, m in kept if x < end and x + m > first])
        return found or [_Slice("", 0, 0, [])]

    def _stated(self, system: fs.FileSystem, at: str, of: fs.FileInfo | None = None) -> dict | None:
        """What stands in the file at; None without one, or if it is older than the file that it is of."""
        info = system.get_file_info(at)
        if not info.is_file or of and of.mtime_ns and info.mtime_ns < of.mtime_ns:
            return None
        with system.open_input_file(at) as opened:
            return json.loads(opened.read())

    def _slices(self, name: str, begin: int, number: int, runs: list[tuple[int, int]]) -> Iterator[_Slice]:
        """The runs dealt to slices of about as many bytes."""
        step, own, held = max(1, self.bytes // self.cut.layout.itemsize), [], 0
        for first, n in runs:
            while n:
                some = min(n, step - held)
                own.append((first, some))
                first, n, held = first + some, n - some, held + some
                if held == step:
                    yield _Slice(name, begin, number, own)
                    own, held = [], 0
        if own:
            yield _Slice(name, begin, number, own)

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        if partition.runs:
            system, _ = filesystem(self.path)
            begin = partition.begin - partition.number * self.cut.layout.itemsize
            with system.open_input_file(partition.path) as opened:
                for first, count in partition.runs:
                    yield from self.cut.batches(opened, first, count, begin, self.filters)


class SlicedRecords(DataSource):
    """Files of fixed-size records, cut into slices of bytes; options as in Slices, with path and slice (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "sliced_records"

    def reader(self, schema) -> DataSourceReader:
        return _SliceReader(dict(self.options))


def _read(spark: SparkSession, path: str, cut: Slices, schema: str, slice_bytes: int = SLICE) -> DataFrame:
    try:
        system, at = filesystem(path)
        known = system.get_file_info(at).type != fs.FileType.NotFound
    except (pa.ArrowInvalid, OSError):
        known = False
    if known:
        spark.dataSource.register(SlicedRecords)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else filters stay above the source
        options = {"path": path, "kind": cut.kind, "sites": cut.sites, "strict": str(cut.strict).lower(), "padding": str(cut.padding).lower(), "slice": slice_bytes}
        return spark.read.format("sliced_records").schema(schema).options(**options).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                raw = data.as_py()
                yield from cut.batches(io.BytesIO(raw), 0, cut.count(raw[:HEADER_BYTES], len(raw)))

    return _content(spark, path).mapInArrow(run, schema)


def read_energies(spark: SparkSession, path: str) -> DataFrame:
    """schemas.ENERGIES with energy_ev and real_ea_ev; species beyond the eighth are left out."""
    raw = _read(spark, path, Slices("energies"), "species int, energy_mev int, sid long, has_real_ea int, real_ea_mev int, metal int, facet int")
    known = raw.where(F.col("species") < MAX_SPECIES).withColumn("real_ea_mev", F.when(F.col("has_real_ea") != 0, F.col("real_ea_mev"))).drop("has_real_ea")
    return known.withColumn("energy_ev", ev_from_mev(F.col("energy_mev"))).withColumn("real_ea_ev", ev_from_mev(F.col("real_ea_mev")))


def read_bimolecular(spark: SparkSession, path: str) -> DataFrame:
    """schemas.BIMOLECULAR with energy_ev and ea_ev; records that name species beyond the eighth are left out."""
    raw = _read(spark, path, Slices("bimolecular"), "species_a int, species_b int, energy_mev int, sid long, ea_mev int, metal int, facet int, is_dissociative int")
    known = raw.where((F.col("species_a") < MAX_SPECIES) & (F.col("species_b") < MAX_SPECIES)).withColumn("is_dissociative", F.col("is_dissociative") != 0)
    return known.withColumn("energy_ev", ev_from_mev(F.col("energy_mev"))).withColumn("ea_ev", ev_from_mev(F.col("ea_mev")))


def read_catalogue(spark: SparkSession, path: str, padding: bool = False, slice_bytes: int = SLICE) -> Catalogue:
    """A catalogue; only its header comes here. padding: keep the lanes with rate 0 that fill the last block.

    Filters of the reactions by reaction_id read the blocks asked for only.
    """
    try:
        system, at = filesystem(path)
        named = system.get_file_info(f"{at}/{MANIFEST}").is_file
        with system.open_input_file(f"{at}/{MANIFEST}" if named else at) as opened:
            head = bytes.fromhex(json.loads(opened.read())["head"]) if named else opened.read(HEADER_BYTES)
    except (pa.ArrowInvalid, OSError):
        head = bytes(_content(spark, path).select(F.substring("content", 1, HEADER_BYTES)).first()[0])
    kind, species = catalogue_head(head)
    return Catalogue(kind, species, _read(spark, path, Slices("catalogue", padding=padding), REACTIONS, slice_bytes))


def read_lattice(spark: SparkSession, path: str, width: int, height: int, strict: bool = False) -> DataFrame:
    """schemas.LATTICE of width x height sites; bytes that a short file lacks are vacant, an error if strict. A missing file needs empty_lattice."""
    return _read(spark, path, Slices("lattice", width * height, strict), LATTICE)


def empty_lattice(spark: SparkSession, width: int, height: int) -> DataFrame:
    if not 0 < width * height < 2**32:
        raise FormatError(f"a lattice has 1 to 2^32 - 1 sites, not {width} x {height}")
    return spark.range(width * height).select(F.col("id").alias("site_idx"), F.lit(0).alias("state"))


def read_trajectory(spark: SparkSession, path: str, slice_bytes: int = SLICE) -> DataFrame:
    """schemas.EVENTS; ord is the record's place in the file. Records of time 0 fill pages and are left out, as is a broken last one."""
    return _read(spark, path, Slices("events"), EVENTS, slice_bytes)


def _write(df: DataFrame, path: str, layout: np.dtype, order: list[str], head=lambda count: b"", tail: int = 0, zoned: tuple[str, ...] = (), parts: str = "auto", zone: int = ZONE) -> int:
    """The rows of df in order as packed records, then zeros up to a multiple of `tail` bytes; returns how many rows. zoned: columns that zones are kept of."""
    names, width = list(layout.names), layout.itemsize
    placed = numbered(df.select(*dict.fromkeys([*names, *order])), order, "_place")
    count = placed.count()
    before, step = len(head(count)), max(1, zone // width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("_place").to_numpy(zero_copy_only=False) - 1
            cuts = [0, *(np.flatnonzero((np.diff(place) != 1) | (place[1:] % step == 0)) + 1).tolist(), len(place)] if len(place) else [0]
            made = np.zeros(len(place), layout)
            for c in names:
                kind = np.float64 if layout[c].kind == "f" else np.int64
                made[c] = batch.column(c).to_numpy(zero_copy_only=False).astype(kind).astype(layout[c], casting="unsafe")
            rows = [(int(place[x]), made[x:y]) for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([before + at * width for at, _ in rows], pa.int64()), pa.array([own.tobytes() for _, own in rows], pa.binary()), pa.array([at for at, _ in rows], pa.int64()), pa.array([len(own) for _, own in rows], pa.int64()),
                    *(pa.array([[float(f(own[c])) for c in zoned] for _, own in rows], pa.list_(pa.float64())) for f in (np.min, np.max)),
                ],
                ["at", "data", "first", "count", "lows", "highs"],
            )

    if count or before or tail:
        whole = before + count * width
        write_placed(placed.mapInArrow(pack, PLACED), path, head(count), whole + (-whole % tail if tail else 0), count * width, list(zoned), parts, zone)
    return count


def _counted(magic: bytes):
    return lambda count: magic + struct.pack("<I", count)


def write_energies(df: DataFrame, path: str, by: list[str] = [], parts: str = "auto", zone: int = ZONE) -> int:  # noqa: B006
    """One file of energy records ordered by sid, or first by the columns of `by`, which lets filters on these pass by more of it; returns how many.

    parts: one, parts or auto, as in sources.placed; zone: bytes that statistics are kept of.
    """
    ready = df.withColumn("has_real_ea", F.col("real_ea_mev").isNotNull().cast("int")).withColumn("real_ea_mev", F.coalesce("real_ea_mev", F.lit(0))).withColumn("sid", F.col("sid").bitwiseAND(F.lit(0xFFFFFFFF)))
    return _write(ready, path, ENERGY, [*by, "sid", "species", "energy_mev"], _counted(ENERGY_MAGIC), zoned=("species", "sid", "metal", "facet"), parts=parts, zone=zone)


def write_bimolecular(df: DataFrame, path: str, by: list[str] = [], parts: str = "auto", zone: int = ZONE) -> int:  # noqa: B006
    """One file of bimolecular records, as write_energies; none is written without records."""
    ready = df.withColumn("is_dissociative", F.col("is_dissociative").cast("int")).withColumn("sid", F.col("sid").bitwiseAND(F.lit(0xFFFFFFFF)))
    head = lambda count: _counted(BIMOLECULAR_MAGIC)(count) if count else b""
    return _write(ready, path, BIMOLECULAR, [*by, "sid", "species_a", "species_b", "energy_mev"], head, zoned=("species_a", "species_b", "sid", "metal", "facet"), parts=parts, zone=zone)


def default_bimolecular_path(path: str) -> str:
    """Where bimolecular records go beside the energy records in path."""
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}_bimolecular.{suffix}" if dot else f"{path}_bimolecular"


def write_catalogue(reactions: DataFrame, path: str, kind: str, species: list[tuple[int, str]], parts: str = "auto") -> int:
    """One catalogue file, lanes by reaction_id, those that no reaction has with rate 0; returns the blocks.

    A block is packed by the task that has its reactions, and put at its place.
    """
    head = species_header(kind, species)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted; the block that a batch ends in waits for the next."""
        rest: pa.Table | None = None

        def packed(rows: pa.Table) -> pa.RecordBatch:
            number = rows.column("block").to_numpy()
            blocks, at = np.unique(number, return_inverse=True)
            made = np.zeros(len(blocks), PADDED)
            for n in BLOCK.names:
                made[n][at, rows.column("lane").to_numpy()] = rows.column(n).to_numpy().astype(np.int64).astype(BLOCK[n].base)
            nothing = pa.array([[]] * len(blocks), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(HEADER_BYTES + blocks * BLOCK_BYTES), pa.array([made[i : i + 1].tobytes() for i in range(len(blocks))], pa.binary()), pa.array(blocks), pa.array(np.ones(len(blocks), np.int64)), nothing, nothing], ["at", "data", "first", "count", "lows", "highs"])

        for batch in batches:
            rows = pa.concat_tables([*([rest] if rest else []), pa.Table.from_batches([batch])])
            if rows.num_rows:
                last = rows.column("block").to_numpy() == rows.column("block")[-1].as_py()
                cut = int(np.argmax(last))
                if cut:
                    yield packed(rows.slice(0, cut))
                rest = rows.slice(cut)
        if rest:
            yield packed(rest)

    block, lane = F.floor(F.col("reaction_id") / LANES).cast("long"), (F.col("reaction_id") % LANES).cast("int")
    own = stage(reactions.select(block.alias("block"), lane.alias("lane"), *BLOCK.names), "lanes")
    last = own.agg(F.max("block")).first()[0]
    count = 0 if last is None else last + 1
    lanes = own.repartitionByRange("block").sortWithinPartitions("block", "lane")
    write_placed(lanes.mapInArrow(pack, PLACED), path, head, HEADER_BYTES + count * BLOCK_BYTES, layout=parts)
    return count


def write_lattice(lattice: DataFrame, path: str, size: int, parts: str = "auto") -> None:
    """One byte for each of size sites in order; sites that the rows lack are vacant."""
    sites = lattice.sparkSession.range(size).select(F.col("id").alias("site_idx"))
    known = lattice.where(F.col("site_idx") < size).select("site_idx", F.col("state").bitwiseAND(F.lit(255)).alias("state"))
    whole = sites.join(known, "site_idx", "left").fillna(VACANT, ["state"])
    _write(whole.select("site_idx", "state").withColumnRenamed("site_idx", "_site"), path, np.dtype([("state", "u1")]), ["_site"], parts=parts)


def write_trajectory(events: DataFrame, path: str, parts: str = "auto", zone: int = ZONE) -> None:
    """Records in the order of ord, the last page filled with zeros."""
    _write(events, path, EVENT, ["ord"], tail=PAGE_BYTES, zoned=("sim_time", "site_idx", "reaction_id"), parts=parts, zone=zone)
