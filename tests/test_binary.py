"""Binary files: round trips, what readers reject, and any bytes."""

from __future__ import annotations

import io
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from adlayer.schemas import BIMOLECULAR, ENERGIES, EVENTS
from adlayer.sources import binary as b
from adlayer.sources import placed

SPECIES = [(1, "O"), (4, "H"), (2, "CO"), (8, "OH"), (16, "H2O")]


def test_energies(spark, tmp_path):
    rows = [(0, -1500, 7, None, 1, 111), (2, 250, 2**32 + 5, 300, 0, 0), (7, -1, 3, -2, 12, 65535)]
    path = str(tmp_path / "e.bin")
    assert b.write_energies(spark.createDataFrame(rows, ENERGIES), path) == 3
    got = {r["sid"]: r for r in b.read_energies(spark, path).collect()}
    assert set(got) == {7, 5, 3} and got[7]["real_ea_mev"] is None and got[7]["energy_ev"] == -1.5
    assert (got[5]["real_ea_ev"], got[3]["real_ea_mev"], got[3]["facet"]) == (0.3, -2, 65535)
    data = (tmp_path / "e.bin").read_bytes()
    assert len(data) == 12 + 3 * 17
    (tmp_path / "more.bin").write_bytes(data + b"tail")
    assert b.read_energies(spark, str(tmp_path / "more.bin")).count() == 3
    (tmp_path / "short.bin").write_bytes(data[:-1])
    with pytest.raises(PySparkException, match="counts 3 records"):
        b.read_energies(spark, str(tmp_path / "short.bin")).count()
    ninth = b.ENERGY_MAGIC + struct.pack("<I", 1) + struct.pack("<BiIBiBH", 8, 1, 1, 0, 0, 0, 0)
    (tmp_path / "ninth.bin").write_bytes(ninth)
    assert b.read_energies(spark, str(tmp_path / "ninth.bin")).count() == 0


def test_bimolecular(spark, tmp_path):
    rows = [(0, 2, -980, 42, 1000, 1, 111, False), (1, 3, 220, 43, 1011, 1, 0, True)]
    path = str(tmp_path / "x.bin")
    assert b.default_bimolecular_path(path).endswith("x_bimolecular.bin")
    assert b.write_bimolecular(spark.createDataFrame(rows, BIMOLECULAR), path) == 2
    got = b.read_bimolecular(spark, path).orderBy("sid").collect()
    assert [(r["species_a"], r["species_b"], r["ea_ev"], r["is_dissociative"]) for r in got] == [(0, 2, 1.0, False), (1, 3, 1.011, True)]
    assert b.write_bimolecular(spark.createDataFrame([], BIMOLECULAR), str(tmp_path / "none.bin")) == 0 and not (tmp_path / "none.bin").exists()


def test_catalogue(spark, tmp_path):
    rows = [(i, 2**32 - 1 - i, i % 4, 256 * (i % 3) + 1, 2, i % 2 == 0) for i in range(34)]
    df = spark.createDataFrame(rows, "reaction_id int, rate_q16 long, bin_id int, transition_a int, transition_b int, is_bimolecular boolean")
    path = str(tmp_path / "lut.bin")
    assert b.write_catalogue(df, path, "gated", SPECIES) == 2
    assert len((tmp_path / "lut.bin").read_bytes()) == 64 + 2 * 320
    got = b.read_catalogue(spark, path)
    assert (got.kind, got.species) == ("gated", SPECIES) and sorted(got.reactions.collect()) == sorted(df.collect())
    assert b.read_catalogue(spark, path, padding=True).reactions.count() == 64


@pytest.mark.parametrize(
    "header",
    [bytes([9]), bytes([1, 3, 1]) + b"O", bytes([2, 1, 1]) + b"O" + bytes([1, 1]) + b"P", bytes([2, 1, 1]) + b"O" + bytes([2, 1]) + b"O", bytes([1, 1, 200]), bytes([1, 1, 2, 0xFF, 0xFE])],
)
def test_bad_headers(header):
    with pytest.raises(b.FormatError):
        b.catalogue_head((b"KMCOCC01" + header).ljust(64, b"\0"))


@given(st.binary(max_size=400))
def test_any_bytes_parse_or_are_rejected(data):
    def read_all(kind, d):
        cut = b.Slices(kind, sites=50)
        return list(cut.batches(io.BytesIO(d), 0, cut.count(d[:64], len(d))))

    for read in (lambda d: read_all("energies", d), lambda d: read_all("bimolecular", b.BIMOLECULAR_MAGIC + d), lambda d: read_all("events", d), lambda d: read_all("lattice", d), lambda d: read_all("catalogue", b"KMCSTAT1" + d)):
        try:
            read(data)
        except b.FormatError:
            pass


def test_lattice(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (5, 16), (3, 128)], "site_idx long, state int")
    path = str(tmp_path / "l.bin")
    b.write_lattice(df, path, 6)
    assert (tmp_path / "l.bin").read_bytes() == bytes([0, 2, 0, 128, 0, 16])
    assert {r["site_idx"]: r["state"] for r in b.read_lattice(spark, path, 4, 2).collect()} == {0: 0, 1: 2, 2: 0, 3: 128, 4: 0, 5: 16, 6: 0, 7: 0}
    assert b.read_lattice(spark, path, 3, 2, strict=True).count() == 6
    with pytest.raises(PySparkException, match="not 8 sites"):
        b.read_lattice(spark, path, 4, 2, strict=True).count()
    assert b.empty_lattice(spark, 3, 2).where("state = 0").count() == 6
    with pytest.raises(b.FormatError):
        b.empty_lattice(spark, 2**16, 2**16)


def test_trajectory(spark, tmp_path):
    path = str(tmp_path / "t.bin")
    b.write_trajectory(spark.createDataFrame([(0, 1.5, 7, 3), (1, 1.5, 8, 3)], EVENTS), path)
    assert len((tmp_path / "t.bin").read_bytes()) == 4096
    assert sorted(map(tuple, b.read_trajectory(spark, path).collect())) == [(0, 1.5, 7, 3), (1, 1.5, 8, 3)]
    (tmp_path / "broken.bin").write_bytes(struct.pack("<dII", 2.0, 1, 1) + b"\1" * 9)
    assert b.read_trajectory(spark, str(tmp_path / "broken.bin")).count() == 1


def test_a_file_is_read_in_slices(spark, tmp_path):
    path = str(tmp_path / "long.bin")
    rows = spark.range(5000).selectExpr("id AS ord", "cast(id % 7 AS double) AS sim_time", "id % 11 AS site_idx", "cast(id % 3 AS int) AS reaction_id")
    b.write_trajectory(rows.repartition(5), path)
    got = b.read_trajectory(spark, path, slice_bytes=16 * 700)
    assert got.rdd.getNumPartitions() == -(-(5000 * 16 + 4096 - 5000 * 16 % 4096) // (16 * 700))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.where("sim_time <> 0").collect()))
    assert not list(tmp_path.glob("*.parts*"))
    assert not [x for x in tmp_path.iterdir() if x.name.startswith(".")]


def reader(path, kind, filters, slice_bytes=1 << 20, sites=0):
    made = b._SliceReader({"kind": kind, "sites": str(sites), "strict": "false", "padding": "false", "path": path, "slice": str(slice_bytes)})
    assert list(made.pushFilters(filters)) == filters  # Spark looks at them once more
    return made


def records_of(parts):
    return sum(n for p in parts for _, n in p.runs)


@pytest.mark.parametrize("layout", ["one", "parts"])
def test_filters_pass_by_slices(spark, tmp_path, layout):
    """Slices that can't match are not opened; the rows are those that Spark's filter leaves."""
    path = str(tmp_path / "e.bin")
    rows = spark.range(6000).selectExpr("cast(id % 7 AS int) AS species", "cast(id AS int) AS energy_mev", "id AS sid", "cast(NULL AS int) AS real_ea_mev", "cast(id % 13 AS int) AS metal", "cast(id % 3 * 10 AS int) AS facet")
    assert b.write_energies(rows.repartition(6), path, by=["metal", "facet"], parts=layout, zone=17 * 100) == 6000
    whole = b.read_energies(spark, path)
    assert sorted(map(tuple, whole.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    for condition in ("metal = 3", "metal in (1, 12) and facet = 20", "sid < 500", "sid >= 5990 and species > 5", "metal = 99", "facet <= 0 or sid = 7"):
        got = whole.where(condition).select(rows.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.where(condition).collect())), condition
    opened = lambda *filters: records_of(reader(path, "energies", list(filters)).partitions())
    assert opened() == 6000 and opened(b.EqualTo(("metal",), 99)) == 0
    assert 460 <= opened(b.EqualTo(("metal",), 3)) <= 800
    assert opened(b.In(("metal",), (1, 12)), b.EqualTo(("facet",), 20)) < 800
    plan = whole.where("metal = 3")._jdf.queryExecution().executedPlan().toString()
    assert "metal" in plan and whole.where("metal = 99").rdd.getNumPartitions() == 1
    assert whole.where("metal = 3").rdd.getNumPartitions() <= whole.rdd.getNumPartitions()


def test_zones_of_another_file_do_not_count(spark, tmp_path):
    path = str(tmp_path / "e.bin")
    rows = spark.createDataFrame([(1, 5, 7, None, 1, 0)], ENERGIES)
    b.write_energies(rows, path)
    assert records_of(reader(path, "energies", [b.EqualTo(("metal",), 2)]).partitions()) == 0
    data = bytearray((tmp_path / "e.bin").read_bytes())
    data[-3] = 2  # the metal
    (tmp_path / "e.bin").write_bytes(data)
    assert b.read_energies(spark, path).where("metal = 2").count() == 1
    b.write_energies(rows.withColumn("metal", F.lit(4)), path)
    assert b.read_energies(spark, path).where("metal = 4").count() == 1


def test_numbers_become_places(spark, tmp_path):
    """Reads by id open the blocks asked for."""
    rows = [(i, 1 + i % 5, i % 4, 256, 0, False) for i in range(3000) if not 640 <= i < 704]
    df = spark.createDataFrame(rows, "reaction_id int, rate_q16 long, bin_id int, transition_a int, transition_b int, is_bimolecular boolean").repartition(4)
    for layout in ("one", "parts"):
        path = str(tmp_path / f"lut-{layout}")
        assert b.write_catalogue(df, path, "gated", SPECIES, parts=layout) == 94
        got = b.read_catalogue(spark, path).reactions
        assert sorted(map(tuple, got.collect())) == rows
        for condition in ("reaction_id in (5, 2999, 650, 70)", "reaction_id > 2990", "reaction_id < 3", "reaction_id >= 31 and reaction_id <= 32", "reaction_id = 4000"):
            assert sorted(map(tuple, got.where(condition).collect())) == sorted(map(tuple, df.where(condition).collect())), condition
    opened = lambda *filters: records_of(reader(str(tmp_path / "lut-one"), "catalogue", list(filters)).partitions())
    assert opened(b.In(("reaction_id",), (5, 2999, 6, 70))) == 3 and opened(b.EqualTo(("reaction_id",), 94 * 32)) == 0
    assert opened(b.GreaterThan(("reaction_id",), 31), b.LessThanOrEqual(("reaction_id",), 64)) == 2 and opened() == 94
    events = spark.range(5000).selectExpr("id AS ord", "1.0 + id AS sim_time", "id % 11 AS site_idx", "cast(id % 3 AS int) AS reaction_id")
    b.write_trajectory(events, str(tmp_path / "t.bin"), zone=16 * 500)
    late = b.read_trajectory(spark, str(tmp_path / "t.bin"))
    assert late.where("ord between 10 and 12").count() == 3 and late.where("sim_time > 4998").count() == 2
    assert records_of(reader(str(tmp_path / "t.bin"), "events", [b.GreaterThan(("sim_time",), 4998.0)]).partitions()) <= 500
    assert b.read_lattice(spark, str(tmp_path / "t.bin"), 100, 10).where("site_idx in (3, 900)").count() == 2


@pytest.mark.parametrize("layout", ["one", "parts"])
def test_a_failed_write_leaves_nothing(spark, tmp_path, layout):
    path = tmp_path / "e.bin"
    fine = spark.createDataFrame([(1, 5, 7, None, 1, 0)], ENERGIES)
    b.write_energies(fine, str(path), parts=layout)
    before = sorted(x.name for x in tmp_path.rglob("*"))
    rows = spark.range(1000).selectExpr("16 + id AS at", "cast('x' AS binary) AS data", "id AS first", "1L AS count", "cast(array() AS array<double>) AS lows", "cast(array() AS array<double>) AS highs")
    broken = rows.withColumn("at", F.when(F.col("first") == 999, F.raise_error(F.lit("broken"))).otherwise(F.col("at")).cast("long"))
    for bad, content in ((broken, 1000), (rows, 999)):
        with pytest.raises(PySparkException):
            placed.write_placed(bad, str(path), b"", 1016, content, layout=layout)
        if layout == "one":  # killed tasks may leave a part, which the next write deletes
            assert sorted(x.name for x in tmp_path.rglob("*")) == before
        assert b.read_energies(spark, str(path)).count() == 1
    b.write_energies(fine.union(fine), str(path), parts=layout)
    assert b.read_energies(spark, str(path)).count() == 2 and len(list(tmp_path.rglob("*"))) == len(before)


def test_rows_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    """The writers collect nothing but counts."""
    rows = spark.range(2000).selectExpr("id AS ord", "1.0 + id AS sim_time", "id AS site_idx", "cast(0 AS int) AS reaction_id").repartition(3)
    monkeypatch.setattr(type(rows), "collect", lambda self: pytest.fail("collected"))
    monkeypatch.setattr(type(rows), "toArrow", lambda self: pytest.fail("collected"))
    b.write_trajectory(rows, str(tmp_path / "t.bin"))
    assert len((tmp_path / "t.bin").read_bytes()) == 32768
