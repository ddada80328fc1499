"""Command lines from files to files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from adlayer.plans import cli
from adlayer.plans.queries import CONFIG
from adlayer.schemas import BIMOLECULAR, ENERGIES
from adlayer.sources import binary


def test_build_and_replay(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "c.conf").write_text(CONFIG)
    rows = [(s, -10 * i, 100 * s + i, None, 5, 211) for s, n in ((0, 6), (1, 9), (2, 3), (4, 4)) for i in range(n)]
    binary.write_energies(spark.createDataFrame(rows, ENERGIES), at("e.bin"))
    binary.write_bimolecular(spark.createDataFrame([(1, 3, 10, i, 900, 5, 211, True) for i in range(2)], BIMOLECULAR), at("b.bin"))
    build = ["build", "--config", at("c.conf"), "--output", at("lut.bin")]
    assert cli.main([*build, "--input", at("e.bin"), "--bimolecular-input", at("b.bin")]) == 0
    made = binary.read_catalogue(spark, at("lut.bin"))
    assert made.kind == "gated" and made.reactions.count() == 34 and len(made.species) == 5
    assert cli.main([*build, "--input", at("e.bin"), "--metal", "Unobtainium"]) == 1
    sized = ["--width", "8", "--height", "8"]
    assert cli.main(["demo", "--count", "40", "--output", at("demo.bin")]) == 0
    log = spark.range(200).select(F.col("id").alias("ord"), (F.col("id") / 10 + 1).alias("sim_time"), (F.col("id") * 7 % 64).alias("site_idx"), (F.col("id") % 40).cast("int").alias("reaction_id"))
    binary.write_trajectory(log, at("t.bin"))
    assert cli.main(["coverage", "--trajectory", at("t.bin"), "--catalogue", at("demo.bin"), "--output", at("cov"), *sized, "--sample-every", "50"]) == 0
    rows = spark.read.csv(at("cov"), header=True, inferSchema=True)
    assert rows.columns[:3] == ["event", "sim_time", "vacant"] and rows.orderBy("event").first()["vacant"] == 64


def test_land_and_snapshot(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "c.conf").write_text(CONFIG)
    node = {"id": "UmVhY3Rpb246MQ==", "reactants": '{"Nstar": 2}', "products": '{"N2gas": 1}', "reactionEnergy": 0.1, "activationEnergy": 0.35, "surfaceComposition": "Pd", "facet": "111"}
    clean = node | {"id": "UmVhY3Rpb246Mg==", "reactants": '{"star": 1, "NOgas": 1}', "products": '{"NOstar": 1}', "activationEnergy": None}
    (tmp_path / "p.json").write_text(json.dumps({"data": {"reactions": {"pageInfo": {"hasNextPage": False, "endCursor": ""}, "edges": [{"node": node}, {"node": clean}]}}}))
    assert cli.main(["land", "--pages", at("p.json"), "--config", at("c.conf"), "--output", at("e.bin")]) == 0
    assert binary.read_energies(spark, at("e.bin")).count() == 1 and binary.read_bimolecular(spark, at("e_bimolecular.bin")).count() == 1
    (tmp_path / "l.bin").write_bytes(bytes([0, 2, 3, 32]))
    assert cli.main(["snapshot", "--lattice", at("l.bin"), "--config", at("c.conf"), "--output", at("s"), "--width", "2", "--height", "2"]) == 0
    assert {r["label"] for r in spark.read.parquet(at("s")).collect()} == {"vacant", "O", "corrupt", "NH3"}
