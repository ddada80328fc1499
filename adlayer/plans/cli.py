"""Command lines over the library: build a catalogue, replay an event log, and land raw records."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, lattice, records, replay, report
from ..schemas import METALS
from ..sources import binary, config, landing


def _session() -> SparkSession:
    return SparkSession.builder.appName("adlayer").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _species(own: config.Config, spark: SparkSession) -> DataFrame:
    return own.species_frame(spark).select(F.col("idx").alias("species"), "bit", "role")


def build(args: argparse.Namespace, spark: SparkSession) -> None:
    """Energy records and a configuration to a catalogue. Options win over the configuration."""
    own = config.load(spark, args.config)
    for name in ("alpha", "beta", "nu", "temperature"):
        if getattr(args, name) is not None:
            setattr(own, name, getattr(args, name))
    metal = args.metal or own.metal
    if metal is not None and metal not in METALS[1:]:
        raise config.ConfigError(f"unknown metal `{metal}`; known: {', '.join(METALS[1:])}")
    facet = own.facet if args.facet is None else args.facet
    if facet is not None and metal is None:
        print("the facet is ignored without a metal", file=sys.stderr)
    energies = records.require_rows(binary.read_energies(spark, args.input), args.input)
    if args.bimolecular_input:
        pairs = binary.read_bimolecular(spark, args.bimolecular_input)
    else:
        pairs = spark.createDataFrame([], "species_a int, species_b int, energy_mev int, sid long, ea_mev int, metal int, facet int, is_dissociative boolean")
    kinetics = catalogue.Kinetics(own.alpha, own.beta, own.nu, own.temperature)
    made = catalogue.build(energies, pairs, _species(own, spark), metal and METALS.index(metal), facet, kinetics).cache()
    records.species_counts(energies, _species(own, spark)).show()
    catalogue.category_counts(made).show()
    print(binary.write_catalogue(made, args.output, "gated", [(s.bit, s.name) for s in own.species]), "blocks")


def coverage(args: argparse.Namespace, spark: SparkSession) -> None:
    """A trajectory file and its catalogue to coverage over time, as CSV."""
    read = binary.read_catalogue(spark, args.catalogue, padding=True)
    species = [(n, b) for b, n in read.species]
    rows = replay.coverage(binary.read_trajectory(spark, args.trajectory), read.reactions, species, args.width * args.height, args.sample_every, not args.as_recorded, bits=[1 << i for i in range(8)])
    report.write_coverage_csv(rows, args.output)


def land(args: argparse.Namespace, spark: SparkSession) -> None:
    """Landed JSON pages to files of energy and bimolecular records."""
    own = config.load(spark, args.config)
    nodes = landing.read_pages(spark, args.pages, args.metal, args.facet)
    found = landing.clean_adsorptions(nodes, own, args.limit_per_species)
    if not args.skip_real_barriers:
        matched = landing.categorised(nodes, own).cache()
        landing.upsert_counts(found, landing.barriers(matched)).show()
        found = landing.upsert(found, landing.barriers(matched))
        print(binary.write_bimolecular(landing.two_site(matched), binary.default_bimolecular_path(args.output)), "bimolecular records")
    print(binary.write_energies(found, args.output), "records")


def demo(args: argparse.Namespace, spark: SparkSession) -> None:
    """A made-up static catalogue."""
    print(binary.write_catalogue(catalogue.demo_catalogue(spark, args.count), args.output, "static", []), "blocks")


def snapshot(args: argparse.Namespace, spark: SparkSession) -> None:
    """A lattice file as a table of labelled tile centres."""
    own = config.load(spark, args.config)
    sites = binary.read_lattice(spark, args.lattice, args.width, args.height, strict=True)
    named = {s.bit: s.name for s in own.species}
    report.hex_layout(sites, args.width, named).write.mode("overwrite").parquet(args.output)
    print(lattice.corrupt_sites(sites, sum(named)).count(), "corrupt sites")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="adlayer")
    sub = top.add_subparsers(required=True)

    def command(f, *required: str, sized: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        for name in (*required, "output"):
            p.add_argument(f"--{name}", required=True)
        if sized:
            p.add_argument("--width", type=int, required=True)
            p.add_argument("--height", type=int, required=True)
        return p

    p = command(build, "input", "config")
    p.add_argument("--bimolecular-input")
    p.add_argument("--metal")
    p.add_argument("--facet", type=int)
    for name in ("alpha", "beta", "nu", "temperature"):
        p.add_argument(f"--{name}", type=float)
    p = command(coverage, "trajectory", "catalogue", sized=True)
    p.add_argument("--sample-every", type=int, default=10_000)
    p.add_argument("--as-recorded", action="store_true", help="apply the first transition to both rows of a two-site event")
    p = command(land, "pages", "config")
    p.add_argument("--metal")
    p.add_argument("--facet")
    p.add_argument("--limit-per-species", type=int)
    p.add_argument("--skip-real-barriers", action="store_true")
    command(demo).add_argument("--count", type=int, default=1024)
    command(snapshot, "lattice", "config", sized=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(args, _session())
    except (config.ConfigError, binary.FormatError, ValueError) as e:
        print(f"adlayer: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
