"""The test tables read as energy records, two-site records, a lattice and an event log; each also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BITS = [1, 2, 4, 8, 16, 32]
ROLES = ["dissociative", "molecular", "dissociative", "product_only", "molecular", "molecular"]
METAL, FACET = "Brand#12", 11
WIDTH, PATCHES = 50, 4
#: A gated catalogue for the order lattice: rate, bin, transition_a, transition_b, two sites.
TEMPLATES = [(900, 0, 1, 0, False), (800, 1, 1, 0, False), (700, 2, 2, 0, False), (600, 0, 256, 0, False), (500, 3, 512, 0, False), (400, 0, 256, 512, True), (300, 0, 1, 1, True), (200, 0, 512, 512, True), (100, 0, 1, 2, True)]
#: What each type of event does to its site, as a packed transition; errors leave two bits.
EVENT_TRANSITIONS = {"view": 1, "click": 2, "purchase": 256, "signup": 512, "error": 3 * 256 + 5}
EVERY = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = (F.round("p_retailprice") - 1000).cast("int")
    raw = table(spark, sf_dir, "part").select(F.col("p_type").alias("species"), e.alias("energy_mev"), F.col("p_partkey").alias("sid"), F.col("p_brand").alias("metal"), F.col("p_size").alias("facet"))
    return raw.withColumn("real_ea_mev", F.when(F.col("sid") % 7 == 0, F.abs("energy_mev") + 150))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda i: F.element_at(F.array(*map(F.lit, TYPES)), (i % 6 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        name(F.col("s_nationkey")).alias("species_a"),
        name(F.col("s_suppkey")).alias("species_b"),
        (F.round(F.col("s_acctbal") / 10) - 300).cast("int").alias("energy_mev"),
        F.col("s_suppkey").alias("sid"),
        F.abs(F.round(F.col("s_acctbal") / 8)).cast("int").alias("ea_mev"),
        F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 25 + 1).cast("string")).alias("metal"),
        (F.col("s_suppkey") % 50 + 1).cast("int").alias("facet"),
        (F.col("s_suppkey") % 3 == 0).alias("is_dissociative"),
    )


def species(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(zip(TYPES, BITS, ROLES)), "species string, bit int, role string")


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("site_idx"), state.alias("state"))


def height(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "orders").count() // WIDTH


def sites(spark: SparkSession, sf_dir: str) -> int:
    """Sites of the event log: as many as its largest number asks for."""
    return table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1


def lattice_species(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("O", 1), ("CO", 2)], "species string, bit int")


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "reaction_id int, rate_q16 long, bin_id int, transition_a int, transition_b int, is_bimolecular boolean")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in EVENT_TRANSITIONS.items()))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), seconds.alias("sim_time"), F.col("user_id").alias("site_idx"), t.alias("transition"))


RECORDS_SQL = """records AS (
  SELECT p_type AS species, (round(p_retailprice) - 1000)::INT AS energy_mev, p_partkey AS sid, p_brand AS metal, p_size AS facet,
         CASE WHEN p_partkey % 7 = 0 THEN abs((round(p_retailprice) - 1000)::INT) + 150 END AS real_ea_mev
  FROM part)"""
SITES_SQL = "(SELECT MAX(user_id) + 1 FROM events)"
_NAMES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
PAIRS_SQL = f"""pairs AS (
  SELECT ({_NAMES})[s_nationkey % 6 + 1] AS species_a, ({_NAMES})[s_suppkey % 6 + 1] AS species_b,
         (round(s_acctbal / 10) - 300)::INT AS energy_mev, s_suppkey AS sid, abs(round(s_acctbal / 8))::INT AS ea_mev,
         'Brand#' || (s_nationkey % 25 + 1) AS metal, (s_suppkey % 50 + 1)::INT AS facet, s_suppkey % 3 = 0 AS is_dissociative
  FROM supplier)"""
SPECIES_SQL = "species AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {b}, '{r}')" for t, b, r in zip(TYPES, BITS, ROLES)) + ") AS v(species, bit, role))"
LATTICE_SQL = f"""size AS (SELECT COUNT(*) // {WIDTH} AS height FROM orders),
bands AS (SELECT height, (height + LEAST({PATCHES}, height) - 1) // LEAST({PATCHES}, height) AS band FROM size),
placed AS (
  SELECT o_orderkey AS site_idx, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS state,
         (o_orderkey // {WIDTH}) // band AS patch_id, (o_orderkey // {WIDTH}) % band AS row, o_orderkey % {WIDTH} AS col,
         ((o_orderkey // {WIDTH}) % band) * {WIDTH} + o_orderkey % {WIDTH} AS site,
         LEAST(band, height - ((o_orderkey // {WIDTH}) // band) * band) AS rows
  FROM orders, bands)"""
DELTAS_SQL = """deltas AS (SELECT * FROM (VALUES (0, 0, -1), (0, 1, -1), (1, 0, 1), (1, 1, 1), (2, 0, -1), (2, 1, 0), (3, 0, 0), (3, 1, 1), (4, 0, -1), (4, 1, 0), (5, 0, 0), (5, 1, 1)) AS v(ord, parity, dcol)),
steps AS (SELECT ord, parity, dcol, CASE WHEN ord IN (2, 3) THEN -1 WHEN ord IN (4, 5) THEN 1 ELSE 0 END AS drow FROM deltas)"""
EDGES_SQL = LATTICE_SQL + ",\n" + DELTAS_SQL + f""",
edges AS (
  SELECT p.patch_id, p.site AS a, p.state AS state_a, s.ord, (p.row + s.drow) * {WIDTH} + p.col + s.dcol AS b
  FROM placed p JOIN steps s ON p.row % 2 = s.parity
  WHERE p.row + s.drow BETWEEN 0 AND p.rows - 1 AND p.col + s.dcol BETWEEN 0 AND {WIDTH} - 1),
edge_states AS (SELECT e.*, q.state AS state_b FROM edges e JOIN placed q ON q.patch_id = e.patch_id AND q.site = e.b)"""
TEMPLATES_SQL = "templates AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {r}, {b}, {x}, {y}, {str(t).lower()})" for i, (r, b, x, y, t) in enumerate(TEMPLATES)) + ") AS v(reaction_id, rate_q16, bin_id, transition_a, transition_b, is_bimolecular))"
EVENTS_SQL = "log AS (SELECT event_id AS ord, epoch_us(ts) / 1e6 AS sim_time, user_id AS site_idx, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_TRANSITIONS.items()) + " END AS transition FROM events)"
