"""The registered queries: each operator over whole test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import splitmix
from ..operators import catalogue as C
from ..operators import appended, choose, ordered, records as R, replay, report
from ..operators import lattice as L
from ..sources import binary, landing
from ..sources import config as cfg
from ..staging import shared_dir
from ..streaming import events as S
from ..streaming import replay as streamed
from . import standins as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_M64 = "18446744073709551616::UHUGEINT"


def sql_mul(a: str, c: int) -> str:
    return f"((({a})::UHUGEINT * {c}::UHUGEINT) % {_M64})::UBIGINT"


def sql_add(*parts: str) -> str:
    return f"(({' + '.join(f'({p})::UHUGEINT' for p in parts)}) % {_M64})::UBIGINT"


def sql_finalised(z: str) -> str:
    z = sql_mul(f"xor({z}, ({z}) >> 30)", splitmix.MIX_1)
    z = sql_mul(f"xor({z}, ({z}) >> 27)", splitmix.MIX_2)
    return f"xor({z}, ({z}) >> 31)"


def sql_draw(seed: str, nth: str) -> str:
    """The nth draw; seed is SQL for the unsigned seed."""
    return sql_finalised(sql_add(f"xor(({seed})::UBIGINT, {splitmix.GOLDEN}::UBIGINT)", sql_mul(nth, splitmix.GOLDEN)))


def sql_uniform(draw: str) -> str:
    return f"greatest((({draw}) >> 11)::DOUBLE * 1.1102230246251565e-16, 2.2250738585072014e-308)"


PATCH_SEED_SQL = f"xor({L.PATCH_SEED}::UBIGINT, patch_id::UBIGINT)"


# Records and the catalogue


@query(f"WITH {T.RECORDS_SQL}, {T.SPECIES_SQL} SELECT s.species, COUNT(r.species) AS n, COUNT(r.real_ea_mev) AS with_barrier FROM species s LEFT JOIN records r ON r.species = s.species GROUP BY s.species")
def species_counts(spark, sf_dir):
    return R.species_counts(T.records(spark, sf_dir), T.species(spark))


FALLBACK_SQL = f"""{T.RECORDS_SQL}, own AS (SELECT *, COUNT(*) OVER (PARTITION BY species) AS n_all, COUNT(*) FILTER (facet = {T.FACET}) OVER (PARTITION BY species) AS n_facet FROM records WHERE metal = '{T.METAL}'),
filtered AS (SELECT * FROM own WHERE facet = {T.FACET} OR (n_facet < 4 AND n_all > n_facet))"""


@query(f"WITH {FALLBACK_SQL} SELECT sid, species, energy_mev, facet FROM filtered")
def metal_facet_fallback(spark, sf_dir):
    return R.with_fallback(T.records(spark, sf_dir), T.METAL, T.FACET).select("sid", "species", "energy_mev", "facet")


PAIR_FALLBACK_SQL = f"""{T.PAIRS_SQL}, metal_pairs AS (SELECT * FROM pairs WHERE metal = '{T.METAL}'),
own_pairs AS (SELECT * FROM metal_pairs WHERE facet = {T.FACET} OR NOT EXISTS (SELECT 1 FROM metal_pairs WHERE facet = {T.FACET}))"""


@query(f"WITH {PAIR_FALLBACK_SQL} SELECT sid, species_a, species_b, energy_mev, ea_mev, facet FROM own_pairs")
def bimolecular_fallback(spark, sf_dir):
    return R.pairs_with_fallback(T.pairs(spark, sf_dir), T.METAL, T.FACET).select("sid", "species_a", "species_b", "energy_mev", "ea_mev", "facet")


def buckets_sql(source: str, order: str) -> str:
    return f"""ranks AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY species ORDER BY energy_mev, {order}) - 1 AS rank, COUNT(*) OVER (PARTITION BY species) AS total FROM {source}),
buckets AS (
  SELECT species, (((rank + 1) * LEAST(4, total) - 1) // total)::INT AS bucket, COUNT(*) AS n,
         SUM(energy_mev)::BIGINT / COUNT(*) AS mean_energy_mev, SUM(real_ea_mev)::BIGINT / NULLIF(COUNT(real_ea_mev), 0) AS mean_ea_mev
  FROM ranks GROUP BY ALL)"""


@query(f"WITH {T.RECORDS_SQL}, {buckets_sql('records', 'sid')} SELECT * FROM buckets")
def quantile_buckets(spark, sf_dir):
    return R.quantile_buckets(T.records(spark, sf_dir), [F.col("sid")])


LINES_SQL = "lines AS (SELECT l_returnflag || l_linestatus AS species, round(l_extendedprice)::INT AS energy_mev, NULL::INT AS real_ea_mev, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem)"


@query(f"WITH {LINES_SQL}, {buckets_sql('lines', 'l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice')} SELECT species, bucket, n, mean_energy_mev FROM buckets")
def quantile_buckets_lineitem(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    lines = T.table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("species"), F.round("l_extendedprice").cast("int").alias("energy_mev"), F.lit(None).cast("int").alias("real_ea_mev"), *keys)
    return R.quantile_buckets(lines, [F.col(k) for k in keys]).drop("mean_ea_mev")


KT = X.BOLTZMANN_EV * 298.15
RATES_SQL = f"""rates AS (
  SELECT sid, COALESCE(real_ea_mev / 1000.0, GREATEST(0.0, 0.87 * (energy_mev / 1000.0) + 0.0)) AS ea, energy_mev / 1000.0 AS e FROM
    (SELECT sid, energy_mev::DOUBLE AS energy_mev, real_ea_mev::DOUBLE AS real_ea_mev FROM records))"""


@query(f"WITH {T.RECORDS_SQL}, {RATES_SQL} SELECT sid, round(ea, 9) AS ea_ev, round(GREATEST(0.0, ea - e), 9) AS reverse_ev, round(ln(1e13 * exp(-ea / {KT!r})), 8) AS ln_rate FROM rates")
def bep_arrhenius_rates(spark, sf_dir):
    e = X.ev_from_mev(F.col("energy_mev"))
    ea = X.activation_ev(e, X.ev_from_mev(F.col("real_ea_mev")), 0.87, 0.0)
    rows = T.records(spark, sf_dir).select("sid", ea.alias("ea"), e.alias("e"))
    return rows.select("sid", F.round("ea", 9).alias("ea_ev"), F.round(X.reverse_ev(F.col("ea"), F.col("e")), 9).alias("reverse_ev"), F.round(F.log(X.rate(F.col("ea"), 1e13, 298.15)), 8).alias("ln_rate"))


@query(f"WITH {T.RECORDS_SQL}, {RATES_SQL}, k AS (SELECT sid, 1e13 * exp(-ea / {KT!r}) AS k FROM rates) SELECT sid, LEAST(GREATEST(round(k * (2147483648.0 / (SELECT MAX(k) FROM k)))::BIGINT, 1), 4294967295)::BIGINT AS rate_q16 FROM k")
def rescaled_rates(spark, sf_dir):
    ea = X.activation_ev(X.ev_from_mev(F.col("energy_mev")), X.ev_from_mev(F.col("real_ea_mev")), 0.87, 0.0)
    rows = T.records(spark, sf_dir).select("sid", X.rate(ea, 1e13, 298.15).alias("k"))
    top = F.broadcast(rows.agg(F.max("k").alias("top")))  # one row
    return rows.crossJoin(top).select("sid", X.rescaled_q16(F.col("k"), F.col("top")).alias("rate_q16"))


CATALOGUE_SQL = f"""WITH {FALLBACK_SQL}, {PAIR_FALLBACK_SQL}, {T.SPECIES_SQL}, {buckets_sql('filtered', 'sid')},
replaced AS (SELECT DISTINCT species_a AS species FROM own_pairs WHERE NOT is_dissociative AND species_a = species_b),
single AS (
  SELECT s.species, s.bit, s.role, b.bucket, b.mean_energy_mev / 1000.0 AS e, COALESCE(b.mean_ea_mev / 1000.0, GREATEST(0.0, 0.87 * (b.mean_energy_mev / 1000.0))) AS ea, s.species IN (SELECT species FROM replaced) AS gone
  FROM buckets b JOIN species s ON s.species = b.species WHERE s.role <> 'product_only'),
double AS (SELECT p.*, p.energy_mev::DOUBLE / 1000.0 AS e, p.ea_mev::DOUBLE / 1000.0 AS ea, a.bit AS bit_a, b.bit AS bit_b FROM own_pairs p JOIN species a ON a.species = p.species_a JOIN species b ON b.species = p.species_b),
rates AS (
  SELECT 0 AS part, species AS of, bucket::BIGINT AS place, 0 AS emit, ea AS barrier, bit AS ta, CASE role WHEN 'dissociative' THEN bit ELSE 0 END AS tb, role = 'dissociative' AS two, CASE role WHEN 'dissociative' THEN 0 ELSE bucket END AS bin_id, CASE role WHEN 'dissociative' THEN 'dissociative_adsorption' ELSE 'adsorption' END AS category FROM single
  UNION ALL SELECT 0, species, bucket, 1, GREATEST(0.0, ea - e), bit * 256, 0, false, bucket, 'desorption' FROM single WHERE NOT gone
  UNION ALL SELECT 1, '', sid, 0, ea, CASE WHEN is_dissociative THEN bit_a ELSE bit_a * 256 END, CASE WHEN is_dissociative THEN bit_b ELSE bit_b * 256 END, true, 0, CASE WHEN is_dissociative THEN 'dissociative_pair' ELSE 'recombination' END FROM double
  UNION ALL SELECT 1, '', sid, 1, GREATEST(0.0, ea - e), bit_a * 256, bit_b * 256, true, 0, 'dissociative_pair' FROM double WHERE is_dissociative),
speeds AS (SELECT *, 1e13 * exp(-barrier / {KT!r}) AS k FROM rates),
reactions AS (
  SELECT (ROW_NUMBER() OVER (ORDER BY bin_id, part, of, place, emit) - 1)::INT AS reaction_id, LEAST(GREATEST(round(k * (2147483648.0 / (SELECT MAX(k) FROM speeds)))::BIGINT, 1), 4294967295)::BIGINT AS rate_q16,
         bin_id::INT AS bin_id, ta::INT AS transition_a, tb::INT AS transition_b, two AS is_bimolecular, category FROM speeds)"""


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.build(T.records(spark, sf_dir), T.pairs(spark, sf_dir), T.species(spark), T.METAL, T.FACET)


@query(f"{CATALOGUE_SQL} SELECT * FROM reactions")
def reaction_catalogue(spark, sf_dir):
    return built(spark, sf_dir)


@query(f"{CATALOGUE_SQL} SELECT category, COUNT(*) AS reactions FROM reactions GROUP BY category")
def reaction_categories(spark, sf_dir):
    return C.category_counts(built(spark, sf_dir))


@query(f"{CATALOGUE_SQL} SELECT reaction_id, (reaction_id // 32)::INT AS block, (reaction_id % 32)::INT AS lane, rate_q16 FROM reactions")
def packed_blocks(spark, sf_dir):
    return C.blocks(built(spark, sf_dir)).select("reaction_id", "block", "lane", "rate_q16")


@query(f"WITH {T.RECORDS_SQL}, {T.PAIRS_SQL} SELECT sid, species FROM records WHERE species NOT IN (SELECT species_a FROM pairs WHERE NOT is_dissociative AND species_a = species_b)")
def homoatomic_anti(spark, sf_dir):
    gone = C.replaced_desorptions(T.pairs(spark, sf_dir))
    return T.records(spark, sf_dir).join(gone, "species", "left_anti").select("sid", "species")


MAGNITUDE_SQL = "bins AS (SELECT (length(bin(p_partkey + 1)) - 1)::INT AS bin_id, p_partkey AS reaction_id, p_partkey + 1 AS rate FROM part)"


@query(f"WITH {MAGNITUDE_SQL} SELECT bin_id, MIN(reaction_id) AS first_id, COUNT(*) AS n, SUM(rate)::DOUBLE / 65536 AS total, pow(2, LEAST(bin_id + 17, 63)) AS ceiling FROM bins GROUP BY bin_id")
def magnitude_bins(spark, sf_dir):
    rows = T.table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("rate_q16"), F.col("p_partkey").alias("reaction_id")).withColumn("bin_id", X.magnitude_class(F.col("rate_q16")))
    return C.magnitude_bins(rows).select("bin_id", "first_id", "n", X.fixed_to_double(F.col("total")).alias("total"), X.bin_ceiling(F.col("bin_id")).alias("ceiling"))


@query("WITH sizes AS (SELECT p_size // 7 * 7 AS bin_id, COUNT(*) AS n FROM part GROUP BY 1), wanted AS (SELECT range AS bin FROM range(60)) SELECT bin::INT AS bin, (SELECT MAX(bin_id) FROM sizes WHERE bin_id <= bin)::INT AS usable FROM wanted")
def nearest_usable_bin(spark, sf_dir):
    bin_id = (F.floor(F.col("p_size") / 7) * 7).cast("int")
    sizes = T.table(spark, sf_dir, "part").groupBy(bin_id.alias("bin_id")).agg(F.count("*").alias("n")).withColumn("total", F.col("n"))
    return C.usable_bin_at_or_below(sizes, spark.range(60).select(F.col("id").cast("int").alias("bin")))


_DEMO_SQL = "((SELECT COUNT(*) FROM part) + 31) // 32 * 32"


@query(
    f"""WITH d AS (SELECT id, {sql_draw(str(0xC0FFEE00C0FFEE00), 'id')} AS raw FROM (SELECT unnest(range(1, {_DEMO_SQL} + 1)) AS id)),
cut AS (SELECT id, GREATEST(raw % 16777216, 1)::BIGINT AS rate_q16, (((raw >> 24) % 8) * 256 + (raw >> 27) % 8)::INT AS transition_a, (raw >> 30) % 8 = 0 AS is_bimolecular, (((raw >> 33) % 8) * 256 + (raw >> 36) % 8)::INT AS b FROM d),
made AS (SELECT *, (length(bin(rate_q16)) - 1)::INT AS bin_id FROM cut)
SELECT (ROW_NUMBER() OVER (ORDER BY bin_id, id) - 1)::INT AS reaction_id, rate_q16, bin_id, transition_a, CASE WHEN is_bimolecular THEN b ELSE 0 END AS transition_b, is_bimolecular FROM made"""
)
def demo_catalogue(spark, sf_dir):
    """As many reactions as parts, in whole blocks."""
    return C.demo_catalogue(spark, T.table(spark, sf_dir, "part").count())


# Labels, landed records


@query(
    r"""WITH f AS (SELECT p_partkey, p_brand, p_size, CASE p_partkey % 6 WHEN 0 THEN 'Pd' || p_size WHEN 1 THEN 'PdPt' || p_size WHEN 2 THEN 'Xx2' WHEN 3 THEN 'Cu' || p_size || 'Cu' WHEN 4 THEN '' ELSE NULL END AS formula,
  CASE p_partkey % 4 WHEN 0 THEN (p_size * 7919)::VARCHAR WHEN 1 THEN p_size || '-lc' WHEN 2 THEN '' ELSE NULL END AS facet FROM part),
e AS (SELECT *, list_distinct(regexp_extract_all(COALESCE(formula, ''), '([A-Z][a-z]?)[0-9]*', 1)) AS elements FROM f)
SELECT p_partkey, CASE WHEN len(elements) = 1 THEN elements[1] END AS metal,
  CASE WHEN len(elements) = 1 THEN GREATEST(COALESCE(list_position(['unknown', 'Pd', 'Pt', 'Cu', 'Ni', 'Rh', 'Ru', 'Ag', 'Au', 'Fe', 'Co', 'Ir', 'Os'], elements[1]), 1) - 1, 0) ELSE 0 END::INT AS metal_index,
  CASE WHEN regexp_matches(facet, '^[0-9]+$') THEN facet::BIGINT % 65536 ELSE 0 END::INT AS facet_code,
  CASE WHEN p_size < 10 THEN array_to_string(list_reverse_sort([p_size % 3, 1, p_size]), '') END AS miller
FROM e"""
)
def formula_labels(spark, sf_dir):
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    formula = F.when(k % 6 == 0, F.concat(F.lit("Pd"), size)).when(k % 6 == 1, F.concat(F.lit("PdPt"), size)).when(k % 6 == 2, "Xx2").when(k % 6 == 3, F.concat(F.lit("Cu"), size, F.lit("Cu"))).when(k % 6 == 4, "")
    facet = F.when(k % 4 == 0, (F.col("p_size") * 7919).cast("string")).when(k % 4 == 1, F.concat(size, F.lit("-lc"))).when(k % 4 == 2, "")
    miller = F.array(-(F.col("p_size") % 3), F.lit(1), F.col("p_size"))
    rows = T.table(spark, sf_dir, "part").select("p_partkey", X.pure_metal(formula).alias("metal"), X.facet_code(facet).alias("facet_code"), X.miller_facet(miller).alias("miller"))
    return rows.withColumn("metal_index", X.metal_index(F.col("metal")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE o_orderkey END::BIGINT AS sid FROM orders")
def sid_decode(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Reaction:"), k.cast("string"))
    opaque = F.when(k % 5 == 4, F.lit("no base64!")).otherwise(F.base64(text.cast("binary")))
    return T.table(spark, sf_dir, "orders").select("o_orderkey", X.sid_from_id(opaque).alias("sid"))


@query("SELECT event_id, round((props::JSON->>'k')::DOUBLE, 3) AS amount, (abs((props::JSON->>'k')::DOUBLE - 1.0) <= 1e-6) AS is_one FROM events")
def json_stoichiometry(spark, sf_dir):
    parts = X.stoichiometry(F.col("props"))
    k = F.try_element_at(parts, F.lit("k"))
    return T.table(spark, sf_dir, "events").select("event_id", F.round(k, 3).alias("amount"), (F.abs(k - 1.0) <= 1e-6).alias("is_one"))


CONFIG = """[system]
metal = Rh
facet = 211
[species]
O = 0x02, O2gas, 0.5, Ostar, dissociative, 3
N = 0x01, N2gas, 0.5, Nstar, dissociative, 4
NO = 0x10, NOgas, 1.0, NOstar, molecular, 9
NH = 0x04, -, -, NHstar, product_only, -
NH3 = 0x20, NH3gas, 1.0, NH3star, molecular, -
[bimolecular]
nitrous = N, NO, recombination, N2Ogas
nitrogen = N, N, recombination, N2gas
ammonia = N, NH, dissociative, NH3gas
"""
#: Reactants, products and what they are, by event_id mod 9; the last three are no known reaction.
_NODES = [
    ('{"star": 1, "NOgas": 1}', '{"NOstar": 1}', "mono", 2, None),
    ('{"star": 2, "Ogas": 3}', '{"Ostar": 1}', "mono", 0, None),
    ('{"star": 0, "Nstar": 1, "NOstar": 1}', '{"N2Ogas": 1, "star": 2}', "recombination", 1, 2),
    ('{"Nstar": 2}', '{"N2gas": 1}', "recombination", 1, 1),
    ('{"star": 2, "NH3gas": 1}', '{"Nstar": 1, "NHstar": 1}', "dissociative", 1, 3),
    ('{"star": 1, "NH3gas": 1}', '{"NH3star": 1}', "mono", 4, None),
    ('{"star": 1, "NOgas": 1}', '{"NOstar": 2}', None, None, None),
    ('{"Nstar": 1}', '{"N2gas": 1}', None, None, None),
    ('{"star": 1, "XXgas": 1}', '{"NOstar": 1}', None, None, None),
]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    at = lambda i: F.element_at(F.array(*(F.lit(n[i]) for n in _NODES)), (k % 9 + 1).cast("int"))
    return T.table(spark, sf_dir, "events").select(
        F.base64(F.concat(F.lit("Reaction:"), k.cast("string")).cast("binary")).alias("id"), at(0).alias("reactants"), at(1).alias("products"),
        F.when(k % 11 > 0, F.col("value") / 100).alias("reactionEnergy"), F.when(k % 4 > 0, F.col("value") / 50).alias("activationEnergy"), F.lit("Pd4").alias("surfaceComposition"), F.lit("111").alias("facet"),
    )


_CATEGORY_SQL = "(VALUES " + ", ".join(f"({i}, '{c}', {a}, {'NULL' if b is None else b})" for i, (_, _, c, a, b) in enumerate(_NODES) if c) + ") AS v(m, category, species_a, species_b)"


@query(f"SELECT event_id AS sid, category, species_a::INT AS species_a, species_b::INT AS species_b, 1::INT AS metal, 111::INT AS facet FROM events JOIN {_CATEGORY_SQL} ON event_id % 9 = m WHERE event_id % 11 > 0 AND event_id % 4 > 0")
def first_match_pattern(spark, sf_dir):
    return landing.categorised(nodes(spark, sf_dir), cfg.parse(CONFIG)).select("sid", "category", "species_a", "species_b", "metal", "facet")


@query("SELECT event_id AS sid, CASE event_id % 9 WHEN 0 THEN 2 ELSE 4 END::INT AS species FROM events WHERE event_id % 9 IN (0, 5) AND event_id % 11 > 0")
def clean_adsorptions(spark, sf_dir):
    return landing.clean_adsorptions(nodes(spark, sf_dir), cfg.parse(CONFIG)).select("sid", "species")


UPSERT_SQL = """WITH pass1 AS (SELECT o_orderkey AS sid, o_totalprice AS energy, o_orderstatus AS tag, o_orderkey AS id FROM orders),
pass2 AS (SELECT 2 * l_orderkey AS sid, l_extendedprice AS energy, l_returnflag AS tag, l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey AS id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY (l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey)::VARCHAR DESC, l_extendedprice DESC, l_returnflag DESC) AS n FROM lineitem)"""


def _passes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders, and all lines under twice their order's number, so that half of these are new."""
    first = T.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sid", "o_totalprice AS energy", "o_orderstatus AS tag", "cast(o_orderkey AS string) AS id")
    second = T.table(spark, sf_dir, "lineitem").selectExpr("2 * l_orderkey AS sid", "l_extendedprice AS energy", "l_returnflag AS tag", "concat(cast(l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey AS string), '/', lpad(cast(cast(l_extendedprice * 100 AS long) AS string), 12, '0'), l_returnflag) AS id")
    return first, second


@query(f"{UPSERT_SQL} SELECT sid, energy, tag FROM pass2 WHERE n = 1 UNION ALL SELECT sid, energy, tag FROM pass1 WHERE sid NOT IN (SELECT sid FROM pass2)")
def upsert_by_sid(spark, sf_dir):
    return landing.upsert(*_passes(spark, sf_dir)).select("sid", "energy", "tag")


@query(f"{UPSERT_SQL} SELECT sid, energy, tag FROM pass2 WHERE n = 1 UNION ALL SELECT sid, energy, tag FROM pass1 WHERE sid NOT IN (SELECT sid FROM pass2)")
def upsert_stored(spark, sf_dir):
    """Into a table dealt to buckets by sid, which isn't shuffled again."""
    first, second = _passes(spark, sf_dir)
    target = landing.store_by_key(first, f"stored_{uuid.uuid4().hex}", _file(spark, "stored"))
    return landing.upsert_stored(target, second).select("sid", "energy", "tag")


@query(f"{UPSERT_SQL}, keys AS (SELECT DISTINCT sid FROM pass2) SELECT COUNT(*) FILTER (sid IN (SELECT sid FROM pass1)) AS upgraded, COUNT(*) FILTER (sid NOT IN (SELECT sid FROM pass1)) AS added FROM keys")
def upsert_counts(spark, sf_dir):
    return landing.upsert_counts(*_passes(spark, sf_dir))


@query("SELECT (CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 END)::INT AS species, p_partkey AS sid, round_even(p_retailprice, 0)::INT AS energy_mev, (CASE WHEN p_size % 10 = 0 THEN 0 ELSE 100 * (p_size % 10) + 10 END)::INT AS facet FROM part WHERE p_partkey % 3 < 2 AND p_size % 7 > 0")
def adsorption_runs(spark, sf_dir):
    part = T.table(spark, sf_dir, "part")
    runs = part.select(F.col("p_partkey").alias("sid"), F.when(F.col("p_size") % 7 > 0, F.col("p_retailprice") / 1000.0).alias("y_relaxed"))
    d = F.col("p_size") % 10
    mapping = part.select(
        F.concat(F.lit("random"), F.col("p_partkey").cast("string")).alias("key"), F.element_at(F.array(F.lit(3), F.lit(9), F.lit(77)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("ads_id"),
        F.lit("Pd4").alias("bulk_symbols"), F.when(d == 0, F.array(F.lit(10), F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), -d, F.lit(1))).alias("miller_index"),
    )
    return landing.adsorption_runs(runs, mapping, cfg.parse(CONFIG)).select("species", "sid", "energy_mev", "facet")


# Lattices


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_patches(T.lattice(spark, sf_dir), T.WIDTH, T.height(spark, sf_dir), T.PATCHES)


@query(f"WITH {T.LATTICE_SQL} SELECT patch_id::INT AS patch_id, MAX(rows)::BIGINT AS rows, COUNT(*) AS sites, MIN(site_idx) AS first_site FROM placed GROUP BY patch_id")
def patches(spark, sf_dir):
    return placed(spark, sf_dir).groupBy("patch_id").agg(F.max("rows").alias("rows"), F.count("*").alias("sites"), F.min("site_idx").alias("first_site"))


@query(f"WITH {T.EDGES_SQL} SELECT patch_id::INT AS patch_id, a, b FROM edges WHERE ord IN (1, 4, 5)")
def hex_edges(spark, sf_dir):
    return L.edges(placed(spark, sf_dir), T.WIDTH).select("patch_id", "a", "b")


@query(f"WITH {T.EDGES_SQL} SELECT patch_id::INT AS patch_id, LEAST(state_a, state_b)::INT AS low, GREATEST(state_a, state_b)::INT AS high, COUNT(*) AS n FROM edge_states WHERE ord IN (1, 4, 5) GROUP BY ALL")
def pair_counts(spark, sf_dir):
    return L.pair_counts(placed(spark, sf_dir), T.WIDTH)


BUCKET_SQL = sql_finalised(sql_add(sql_mul("site", splitmix.GOLDEN), sql_mul("bit", splitmix.MIX_1), PATCH_SEED_SQL))
SITES_SQL = f"""hashed AS (SELECT patch_id, bit, state = 0 AS vacant, ({BUCKET_SQL} % 4)::INT AS bucket FROM placed JOIN (VALUES (1), (2)) AS s(bit) ON state = 0 OR state = bit),
sites AS (SELECT patch_id, bit, vacant, bucket, COUNT(*) AS n FROM hashed GROUP BY ALL)"""


@query(f"WITH {T.LATTICE_SQL}, {SITES_SQL} SELECT patch_id::INT AS patch_id, bit::INT AS bit, vacant, bucket, n FROM sites")
def vacancy_counts(spark, sf_dir):
    return L.site_counts(placed(spark, sf_dir), T.lattice_species(spark))


@query(f"WITH {T.LATTICE_SQL}, h AS (SELECT ({BUCKET_SQL.replace('patch_id', '0').replace(' bit', ' 1').replace('(bit)', '(1)')} % 4)::INT AS bucket FROM placed) SELECT bucket, COUNT(*) AS sites FROM h GROUP BY bucket")
def site_bucket_hist(spark, sf_dir):
    hashed = splitmix.with_site_bucket(placed(spark, sf_dir), "bucket", F.col("site"), F.lit(1), L.PATCH_SEED)
    return hashed.groupBy("bucket").agg(F.count("*").alias("sites"))


LIVE_SQL = f"""{T.EDGES_SQL}, {SITES_SQL}, {T.TEMPLATES_SQL},
pairs AS (SELECT patch_id, LEAST(state_a, state_b) AS low, GREATEST(state_a, state_b) AS high, COUNT(*) AS n FROM edge_states WHERE ord IN (1, 4, 5) GROUP BY ALL),
live AS (
  SELECT p.patch_id, t.*, COALESCE(CASE WHEN is_bimolecular THEN (SELECT n FROM pairs q WHERE q.patch_id = p.patch_id AND low = LEAST(transition_a >> 8, transition_b >> 8) AND high = GREATEST(transition_a >> 8, transition_b >> 8))
         ELSE (SELECT n FROM sites s WHERE s.patch_id = p.patch_id AND vacant = (transition_a < 256) AND bit = CASE WHEN transition_a < 256 THEN transition_a ELSE transition_a >> 8 END AND bucket = t.bin_id) END, 0)::BIGINT AS live
  FROM (SELECT DISTINCT patch_id FROM placed) p, templates t),
weights AS (SELECT *, rate_q16 * live * CASE WHEN transition_a >= 256 OR (is_bimolecular AND transition_a <> transition_b) THEN 1.0 WHEN transition_a = 1 THEN 2.5 WHEN transition_a = 2 THEN 0.5 ELSE 1.0 END AS weight FROM live)"""
PRESSURES = {1: 2.5, 2: 0.5}


@query(f"WITH {LIVE_SQL} SELECT patch_id::INT AS patch_id, reaction_id, live, weight::DOUBLE AS weight FROM weights")
def propensity_snapshot(spark, sf_dir):
    live = L.live_counts(placed(spark, sf_dir), T.WIDTH, T.templates(spark), T.lattice_species(spark))
    return L.propensities(live, PRESSURES).select("patch_id", "reaction_id", "live", "weight")


@query(f"WITH {LIVE_SQL} SELECT patch_id::INT AS patch_id, SUM(weight)::DOUBLE AS total FROM weights GROUP BY patch_id")
def total_propensity(spark, sf_dir):
    live = L.live_counts(placed(spark, sf_dir), T.WIDTH, T.templates(spark), T.lattice_species(spark))
    return L.propensities(live, PRESSURES).groupBy("patch_id").agg(F.sum("weight").alias("total"))


@query(f"WITH {T.EDGES_SQL} SELECT patch_id::INT AS patch_id, a, arg_min(b, ord) AS b FROM edge_states WHERE state_a = 1 AND state_b = 2 GROUP BY ALL")
def pair_candidates(spark, sf_dir):
    return L.pair_candidates(placed(spark, sf_dir), T.WIDTH, 1, 2)


@query(f"{CATALOGUE_SQL} SELECT DISTINCT LEAST(transition_a >> 8, transition_b >> 8)::INT AS low, GREATEST(transition_a >> 8, transition_b >> 8)::INT AS high FROM reactions WHERE is_bimolecular")
def template_pairs(spark, sf_dir):
    return L.template_pairs(built(spark, sf_dir))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN xor(s & 65534, 1) WHEN 'click' THEN (s & 7) | 2 WHEN 'purchase' THEN s & ~1 WHEN 'signup' THEN s & ~2 ELSE (s & ~3) | 5 END::INT AS state FROM (SELECT *, (event_id % 8)::INT AS s FROM events)")
def transition_apply(spark, sf_dir):
    t = T.events(spark, sf_dir)
    return t.select(F.col("ord").alias("event_id"), X.apply_transition((F.col("ord") % 8).cast("int"), F.col("transition")).alias("state"))


@query(f"SELECT o_orderkey AS site_idx, round(o_orderkey % {T.WIDTH} + CASE WHEN (o_orderkey // {T.WIDTH}) % 2 = 1 THEN 0.5 ELSE 0.0 END, 6)::DOUBLE AS x, round((o_orderkey // {T.WIDTH}) * {3.0**0.5 / 2!r}, 6)::DOUBLE AS y, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'corrupt' ELSE 'vacant' END AS label, o_orderstatus = 'O' AS is_corrupt FROM orders")
def hex_layout(spark, sf_dir):
    rows = report.hex_layout(T.lattice(spark, sf_dir), T.WIDTH, {1: "O"})
    return rows.select("site_idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "label", "is_corrupt")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'CO' ELSE 'vacant' END AS label, COUNT(*) AS sites FROM orders GROUP BY 1")
def lattice_summary(spark, sf_dir):
    return report.summary(T.lattice(spark, sf_dir), {1: "O", 2: "CO"})


# Weighted choice


@query(
    f"""WITH w AS (SELECT p_partkey AS choice, SUM(round(p_retailprice)::BIGINT) OVER (ORDER BY p_partkey)::BIGINT AS hi, round(p_retailprice)::BIGINT AS weight, (SELECT SUM(round(p_retailprice)::BIGINT) FROM part)::BIGINT AS total FROM part),
d AS (SELECT o_orderkey, {sql_uniform(sql_draw('17', 'o_orderkey + 1'))} AS u FROM orders)
SELECT o_orderkey, choice FROM d ASOF JOIN w ON d.u * (SELECT MAX(total) FROM w) >= w.hi - w.weight"""
)
def categorical_draw(spark, sf_dir):
    """Many choices meet draws by slices of the total."""
    part = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("choice"), F.round("p_retailprice").cast("long").alias("weight"))
    draws = splitmix.with_uniform(T.table(spark, sf_dir, "orders").select("o_orderkey"), "u", 17, F.col("o_orderkey") + 1)
    return choose.by_search(draws, choose.cumulative(part, [], "choice", "weight"), "u").select("o_orderkey", "choice")


@query(
    f"""WITH w AS (SELECT o_orderkey, o_orderkey % 4 AS patch_id, -ln({sql_uniform(sql_draw('29', 'o_orderkey + 1'))}) / o_totalprice::DOUBLE AS wait FROM orders)
SELECT o_orderkey, patch_id, round(wait, 12) AS wait, round(SUM(wait) OVER (PARTITION BY patch_id ORDER BY o_orderkey), 9) AS sim_time FROM w"""
)
def running_clock(spark, sf_dir):
    """Each event's waiting time at its patch's total propensity, and the patch's clock after it."""
    own = splitmix.with_uniform(T.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("patch_id"), F.col("o_totalprice").cast("double").alias("total")), "u", 29, F.col("o_orderkey") + 1)
    clock = ordered.running_sums(own.withColumn("wait", X.waiting_time(F.col("u"), F.col("total"))), ["patch_id"], ["o_orderkey"], {"sim_time": "wait"})
    return clock.select("o_orderkey", "patch_id", F.round("wait", 12).alias("wait"), F.round("sim_time", 9).alias("sim_time"))


def touch_sql(bits: list[int], source: str, order: str) -> str:
    parts = " + ".join(f"COALESCE(last_value(CASE WHEN (transition & {b}) <> 0 THEN {b} WHEN ((transition >> 8) & {b}) <> 0 THEN 0 END IGNORE NULLS) OVER w, 0)" for b in bits)
    return f"""after AS (SELECT *, ({parts})::INT AS state_after FROM {source} WINDOW w AS (PARTITION BY site_idx ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
replayed AS (SELECT *, COALESCE(lag(state_after) OVER (PARTITION BY site_idx ORDER BY {order}), 0)::INT AS state_before FROM after)"""


# Replay of the event log

NUMBERED_SQL = f"""{T.EVENTS_SQL}, numbered AS (SELECT *, ROW_NUMBER() OVER (ORDER BY sim_time, ord) AS n FROM log), inside AS (SELECT * FROM numbered WHERE site_idx < {T.SITES_SQL}), {touch_sql([1, 2, 4], 'inside', 'n')}"""


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.numbered(T.events(spark, sf_dir), ["sim_time", "ord"])


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.states(numbered_events(spark, sf_dir), ["n"], [1, 2, 4])


@query(f"WITH {NUMBERED_SQL} SELECT ord, n, state_before, state_after FROM replayed")
def event_replay(spark, sf_dir):
    return replayed(spark, sf_dir).select("ord", "n", "state_before", "state_after")


_CHANGE = ", ".join(f"SUM((state_after = {s})::INT - (state_before = {s})::INT)::BIGINT AS {name}" for name, s in (("vacant", 0), ("O", 1), ("CO", 2)))
COVERAGE_SQL = f"""WITH {NUMBERED_SQL}, ends AS (SELECT (n + {T.EVERY - 1}) // {T.EVERY} AS sample, MAX(n) AS event, arg_max(sim_time, n) AS sim_time FROM numbered GROUP BY 1),
deltas AS (SELECT (n + {T.EVERY - 1}) // {T.EVERY} AS sample, {_CHANGE} FROM replayed GROUP BY 1),
points AS (SELECT 0 AS sample, 0 AS event, 0.0 AS sim_time, {T.SITES_SQL} AS vacant, 0 AS O, 0 AS CO UNION ALL SELECT e.sample, event, sim_time, COALESCE(vacant, 0), COALESCE(O, 0), COALESCE(CO, 0) FROM ends e LEFT JOIN deltas d ON d.sample = e.sample),
coverage AS (SELECT event::BIGINT AS event, sim_time::DOUBLE AS sim_time, SUM(vacant) OVER w::BIGINT AS vacant, SUM(O) OVER w::BIGINT AS O, SUM(CO) OVER w::BIGINT AS CO FROM points WINDOW w AS (ORDER BY sample))"""


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.coverage_of(numbered_events(spark, sf_dir), [("O", 1), ("CO", 2)], T.sites(spark, sf_dir), T.EVERY, bits=[1, 2, 4])


@query(f"{COVERAGE_SQL} SELECT *, {T.SITES_SQL} - vacant - O - CO AS other FROM coverage")
def coverage_timeseries(spark, sf_dir):
    return covered(spark, sf_dir)


@query(f"{COVERAGE_SQL} SELECT *, {T.SITES_SQL} - vacant - O - CO AS other FROM coverage")
def coverage_appended(spark, sf_dir):
    """The log in three appends by time: each costs its own events."""
    kept = appended.Coverage(spark, _file(spark, "coverage"), [("O", 1), ("CO", 2)], T.sites(spark, sf_dir), T.EVERY, bits=[1, 2, 4])
    log = T.events(spark, sf_dir)
    a, b = log.approxQuantile("sim_time", [0.3, 0.75], 0.01)
    for part in ("sim_time < %r" % a, "sim_time >= %r and sim_time < %r" % (a, b), "sim_time >= %r" % b):
        kept.append(log.where(part))
    return kept.rows()


@query(f"{COVERAGE_SQL} SELECT event, round(sim_time * 1e6, 0) AS time_us, 100.0 * vacant / {T.SITES_SQL}::DOUBLE AS vacant, 100.0 * O / {T.SITES_SQL}::DOUBLE AS O, 100.0 * CO / {T.SITES_SQL}::DOUBLE AS CO FROM coverage")
def coverage_percent(spark, sf_dir):
    return report.coverage_percent(covered(spark, sf_dir).drop("other"), ["vacant", "O", "CO"]).withColumn("time_us", F.round("time_us", 0))


@query(f"WITH {NUMBERED_SQL} SELECT site_idx, arg_max(state_after, n) AS state FROM replayed GROUP BY site_idx")
def final_lattice(spark, sf_dir):
    return replay.final_lattice(replayed(spark, sf_dir), ["n"])


LAST_SQL = f"{NUMBERED_SQL}, last AS (SELECT site_idx, arg_max(state_after, n) AS state FROM replayed GROUP BY site_idx)"


@query(f"WITH {LAST_SQL} SELECT state, COUNT(*) AS sites FROM last GROUP BY state")
def state_histogram(spark, sf_dir):
    return L.histogram(replay.final_lattice(replayed(spark, sf_dir), ["n"]))


@query(f"WITH {LAST_SQL} SELECT site_idx, state FROM last WHERE state NOT IN (0, 1, 2)")
def corrupt_sites(spark, sf_dir):
    return L.corrupt_sites(replay.final_lattice(replayed(spark, sf_dir), ["n"]), 3)


# Files: written from a table, read back


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with numbers for species (0 to 9, two of them beyond the eighth), metal and facet."""
    own = T.records(spark, sf_dir)
    return own.select((F.col("sid") % 10).cast("int").alias("species"), "energy_mev", "sid", "real_ea_mev", (F.col("sid") % 13).cast("int").alias("metal"), (F.col("facet") * 11).cast("int").alias("facet"))


@query(f"WITH {T.RECORDS_SQL} SELECT (sid % 10)::INT AS species, energy_mev, sid, real_ea_mev, (sid % 13)::INT AS metal, (facet * 11)::INT AS facet, round(energy_mev / 1000.0, 6)::DOUBLE AS energy_ev FROM records WHERE sid % 10 < 8")
def energy_file(spark, sf_dir):
    """Records of species beyond the eighth are left out by the reader."""
    path = _file(spark, "energies")
    binary.write_energies(numbered_records(spark, sf_dir), path)
    return binary.read_energies(spark, path).select("species", "energy_mev", "sid", "real_ea_mev", "metal", "facet", F.round("energy_ev", 6).alias("energy_ev"))


@query(f"WITH {T.RECORDS_SQL} SELECT (sid % 10)::INT AS species, energy_mev, sid, (sid % 13)::INT AS metal, (facet * 11)::INT AS facet FROM records WHERE sid % 10 IN (1, 3, 5) AND sid % 13 = 4 AND facet * 11 <= 330")
def energy_file_filtered(spark, sf_dir):
    """Filters that reach the file: it is ordered by metal and facet, and runs of records that can't match aren't opened."""
    path = _file(spark, "energies")
    binary.write_energies(numbered_records(spark, sf_dir), path, by=["metal", "facet"])
    found = binary.read_energies(spark, path).where("metal = 4 and facet <= 330 and species in (1, 3, 5)")
    return found.select("species", "energy_mev", "sid", "metal", "facet")


@query(f"{CATALOGUE_SQL} SELECT reaction_id, rate_q16, transition_a FROM reactions WHERE reaction_id IN (0, 3, 13, 40, 1000000)")
def reactions_by_id(spark, sf_dir):
    """Reads by id open the blocks asked for."""
    path = _file(spark, "catalogue")
    binary.write_catalogue(built(spark, sf_dir), path, "gated", list(zip(T.BITS, T.TYPES)), parts="parts")
    return binary.read_catalogue(spark, path).reactions.where("reaction_id in (0, 3, 13, 40, 1000000)").select("reaction_id", "rate_q16", "transition_a")


@query(f"WITH {T.PAIRS_SQL} SELECT (sid % 9)::INT AS species_a, (sid % 5)::INT AS species_b, energy_mev, sid, ea_mev, (sid % 13)::INT AS metal, facet, is_dissociative FROM pairs WHERE sid % 9 < 8")
def bimolecular_file(spark, sf_dir):
    path = _file(spark, "pairs")
    k = F.col("sid")
    rows = T.pairs(spark, sf_dir).withColumns({"species_a": (k % 9).cast("int"), "species_b": (k % 5).cast("int"), "metal": (k % 13).cast("int")})
    binary.write_bimolecular(rows, path)
    return binary.read_bimolecular(spark, path).drop("energy_ev", "ea_ev")


@query(f"{CATALOGUE_SQL} SELECT reaction_id, rate_q16, (bin_id % 256)::INT AS bin_id, transition_a, transition_b, is_bimolecular FROM reactions")
def catalogue_file(spark, sf_dir):
    path = _file(spark, "catalogue")
    binary.write_catalogue(built(spark, sf_dir), path, "gated", list(zip(T.BITS, T.TYPES)))
    return binary.read_catalogue(spark, path).reactions


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {b}, '{n}')" for i, (b, n) in enumerate(zip(T.BITS, T.TYPES))) + ") AS v(idx, bit, name)")
def catalogue_header(spark, sf_dir):
    path = _file(spark, "catalogue")
    binary.write_catalogue(built(spark, sf_dir), path, "gated", list(zip(T.BITS, T.TYPES)))
    return spark.createDataFrame([(i, b, n) for i, (b, n) in enumerate(binary.read_catalogue(spark, path).species)], "idx int, bit int, name string")


@query(f"WITH {T.LATTICE_SQL} SELECT site_idx, state::INT AS state FROM placed")
def lattice_file(spark, sf_dir):
    path, sites = _file(spark, "lattice"), T.lattice(spark, sf_dir)
    n = sites.count()
    binary.write_lattice(sites, path, n)
    return binary.read_lattice(spark, path, n, 1, strict=True)


_KINDS = list(T.EVENT_TRANSITIONS)
_KIND_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_KINDS)) + " END"


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schemas.EVENTS of the event log, in the order of event_id."""
    own = T.table(spark, sf_dir, "events")
    kind = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(i)) for i, k in enumerate(_KINDS)))
    seconds = F.when(F.col("event_id") % 17 > 0, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).otherwise(0.0)
    return own.select(F.col("event_id").alias("ord"), seconds.alias("sim_time"), F.col("user_id").alias("site_idx"), kind.alias("reaction_id"))


@query(f"SELECT ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS ord, epoch_us(ts) / 1e6 AS sim_time, user_id AS site_idx, ({_KIND_SQL})::INT AS reaction_id FROM events QUALIFY event_id % 17 > 0")
def trajectory_file(spark, sf_dir):
    """Records of time 0 are filling and are left out by the reader."""
    path = _file(spark, "trajectory")
    binary.write_trajectory(logged(spark, sf_dir), path)
    return binary.read_trajectory(spark, path, slice_bytes=1 << 20)


@query(f"SELECT event_id AS ord, ({_KIND_SQL})::INT AS reaction_id, (CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in list(T.EVENT_TRANSITIONS.items())[:3]) + " END)::INT AS transition FROM events")
def event_reactions(spark, sf_dir):
    """Events looked up in a catalogue that lacks the last two reactions: unknown ones have no transition."""
    rows = [(i, 1, 0, v, 0, False) for i, v in enumerate(list(T.EVENT_TRANSITIONS.values())[:3])]
    catalogue = spark.createDataFrame(rows, "reaction_id int, rate_q16 long, bin_id int, transition_a int, transition_b int, is_bimolecular boolean")
    return replay.with_transitions(logged(spark, sf_dir), catalogue, unknown="null").select("ord", "reaction_id", "transition")


@query(f"{COVERAGE_SQL} SELECT event, round(sim_time, 3) AS sim_time, vacant, O, CO FROM coverage")
def coverage_csv(spark, sf_dir):
    path = _file(spark, "coverage")
    report.write_coverage_csv(covered(spark, sf_dir).drop("other"), path)
    return landing.read_coverage_csv(spark, path).withColumn("sim_time", F.round("sim_time", 3))


def landed(spark: SparkSession, sf_dir: str) -> str:
    """nodes() as landed pages, a page for each user; every third node is of another metal, every fifth of another facet."""
    own = nodes(spark, sf_dir).withColumn("k", X.sid_from_id(F.col("id")))
    own = own.withColumn("surfaceComposition", F.when(F.col("k") % 3 == 0, "Cu9").otherwise("Pd4")).withColumn("facet", F.when(F.col("k") % 5 == 0, "100").otherwise("111"))
    node = F.struct(*(F.col(c.split(" ")[0]) for c in landing.NODE.split(", ")))
    pages = own.groupBy((F.col("k") % 64).alias("page")).agg(F.collect_list(F.struct(node.alias("node"))).alias("edges"))
    answer = F.struct(F.struct(F.struct(F.struct(F.lit(False).alias("hasNextPage"), F.col("page").cast("string").alias("endCursor")).alias("pageInfo"), "edges").alias("reactions")).alias("data"))
    path = _file(spark, "pages")
    pages.select(F.to_json(answer).alias("value")).write.text(path)
    return path


@query("SELECT event_id AS sid, CASE event_id % 9 WHEN 0 THEN 2 ELSE 4 END::INT AS species, 1::INT AS metal, 111::INT AS facet FROM events WHERE event_id % 9 IN (0, 5) AND event_id % 11 > 0 AND event_id % 3 > 0 AND event_id % 5 > 0")
def landed_pages(spark, sf_dir):
    """Pages written and read back, of one metal and facet."""
    found = landing.read_pages(spark, landed(spark, sf_dir), metal="Pd4", facet="111")
    return landing.clean_adsorptions(found, cfg.parse(CONFIG)).select("sid", "species", "metal", "facet")


@query("SELECT event_id AS sid, CASE event_id % 9 WHEN 0 THEN 2 ELSE 4 END::INT AS species FROM events WHERE event_id % 9 IN (0, 5) AND event_id % 11 > 0 AND event_id % 3 > 0 AND event_id % 5 = 0")
def stored_nodes(spark, sf_dir):
    """Landed nodes stored by metal and facet; the filters reach the scan."""
    path = _file(spark, "nodes")
    landing.store_nodes(landing.read_pages(spark, landed(spark, sf_dir)), path)
    return landing.clean_adsorptions(landing.read_nodes(spark, path, "Pd4", "100"), cfg.parse(CONFIG)).select("sid", "species")


@query("SELECT event_id % 64 AS page, CASE WHEN event_id % 64 > 0 THEN (event_id % 64 - 1)::VARCHAR END AS after, COUNT(*)::INT AS nodes FROM events GROUP BY 1")
def page_chain(spark, sf_dir):
    """Pages put in the order of their cursors, whatever files they are in."""
    pages = spark.read.schema(landing.PAGE).json(landed(spark, sf_dir))
    info = F.col("data.reactions.pageInfo")
    k = info["endCursor"].cast("long")
    last = pages.agg(F.max(k)).first()[0]
    asked = pages.withColumn("after", F.when(k > 0, (k - 1).cast("string"))).withColumn("data", F.col("data").withField("reactions.pageInfo.hasNextPage", k < last))
    path = _file(spark, "chain")
    asked.repartition(5, F.xxhash64(k)).select(F.to_json(F.struct("data", "after")).alias("value")).write.text(path)
    return landing.read_chain(spark, path).select("page", "after", F.size("nodes").alias("nodes"))


@query("WITH c AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 2 ELSE 4 END::INT AS species FROM events WHERE event_id % 9 IN (0, 5) AND event_id % 11 > 0) SELECT species, event_id AS sid FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY species ORDER BY base64(('Reaction:' || event_id)::BLOB)) <= 7")
def first_of_species(spark, sf_dir):
    """The first seven of each species, by id."""
    return landing.clean_adsorptions(nodes(spark, sf_dir), cfg.parse(CONFIG), limit=7).select("species", "sid")


# Configurations: a text for each row of a table, read by tasks

_SPECIES_LINE = "[species]\nQ = 1, Q2gas, 0.5, Qstar, dissociative, 0\n"
#: Texts and whether they are configurations; @ stands for a number of the row.
_TEXTS = [
    ("whole", CONFIG, True), ("empty", "", True), ("comment", "# nothing @", True), ("later scalar wins", "[bep]\nalpha = 1\nalpha = @", True),
    ("no section", "alpha = @", False), ("unknown section", "[colour]", False), ("no value", "[bep]\nalpha", False), ("no number", "[bep]\nalpha = x@", False), ("unknown key", "[system]\ncolour = @", False), ("facet too large", "[system]\nfacet = 7000@", False),
    ("fields missing", "[species]\nQ@ = 1, -, -", False), ("two bits", "[species]\nQ@ = 3, -, -, -, molecular, -", False), ("unknown role", "[species]\nQ@ = 1, -, -, -, other, -", False),
    ("name twice", _SPECIES_LINE + "Q = 2, -, -, -, molecular, -", False), ("bit twice", _SPECIES_LINE + "R@ = 1, -, -, -, molecular, -", False), ("undeclared species", _SPECIES_LINE + "[bimolecular]\nx = Q, R@, recombination, -", False),
    ("unknown direction", _SPECIES_LINE + "[bimolecular]\nx = Q, Q, sideways@, -", False), ("nine species", "[species]\n" + "".join(f"S{i} = {1 << min(i, 7)}, -, -, -, molecular, -\n" for i in range(9)), False),
]


@query(f"SELECT o_orderkey, o_orderkey % {len(_TEXTS)} IN ({', '.join(str(i) for i, (_, _, ok) in enumerate(_TEXTS) if ok)}) AS accepted FROM orders")
def config_validation(spark, sf_dir):
    own = F.element_at(F.array(*(F.lit(t) for _, t, _ in _TEXTS)), (F.col("o_orderkey") % len(_TEXTS) + 1).cast("int"))
    texts = T.table(spark, sf_dir, "orders").select("o_orderkey", F.replace(own, F.lit("@"), F.col("o_orderkey").cast("string")).alias("text"))
    return cfg.parsed(texts, "text").select("o_orderkey", F.col("error").isNull().alias("accepted"))


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, c): the configuration of each supplier: its species A, with a bit of its nation, and another, and two reactions."""
    k, bit = F.col("s_suppkey").cast("string"), F.expr("cast(shiftleft(1, cast(s_nationkey % 7 as int)) as string)")
    lines = F.concat(F.lit("[species]\nA"), k, F.lit(" = "), bit, F.lit(", Agas, 0.5, Astar, dissociative, "), k, F.lit("\nB = 128, -, -, Bstar, product_only, -\n[bimolecular]\nfirst = A"), k, F.lit(", B, dissociative, ABgas\nsecond = A"), k, F.lit(", A"), k, F.lit(", recombination, A2gas\n"))
    return cfg.parsed(T.table(spark, sf_dir, "supplier").select("s_suppkey", lines.alias("text")), "text")


@query("SELECT s_suppkey, 0::INT AS idx, 'A' || s_suppkey AS name, (1 << (s_nationkey % 7)::INT)::INT AS bit, 'dissociative' AS role FROM supplier UNION ALL SELECT s_suppkey, 1, 'B', 128, 'product_only' FROM supplier")
def config_species(spark, sf_dir):
    return _systems(spark, sf_dir).select("s_suppkey", F.inline("species")).select("s_suppkey", "idx", "name", "bit", "role")


@query("SELECT s_suppkey, v.* FROM supplier, (VALUES (0, 'first', 0, 1), (1, 'second', 0, 0)) AS v(ord, key, species_a, species_b)")
def config_reactions(spark, sf_dir):
    """The species that reactions name, by number."""
    return _systems(spark, sf_dir).select("s_suppkey", F.inline("bimolecular")).select("s_suppkey", "ord", "key", "species_a", "species_b")


@query("SELECT s_suppkey, 'A' || s_suppkey AS species, CASE WHEN s_suppkey % 3 = 0 THEN 2.5 WHEN s_suppkey % 3 = 1 THEN s_suppkey ELSE 1.0 END::DOUBLE AS pressure FROM supplier UNION ALL SELECT s_suppkey, 'B', 1.0::DOUBLE FROM supplier")
def config_pressures(spark, sf_dir):
    """Given pressures win over older ones; unknown older ones are left out."""
    own = _systems(spark, sf_dir).select("s_suppkey", "species")
    k, name = F.col("s_suppkey"), F.concat(F.lit("A"), F.col("s_suppkey").cast("string"))
    given = F.when(k % 3 == 0, F.create_map(name, F.lit(2.5)))
    older = F.create_map(F.when(k % 3 == 2, F.lit("XX")).otherwise(name), k.cast("double"))
    return own.select("s_suppkey", F.explode(cfg.pressures_of("species", given, older)).alias("species", "pressure"))


@query(f"WITH {T.RECORDS_SQL} SELECT COUNT(*) AS records, false AS empty_is_taken FROM records")
def empty_input(spark, sf_dir):
    """A table with rows passes, an empty one is an error."""
    rows = T.records(spark, sf_dir)
    try:
        R.require_rows(rows.where("false"))
        taken = True
    except ValueError:
        taken = False
    return R.require_rows(rows).agg(F.count("*").alias("records")).withColumn("empty_is_taken", F.lit(taken))


# Events as time windows


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf_dir):
    return S.windowed_counts(T.table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 6 HOUR AS "end", COUNT(*) AS n FROM s GROUP BY user_id, session"""
)
def session_events(spark, sf_dir):
    return S.sessions(T.table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


@query("SELECT CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.EVENT_TRANSITIONS.items()) + " END::INT AS transition, COUNT(*) AS n FROM events GROUP BY 1")
def net_transitions(spark, sf_dir):
    return S.net_transitions(T.events(spark, sf_dir), F.col("transition")).select("transition", "n")


@query(f"WITH {T.EVENTS_SQL}, inside AS (SELECT *, ROW_NUMBER() OVER (ORDER BY sim_time, ord) AS n FROM log), {touch_sql([1, 2, 4], 'inside', 'n')} SELECT ord, state_before, state_after FROM replayed")
def event_stream_replay(spark, sf_dir):
    """The log as a stream of files with times in no order; a last row moves the watermark past all."""
    table = T.table(spark, sf_dir, "events")
    own = T.events(spark, sf_dir).select("ord", F.timestamp_seconds("sim_time").alias("time"), "site_idx", "transition")
    first, last = table.select(F.min(F.col("ts").cast("timestamp")).alias("a"), F.max(F.col("ts").cast("timestamp")).alias("z")).selectExpr("unix_seconds(a)", "unix_seconds(z)").first()
    late = last - first + 2
    path = _file(spark, "log")
    own.repartition(4, F.xxhash64("ord")).write.parquet(f"{path}/log")
    spark.range(1).selectExpr("-1L AS ord", f"timestamp_seconds({last + 2 * late}) AS time", "-1L AS site_idx", "0 AS transition").write.mode("append").parquet(f"{path}/log")
    rows = spark.readStream.schema("ord long, time timestamp, site_idx long, transition int").option("maxFilesPerTrigger", 2).parquet(f"{path}/log")
    states = streamed.states(rows, f"{late} seconds")
    run = states.writeStream.format("parquet").option("path", f"{path}/states").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(streamed.STATES).parquet(f"{path}/states").select("ord", "state_before", "state_after").where("ord >= 0")
