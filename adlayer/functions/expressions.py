"""Energies, rates, transitions and labels as Catalyst expressions; each takes and gives columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import METALS, VACANT

# Fixed value: Boltzmann's constant in eV/K.
BOLTZMANN_EV = 8.617333262e-5


def ev_from_mev(mev: Column) -> Column:
    return mev / F.lit(1000.0)


def mev_from_ev(ev: Column) -> Column:
    """Rounded half to even."""
    return F.bround(ev * 1000.0, 0).cast("int")


def activation_ev(energy_ev: Column, real_ea_ev: Column, alpha: float, beta: float) -> Column:
    """The measured barrier as it is, else the linear estimate from the reaction energy, 0 at least."""
    return F.coalesce(real_ea_ev, F.greatest(F.lit(0.0), F.lit(alpha) * energy_ev + F.lit(beta)))


def reverse_ev(ea_ev: Column, energy_ev: Column) -> Column:
    return F.greatest(F.lit(0.0), ea_ev - energy_ev)


def rate(ea_ev: Column, nu: float, temperature: float) -> Column:
    return F.lit(nu) * F.exp(-ea_ev / F.lit(BOLTZMANN_EV * temperature))


def rescaled_q16(k: Column, max_k: Column) -> Column:
    """k as a share of the largest rate at 2^31, rounded half up, 1 to 2^32 - 1; without a positive largest rate the scale is 1."""
    scale = F.when(max_k > 0, F.lit(2.0**31) / max_k).otherwise(F.lit(1.0))
    return F.least(F.greatest(F.round(k * scale).cast("long"), F.lit(1).cast("long")), F.lit(2**32 - 1).cast("long"))


def pack_transition(reactant: Column, product: Column) -> Column:
    return F.shiftleft(reactant, 8).bitwiseOR(product)


def reactant_of(transition: Column) -> Column:
    return F.shiftright(transition, 8).bitwiseAND(F.lit(255))


def product_of(transition: Column) -> Column:
    return transition.bitwiseAND(F.lit(255))


def apply_transition(state: Column, transition: Column) -> Column:
    """The reactant's bits go, the product's come."""
    return state.bitwiseAND(F.bitwise_not(reactant_of(transition))).bitwiseOR(product_of(transition))


def block_and_lane(reaction_id: Column, lanes: int = 32) -> tuple[Column, Column]:
    return F.floor(reaction_id / lanes).cast("int"), (reaction_id % lanes).cast("int")


def is_one_hot(bits: Column) -> Column:
    return F.bit_count(bits) == 1


def magnitude_class(value: Column) -> Column:
    """Place of the highest bit of a positive number."""
    return F.length(F.bin(value)) - 1


def bin_ceiling(bin_id: Column) -> Column:
    """Upper bound of a Q32.32 rate in a magnitude class."""
    return F.pow(F.lit(2.0), F.least(bin_id + 17, F.lit(63)))


def fixed_from_q16(q16: Column) -> Column:
    """Q16.16 as a Q32.32 number, exact."""
    return (q16.cast("decimal(20,0)") * F.lit(65536).cast("decimal(6,0)")).cast("decimal(38,0)")


def fixed_add(a: Column, b: Column) -> Column:
    """Sum of Q32.32 numbers that stops at 2^64 - 1."""
    return F.least((a + b).cast("decimal(38,0)"), F.lit(str(2**64 - 1)).cast("decimal(38,0)"))


def fixed_to_double(raw: Column) -> Column:
    return raw.cast("double") / F.lit(2.0**32)


def waiting_time(u: Column, total: Column) -> Column:
    return -F.log(u) / total


def row_col(site_idx: Column, width: int) -> tuple[Column, Column]:
    return F.floor(site_idx / width).cast("long"), (site_idx % width).cast("long")


def site_at(row: Column, col: Column, width: int, rows: Column | int) -> Column:
    """Site number, null outside the lattice."""
    return F.when((row >= 0) & (col >= 0) & (row < rows) & (col < width), row * width + col)


def hex_x(row: Column, col: Column) -> Column:
    return col + F.when(row % 2 == 1, 0.5).otherwise(0.0)


def hex_y(row: Column) -> Column:
    return row * F.lit(3.0**0.5 / 2)


def metal_index(symbol: Column) -> Column:
    """Number of a tracked metal, else 0."""
    return F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, METALS)), symbol), F.lit(1)) - 1, F.lit(0)).cast("int")


def pure_metal(formula: Column) -> Column:
    """The only element of a formula, else null."""
    elements = F.array_distinct(F.regexp_extract_all(F.coalesce(formula, F.lit("")), F.lit("([A-Z][a-z]?)[0-9]*"), F.lit(1)))
    return F.when(F.size(elements) == 1, F.element_at(elements, 1))


def facet_code(facet: Column) -> Column:
    """A facet of digits as a number of 16 bits, else 0; numbers beyond a long's digits are 0 too."""
    return F.when(facet.rlike("^[0-9]{1,18}$"), facet.try_cast("long").bitwiseAND(F.lit(65535))).otherwise(0).cast("int")


def miller_facet(miller: Column) -> Column:
    """Digits of a Miller index, largest first, without sign; null if one has two digits or there is none."""
    sizes = F.transform(miller, lambda m: F.abs(m))
    return F.when(~F.exists(sizes, lambda m: m >= 10), F.array_join(F.sort_array(sizes, asc=False), ""))


def sid_from_id(opaque_id: Column) -> Column:
    """The number after the last colon of a base64 id, 0 if that fails."""
    decoded = F.try_to_binary(opaque_id, F.lit("base64"))
    return F.coalesce(F.trim(F.substring_index(F.decode(decoded, "UTF-8"), ":", -1)).try_cast("long"), F.lit(0).cast("long"))


def stoichiometry(json: Column) -> Column:
    return F.from_json(json, "map<string,double>")


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def is_corrupt(state: Column, mask: int) -> Column:
    """Neither vacant nor exactly one of the mask's bits."""
    return ~((state == VACANT) | (is_one_hot(state) & (state.bitwiseAND(F.lit(mask)) == state)))


def percent(part: Column, total: Column) -> Column:
    return F.lit(100.0) * part / total


def neighbours(row: Column, col: Column, width: int, rows: Column | int, forward: bool = False) -> Column:
    """Existing neighbours of a site as an array of struct(ord, site): W, E, NW, NE, SW, SE; forward: E, SW, SE only.

    Odd rows lie half a site to the right; edges are open.
    """
    shift = (row % 2).cast("long")
    steps = [(0, F.lit(-1)), (0, F.lit(1)), (-1, shift - 1), (-1, shift), (1, shift - 1), (1, shift)]
    picked = [(i, s) for i, s in enumerate(steps) if not forward or i in (1, 4, 5)]
    made = F.array(*(F.struct(F.lit(i).alias("ord"), site_at(row + dr, col + dc, width, rows).alias("site")) for i, (dr, dc) in picked))
    return F.filter(made, lambda x: x["site"].isNotNull())


def pressure_factor(reactant_a: Column, product_a: Column, product_b: Column, is_bimolecular: Column, pressure: Column) -> Column:
    """The gas pressure that an adsorption goes with; 1 for what starts from occupied sites or ends in two species."""
    neutral = (reactant_a != VACANT) | (is_bimolecular & (product_a != product_b))
    return F.when(neutral, 1.0).otherwise(F.coalesce(pressure, F.lit(1.0)))
