"""Schemas and the small fixed dimensions."""

from __future__ import annotations

ENERGIES = "species int, energy_mev int, sid long, real_ea_mev int, metal int, facet int"
BIMOLECULAR = "species_a int, species_b int, energy_mev int, sid long, ea_mev int, metal int, facet int, is_dissociative boolean"
REACTIONS = "reaction_id int, rate_q16 long, bin_id int, transition_a int, transition_b int, is_bimolecular boolean"
SPECIES = "idx int, name string, bit int, gas string, stoich double, product string, role string, oc20_ads_id int"
LATTICE = "site_idx long, state int"
EVENTS = "ord long, sim_time double, site_idx long, reaction_id int"

# Metal numbers are stored in files; 0 is any other.
METALS = ["unknown", "Pd", "Pt", "Cu", "Ni", "Rh", "Ru", "Ag", "Au", "Fe", "Co", "Ir", "Os"]

#: Energy buckets of a species, and the hash classes of its sites.
BUCKETS = 4
#: Species a lattice can have: one bit each.
MAX_SPECIES = 8
LANES = 32
VACANT = 0
