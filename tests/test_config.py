"""The configuration text: what it means and what it rejects."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from adlayer.plans.queries import CONFIG
from adlayer.sources import config as c

SPECIES = "[species]\nO = 1, O2gas, 0.5, Ostar, dissociative, 0\n"


def test_whole_text():
    got = c.parse(CONFIG)
    assert (got.metal, got.facet, got.alpha, got.beta, got.nu, got.temperature) == ("Rh", 211, 0.87, 0.0, 1e13, 298.15)
    assert [(s.name, s.bit, s.gas, s.role, s.oc20_ads_id) for s in got.species][3:] == [("NH", 4, None, "product_only", None), ("NH3", 32, "NH3gas", "molecular", None)]
    assert [(b.species_a, b.species_b, b.direction) for b in got.bimolecular] == [("N", "NO", "recombination"), ("N", "N", "recombination"), ("N", "NH", "dissociative")]


def test_later_scalars_win_and_sections_repeat():
    got = c.parse("[bep]\nalpha = 1 # one\nalpha=2\n[system]\nmetal=Cu\n[bep]\nbeta = -0.5e1\n\n# end")
    assert (got.alpha, got.beta, got.metal) == (2.0, -5.0, "Cu")


@pytest.mark.parametrize(
    "text",
    [
        "[other]", "alpha = 1", "[bep]\nalpha", "[bep]\nalpha = x", "[bep]\ngamma = 1", "[system]\nfacet = 70000", "[system]\nfacet = 1.5", "[system]\ncolour = red",
        "[species]\nO = 1, -, -, -, molecular", "[species]\nO = 3, -, -, -, molecular, -", "[species]\nO = 0x1ff, -, -, -, molecular, -", "[species]\nO = 1, -, -, -, other, -", "[species]\nO = 1, -, y, -, molecular, -", "[species]\nO = 1, -, -, -, molecular, y",
        SPECIES + "O = 2, -, -, -, molecular, -", SPECIES + "P = 1, -, -, -, molecular, -", SPECIES + "[bimolecular]\nx = O, Q, recombination, -", SPECIES + "[bimolecular]\nx = O, O, sideways, -", SPECIES + "[bimolecular]\nx = O, O, recombination",
        SPECIES + f"{'n' * 60} = 2, -, -, -, molecular, -",
    ],
)
def test_rejects(text):
    with pytest.raises(c.ConfigError):
        c.parse(text)


def test_errors_name_their_line():
    with pytest.raises(c.ConfigError, match="line 3: "):
        c.parse("# one\n[bep]\nalpha = x")


def test_nine_species_are_too_many():
    rows = "".join(f"S{i} = {1 << min(i, 7)}, -, -, -, molecular, -\n" for i in range(9))
    with pytest.raises(c.ConfigError, match="9 species"):
        c.parse("[species]\n" + rows)


@given(st.text(alphabet="[]=,#\n abesp0x1.-", max_size=80))
def test_any_text_parses_or_is_rejected(text):
    try:
        c.parse(text)
    except c.ConfigError:
        pass


def test_pressures():
    config = c.parse(CONFIG)
    assert c.resolve_pressures(config, {"NO": 2.0}, {"NO": 9.0, "N": 3.0, "XX": 4.0}) == {"O": 1.0, "N": 3.0, "NO": 2.0, "NH": 1.0, "NH3": 1.0}
    for bad in ({"XX": 1.0}, {"O": -1.0}, {"O": float("nan")}, {"O": float("inf")}):
        with pytest.raises(c.ConfigError):
            c.resolve_pressures(config, bad)


def test_load_and_frames(spark, tmp_path):
    (tmp_path / "a.conf").write_text(CONFIG)
    got = c.load(spark, str(tmp_path / "a.conf"))
    assert got.species_frame(spark).count() == 5
    assert [tuple(r)[2:4] for r in got.bimolecular_frame(spark).orderBy("ord").collect()] == [(1, 2), (1, 1), (1, 3)]
