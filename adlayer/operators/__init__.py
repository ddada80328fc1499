"""Operators on DataFrames of energy records, lattices and event logs."""
