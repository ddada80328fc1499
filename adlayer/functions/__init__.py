"""Column expressions: energies and rates, transitions, labels, hashing."""
