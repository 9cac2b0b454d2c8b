"""Column builders: seeded draws, text rendering, parsing and normalising."""
