"""Column builders: seeded random numbers and plane geometry."""
