"""Column expressions: keys, geometry and scalar helpers. All of them stay inside Catalyst."""
