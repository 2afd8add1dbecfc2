"""Column expressions: no joins, no actions, usable in any select or filter."""
