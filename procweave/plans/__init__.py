"""Registered queries: readings of the driver tables, plans and their SQL oracles."""
