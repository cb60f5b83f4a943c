"""Registered queries: the engine over the driver tables, each beside its SQL twin."""
