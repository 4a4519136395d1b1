"""Query plans over the stored tables, by name, each beside its SQL."""
