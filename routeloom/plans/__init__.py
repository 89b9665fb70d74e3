"""Query plans: the engine's operators over the star-schema tables, each beside its SQL."""
