"""stepforge: a PySpark engine for building and evaluating reasoning-supervision data."""
