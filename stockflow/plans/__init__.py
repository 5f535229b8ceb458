"""Query plans: the registry of named queries over the test-data model, their
DuckDB oracle SQL, and multi-operator plans such as procurement."""
