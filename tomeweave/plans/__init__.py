"""Plans: the engine's facade, and the driver's queries with SQL that says the same."""
