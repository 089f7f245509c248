"""Plans: the engine's pipeline and the query catalogue."""
