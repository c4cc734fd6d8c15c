"""Plans: the football marts (silver, gold, enrich, serve) and the test-table registry."""
