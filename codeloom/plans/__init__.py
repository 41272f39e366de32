"""Plans: whole builds and the queries over the driver's tables."""
