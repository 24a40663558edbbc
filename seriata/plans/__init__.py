"""Plans: the warehouse end to end, and the registered queries."""
