"""Plans: objectives compiled, sessions, bundles, and the named queries."""
