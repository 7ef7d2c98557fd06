"""Driver tables → fixture views, and the registry of named queries."""
