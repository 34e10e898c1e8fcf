"""The registered queries, by kind, each with its SQL."""
