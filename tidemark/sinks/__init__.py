"""Where tables and streams go: text tables, dumps."""
