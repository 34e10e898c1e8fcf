"""Tables, logs and registries that queries read."""
