"""Telemetry and event-log analytics on PySpark."""
