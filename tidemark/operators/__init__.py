"""Operators on DataFrames: filters, rates, series, views, hierarchies, joins and event-log accounting."""
