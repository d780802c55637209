"""Accounting views, the sample-data mapping and the query catalogue."""
