"""Queries over the driver's tables, and SQL to hold them against."""
