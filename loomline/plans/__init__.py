"""Queries over the driver's tables that exercise the catalogue's operators."""
