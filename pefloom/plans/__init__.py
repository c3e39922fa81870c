"""Registered queries and lineage."""
