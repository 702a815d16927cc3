"""Aggregates and JSON access as column expressions."""
