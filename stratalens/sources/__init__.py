"""Schemas, landed pages and feeds, registries."""
