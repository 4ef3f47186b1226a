"""Relational and event-time operators."""
