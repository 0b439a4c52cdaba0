"""Operators on the tables of kymo.schema."""
