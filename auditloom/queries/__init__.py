"""Registered queries with their SQL twins, by area."""
