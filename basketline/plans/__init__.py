"""Pipelines built from the operators, and the registered queries with their oracle SQL."""
