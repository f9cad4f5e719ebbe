"""Queries composed of the operators, their reference SQL and ranking."""
