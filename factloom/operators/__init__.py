"""Fact-log operators, each a DataFrame plan."""
