"""Operators that compare, group, pack and search records and texts."""
