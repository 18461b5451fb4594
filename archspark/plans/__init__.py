"""Operators bound to the tables of a folder. `catalogue` has all of them."""
