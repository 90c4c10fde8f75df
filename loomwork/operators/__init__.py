"""Relational operators: ordered folds, and queries over event logs."""
