"""Relational operators that Spark lacks for the dialect: constraint checks and data changes."""
