"""Relational operators over memory records, facts, graphs and vectors."""
