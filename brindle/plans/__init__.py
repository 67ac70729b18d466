"""Logical plans: expressions, statements, typing, compilation to Columns, pruning."""
