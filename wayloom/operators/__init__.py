"""Operators over map tables: integrity, rules, graph, routing, search, diff, deltas, display."""
