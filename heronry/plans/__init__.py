"""Compositions: the facade and the query catalogue."""
