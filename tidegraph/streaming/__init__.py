"""Analyses kept up to date over a stream of edges."""
