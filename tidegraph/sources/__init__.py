"""Readers, writers and generators of edge lists."""
