"""Readers, archive maintenance and the mapping of the given tables to domain tables."""
