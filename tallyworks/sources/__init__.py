"""Schemas, readers, sinks and the mapping from the star-schema test tables."""
