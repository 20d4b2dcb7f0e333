"""Readers, the data set store and sinks."""
