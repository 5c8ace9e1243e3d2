"""Readers, schema adapters, dimensions and sinks."""
