"""Readers, the panel adapter and sinks."""
