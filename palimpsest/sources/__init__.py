"""Readers and writers. Schemas are declared, every reader returns a DataFrame."""
