"""Readers, writers and the derived views the operators run on."""
