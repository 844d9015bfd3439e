"""Readers and writers of volumes, graphs and coordinate files."""
