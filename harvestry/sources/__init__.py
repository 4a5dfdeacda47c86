"""Readers, and the shared folder in which jobs cut their lineage."""
