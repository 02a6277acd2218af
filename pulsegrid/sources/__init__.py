"""Readers, payload flattening, table maintenance and exports."""
