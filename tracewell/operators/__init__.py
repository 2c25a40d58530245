"""Operators over readings, the file index, catalogs, manifests and usage events."""
