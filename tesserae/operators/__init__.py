"""Relational and graph operators over label volumes, edge lists and labelings."""
