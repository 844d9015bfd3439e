"""Multi-step plans and the query catalogue."""
