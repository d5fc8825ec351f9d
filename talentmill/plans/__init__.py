"""Composed plans: the table facade, KPI reports and the query catalogue."""
