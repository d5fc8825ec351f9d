"""Staffing and talent analytics as PySpark DataFrame jobs."""
