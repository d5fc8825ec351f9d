"""Readers and writers: domain tables, resume files, event logs, test views."""
