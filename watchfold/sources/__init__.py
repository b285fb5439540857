"""Schemas, readers, writers, and views of other tables as logs."""
