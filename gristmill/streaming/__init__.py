"""Folder watching, incremental upserts and event-time windows."""
