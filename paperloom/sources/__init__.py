"""Readers and writers: files, message payloads, tables, snapshots."""
