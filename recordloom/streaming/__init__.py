"""Incremental landing of snapshots."""
