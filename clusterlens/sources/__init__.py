"""Readers of snapshots, change logs, samples and settings, and the keyed tables written."""
