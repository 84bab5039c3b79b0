"""Readers and writers for snapshots, alternative data, runs and reports."""
