"""Readers and writers: scan records, snapshots, listings and report files."""
