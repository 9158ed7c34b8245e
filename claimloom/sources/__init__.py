"""Readers and writers of snapshots, vectors and pages."""
