"""Readers and writers: delimited files, encrypted snapshots, mapped star-schema tables."""
