"""Readers and writers: post CSVs, message streams, result tables."""
