"""Readers and writers: annotations, audio, tables, stores, and atomic publishing."""
