"""Readers and writers: NDJSON signals, OTLP/JSON, scrapes, topology, bronze and silver tables."""
