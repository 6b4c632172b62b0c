"""Readers and decoders that turn captured payloads and files into tables."""
