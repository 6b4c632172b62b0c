"""Whole runs built from the operators; what several of their results read is kept while they are built."""
