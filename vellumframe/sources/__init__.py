"""Readers and writers, and what turns decoded texts into rows."""
