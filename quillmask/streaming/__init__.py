"""Redaction of arriving documents, and the state of jobs."""
