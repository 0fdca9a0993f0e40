"""Readers and writers of documents, cases and transcripts."""
