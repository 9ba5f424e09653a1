"""Transcripts, control documents and what is written back."""
