"""Indexes that grow while they are searched."""
