"""Structured Streaming variants; extras beyond the batch queries."""
