"""Whole queries: review, trash, statistics, scans, renames, notifications."""
