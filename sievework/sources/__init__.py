"""Scans, ledgers and versioned tables."""
