"""Operators over data (profile) and over findings (triage, review, gate)."""
