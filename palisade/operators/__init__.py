"""Reusable DataFrame operators: sliding windows, alert folding, chains, first-seen."""
