"""Readers of markup."""
