"""Readers for landed feeds and stored tables, and the contract writers."""
