"""Captured payloads and files as tables of raw records."""
