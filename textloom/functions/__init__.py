"""Subpackage of textloom."""
