"""Subpackage of citeloom."""
