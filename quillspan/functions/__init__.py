"""Subpackage of quillspan."""
