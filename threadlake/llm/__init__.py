"""Operators for text corpora and chat data; nothing outside this subpackage imports it."""
