"""Operators for text that models read and write; nothing else in the library imports this subpackage."""
