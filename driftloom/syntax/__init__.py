"""Packrat grammars of source languages and what can be read off a parsed file."""
