"""Syntax of source files: lexers, grammars and an error-correcting chart parser."""
