"""Operators on markup: lexer, structure, printer."""
