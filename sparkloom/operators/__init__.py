"""Operators on whole tables: index maintenance and answers."""
