"""Recognizers for the languages of the corpus: bundled grammars, lexers, and one table-driven parser."""

from .check import LANGUAGES, first_error

__all__ = ["LANGUAGES", "first_error"]
