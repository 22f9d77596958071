"""Errors of the library."""

from __future__ import annotations


class GraphloomError(Exception):
    """Base of all errors; carries a short code and details for callers."""

    code = "error"

    def __init__(self, message: str = "", **details):
        super().__init__(message)
        self.details = details


class ParseError(GraphloomError):
    code = "parse"


class UnsupportedLanguageError(ParseError):
    code = "unsupported_language"


class StoreError(GraphloomError):
    code = "store"


class NotFoundError(StoreError):
    code = "not_found"


class ValidationError(GraphloomError, ValueError):
    code = "validation"


class QueryError(GraphloomError):
    code = "query"


class ConfigurationError(GraphloomError):
    code = "configuration"


class CircuitOpenError(GraphloomError):
    code = "circuit_open"
