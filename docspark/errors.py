"""Errors that a query can raise when it is compiled; all carry a code and its name."""


class QueryError(ValueError):
    code, code_name = 14, "BadValue"


class BadValue(QueryError):
    pass


class Unsupported(QueryError):
    code, code_name = 238, "NotImplemented"


class DuplicateKey(QueryError):
    code, code_name = 11000, "DuplicateKey"


class ImmutableField(QueryError):
    code, code_name = 66, "ImmutableField"
