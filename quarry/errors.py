"""What can go wrong with a statement or a store."""


class EngineError(Exception):
    """Any error that the engine raises itself."""


class ParseError(EngineError):
    """The statement, or a literal in it, cannot be read."""


class UnknownColumn(EngineError):
    """The statement names a column that the table lacks."""


class Unsupported(EngineError):
    """The statement is of a kind that the engine does not answer."""


class StorageError(EngineError):
    """Files of a store are missing or do not fit their manifest."""
