"""Errors that callers can tell apart; a command line prints their text without a trace."""


class QuarryError(Exception):
    """Base of all errors raised on purpose."""


class InvalidInput(QuarryError, ValueError):
    """A parameter, row or file breaks a stated rule."""


class CorpusReadError(QuarryError):
    """A source could not be read; the text names the file and, where known, the line."""


class ModelTrainingError(QuarryError):
    """A model cannot be fitted on the given rows."""


class ModelImportError(QuarryError):
    """A stored model is missing, damaged or of another kind."""


class ModelExportError(QuarryError):
    """A model cannot be written, for example because its folder exists."""
