"""Error types raised by the operators."""


class IngestionError(ValueError):
    """An expected failure while taking in source files."""


class FileAccessError(IngestionError):
    """A source file is missing or unreadable."""


class UnsupportedFileTypeError(IngestionError):
    """A file name has an extension that is not accepted."""


class FileTooLargeError(IngestionError):
    """A source exceeds its byte or row limit."""


class MimeMismatchError(IngestionError):
    """A file's extension and content disagree."""


class FileParseError(IngestionError):
    """A file cannot be parsed."""


class SchemaViolationError(IngestionError):
    """The input columns are not the required ones."""


class FormulaInjectionError(IngestionError):
    """A cell would run as a formula in a spreadsheet."""


class CleaningError(ValueError):
    """The frame given to cleaning lacks the required structure."""


class AnalyticsError(Exception):
    """A metric received a malformed frame or parameter."""


class PseudonymizationError(Exception):
    """A column to pseudonymize is missing."""


class AccessError(Exception):
    """An unknown role or view, or an invalid group size."""


class StorageError(Exception):
    """A snapshot is missing, denied, or fails its integrity check."""


class AuditIntegrityError(Exception):
    """The hash chain of the audit table is broken."""


class VisualizationError(ValueError):
    """A chart received a malformed payload."""
