"""Errors of the engine."""


class AuditError(Exception):
    """Any error of the engine."""


class InvalidQuery(AuditError):
    """A query, filter or event that cannot be run."""


class NotFound(AuditError):
    """No row has the identifier asked for."""


class Unauthorized(AuditError):
    """The caller's scope names no application."""


class UnsupportedFormat(AuditError):
    """A report format without an exporter."""


class DuplicateSequence(AuditError):
    """Two events of one chain have the same sequence number."""


class DuplicateEvent(AuditError):
    """An event's identifier occurs twice."""


class Conflict(AuditError):
    """Another writer changed what this one was about to change."""
