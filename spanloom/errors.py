"""Exceptions of the library."""


class SpanloomError(Exception):
    """Base of all."""


class NoTraceIds(SpanloomError):
    """A search found no trace."""


class NoTraces(SpanloomError):
    """No trace could be loaded."""


class OutputExists(SpanloomError):
    """The target of a write is there already."""


class MergeError(SpanloomError):
    """Split traces cannot be merged."""


class InvalidRequest(SpanloomError):
    """A request lacks a field or holds a wrong one."""
