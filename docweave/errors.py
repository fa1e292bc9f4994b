"""What can go wrong, as exception classes."""


class DocweaveError(Exception):
    """The base of this package's errors."""


class InvalidArgument(DocweaveError):
    """A request or configuration that can't be served as it is."""


class UnknownResource(InvalidArgument):
    """A resource type that no configuration names."""


class StaleVersion(DocweaveError):
    """A notification whose version isn't above the one that was last accepted."""


class InvalidPageToken(InvalidArgument):
    """A page token that can't be read or belongs to another request."""


class CursorExpired(DocweaveError):
    """A scan that was started too long ago, or whose snapshot is gone."""


class ScanFault(DocweaveError):
    """A scan whose alias doesn't lead to exactly one index of a configured version."""


class RegistrationAborted(DocweaveError):
    """A batch of notifications of which nothing was registered."""


class VersionConflict(DocweaveError):
    """A document write that is older than what the index holds."""
