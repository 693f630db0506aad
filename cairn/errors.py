"""Errors by kind."""


class CairnError(Exception):
    """Base of all errors of this package."""


class CodecError(CairnError):
    """Bytes that aren't a valid varint, CID, CBOR item, header, block or index."""


class MissingBlock(CairnError):
    """A block is in none of the stores that were asked."""


class Conflict(CairnError):
    """Another writer committed the revision first."""


class NodeNotFound(CairnError):
    """A path isn't in the catalog."""


class NotUnique(CairnError):
    """A drive of this name, origin or id is there already."""


class InvalidSpecifier(CairnError):
    """Not exactly one of id, name and origin was given, or an enum has no such value."""


class Unauthorized(CairnError):
    """A fingerprint has no share."""
