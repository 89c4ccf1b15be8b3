"""Refusals. An answer that cannot be given is an error, never an empty result."""


class Refused(Exception):
    """Base of everything this engine refuses by name."""


class ParseError(Refused):
    """A statement that is not in the language; position is a byte offset into its text."""

    def __init__(self, position: int, found: str, expected: str):
        super().__init__(f"ql: at byte {position}: found {found}, expected {expected}")
        self.position, self.found, self.expected = position, found, expected


class SelectRenamed(ParseError): ...


class JoinNotSupported(ParseError): ...


class TransactionTimeNotYours(ParseError): ...


class NoSearchLimit(ParseError): ...


class NoThreshold(ParseError): ...


class NoDepth(ParseError): ...


class UnboundInstant(Refused): ...


class NoSnapshot(Refused): ...


class NotComparable(Refused): ...


class UnknownOperator(Refused): ...


class CycleFound(Refused): ...


class NoQuery(Refused): ...


class NoLimit(Refused): ...


class FacetTooWide(Refused): ...


class NoFacetBound(Refused): ...


class Unsupported(Refused): ...


class CrossEntity(Refused): ...


class NoEntity(Refused): ...


class NoBound(Refused): ...


class SkewTooLarge(Refused): ...


class NotGranted(Refused): ...


class ReservedTenant(Refused): ...


class UnknownSubject(Refused): ...


class KeyDestroyed(Refused): ...


class UndeclaredLevel(Refused): ...


class TooFewDomains(Refused): ...
