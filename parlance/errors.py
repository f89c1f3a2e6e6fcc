"""What a verb can't do, by the names that the text protocol prints."""


class VerbError(ValueError):
    code = "io"

    def __init__(self, message: str = "", **facts: object):
        super().__init__(f"{self.code}: {message}" if message else self.code)
        self.facts = facts


class InvalidRef(VerbError):
    code = "invalid-ref"


class AmbiguousRef(VerbError):
    code = "ambiguous-ref"


class NotFound(VerbError):
    code = "not-found"


class OutOfRange(VerbError):
    code = "out-of-range"


class BudgetTooSmall(VerbError):
    code = "budget-too-small"


class MalformedTranscript(VerbError):
    code = "malformed-transcript"


class SemanticUnavailable(VerbError):
    code = "semantic-unavailable"
