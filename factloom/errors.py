"""Request errors and their codes."""

# The error codes callers of the store know.
INVALID_INPUT = "INVALID_INPUT"
LIMIT_EXCEEDED = "LIMIT_EXCEEDED"
NOT_FOUND = "NOT_FOUND"
SECRET_REJECTED = "SECRET_REJECTED"
EMBEDDING_ERROR = "EMBEDDING_ERROR"
DATABASE_ERROR = "DATABASE_ERROR"

# What errors say: the field, what was found and what would do.
NO_TEXT = "text: none given"
NO_ID = "id: none given"
NO_CHANGE = "nothing to change"
TEXT_TAKEN = "text: a row of this user holds it already"
NEEDS_VECTORS = "embedding: neither a provider nor a column with vectors is given"
NO_TRACE = "a hard delete leaves no row that could hold a reason or a replacement"
TOO_LATE = "later than a hundred years from now"
NOT_YET = "later than now"


def over(what: str, found, most: int) -> str:
    return f"{what}: {found} found, {most} allowed"


def expected(what: str, wanted: str, found=None) -> str:
    return f"{what}: {wanted} is expected" + ("" if found is None else f", {found} found")


def no_row(id) -> str:
    return f"no row has the id {id}"


class RequestError(ValueError):
    """A request that cannot be run as a whole. Errors of single items are result rows instead."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message


def check_limit(limit: int | None, default: int, maximum: int) -> int:
    """The row limit to use: `default` if none is given, an error outside 1..maximum."""
    if limit is None:
        return default
    if limit < 1:
        raise RequestError(INVALID_INPUT, expected("limit", "a number from 1", limit))
    if limit > maximum:
        raise RequestError(LIMIT_EXCEEDED, over("limit", limit, maximum))
    return limit
