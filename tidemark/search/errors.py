"""Errors of the search language; their texts are part of its contract."""


class QueryError(ValueError):
    pass


# The texts that users see.
OPEN_QUOTE = "Missing closing quotation"
OPEN_PAREN = "Missing closing parentheses"
LONE_PAREN = "Missing opening parentheses"
EMPTY_GROUP = "No values within parentheses group"
COMPARISON = "Comparison not valid here"
NO_VALUE = "Missing value"
NO_ARGUMENT = "Missing argument for search prefix"
BANG_ALONE = '`!` must be followed by an expression; use `"!"` to match a literal `!`'
BANG_KEYWORD = "`!` cannot be applied to a prefix keyword; use `!=`, `<=`, `>=` or group with `!(...)` instead"
BANG_VALUE = '`!` is reserved; use `"!"` to match the literal character'
INVALID = "Invalid query"
