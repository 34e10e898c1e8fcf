"""A small search language that compiles to one Spark predicate and can be bound to any table.

``compile_query("cpu > 50 and (foo or bar)", binding)`` returns a Column. Words match names; `and`, `or`, `!`,
parentheses and quotes group; keywords compare numbers, durations and texts. Words beside each other must all
hold, and bind looser than `or`.
"""

from .binding import PROCESS, Attribute, Binding, Kind
from .compiler import compile_query, filter_rows
from .errors import QueryError
from .parser import SearchOptions, parse
from .tree import evaluate

__all__ = ["PROCESS", "Attribute", "Binding", "Kind", "QueryError", "SearchOptions", "compile_query", "evaluate", "filter_rows", "parse"]
