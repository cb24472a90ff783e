"""Column helpers: the query language's functions as expressions, JVM-side."""

from .semantics import *  # noqa: F403
