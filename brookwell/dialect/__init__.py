"""The SQL-like language: text to a tree of nodes. Two surfaces, SQL's and a shorter one with braces and FIND."""

from .nodes import *  # noqa: F403
from .parser import DialectError, parse  # noqa: F401
