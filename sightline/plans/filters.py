"""Path filters of a project: a literal path below the root, or a regular expression."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions import literal_filter, regex_filter


@dataclass(frozen=True)
class PathFilter:
    """``parts`` of a literal path, or a ``pattern``; neither: everything."""

    parts: tuple[str, ...] = ()
    pattern: str | None = None

    @classmethod
    def literal(cls, path: str) -> PathFilter:
        return cls(parts=tuple(p for p in path.split("/") if p))

    @classmethod
    def regex(cls, pattern: str) -> PathFilter:
        """ValueError for what is no pattern, and for look-around and back references."""
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"invalid filter regex {pattern!r}: {e}") from e
        if re.search(r"\(\?<?[=!]|\\[1-9]|\(\?P=", pattern):
            raise ValueError(f"look-around and back references are not supported: {pattern}")
        return cls(pattern=pattern)

    @classmethod
    def choose(cls, literal: str | None, regex: str | None) -> PathFilter | None:
        """At most one of both may be given."""
        if literal is not None and regex is not None:
            raise ValueError("a path filter is either literal or a pattern, not both")
        return cls.literal(literal) if literal is not None else cls.regex(regex) if regex is not None else None

    def validate(self, root: str) -> None:
        """A literal path has to exist below the root; a pattern is tried on what is found."""
        if self.parts and not os.path.exists(os.path.join(root, *self.parts)):
            raise ValueError(f"filter path {'/'.join(self.parts)!r} is not accessible from project root {root}")

    def matches(self, path: str) -> bool:
        """The test of one relative path, for the driver's file list."""
        if self.pattern is not None:
            return bool(re.search(self.pattern, path.replace("\\", "/")))
        own = [p for p in path.split("/") if p not in ("", ".", "..")]
        return tuple(own[: len(self.parts)]) == self.parts

    def column(self, path: Column) -> Column:
        """The same test as a Column."""
        return regex_filter(path, self.pattern) if self.pattern is not None else literal_filter(path, "/".join(self.parts))

    def display(self) -> str:
        return f"re:{self.pattern}" if self.pattern is not None else "/".join(self.parts)
