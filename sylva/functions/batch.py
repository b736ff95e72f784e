"""Batch scripts: a command a line, quoted words, # comments, {key} substitution."""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable, Mapping


def parse(text: str, values: Mapping[str, str] | None = None) -> list[list[str]]:
    """Commands as lists of words; {key} is a value, {{ and }} are braces; an unknown key is an error."""

    def fill(line: str) -> str:
        def one(m: re.Match) -> str:
            if m[0] in ("{{", "}}"):
                return m[0][0]
            if m[1] not in (values or {}):
                raise KeyError(m[1])
            return values[m[1]]

        return re.sub(r"\{\{|\}\}|\{(\w+)\}", one, line)

    found = []
    for line in text.splitlines():
        words = shlex.split(fill(line), comments=True)
        if words:
            found.append(words)
    return found


def run(text: str, commands: Mapping[str, Callable], values: Mapping[str, str] | None = None) -> list:
    """Call each command with its words; key=value words are keyword arguments."""
    out = []
    for name, *words in parse(text, values):
        if name not in commands:
            raise ValueError(f"unknown command: {name}")
        keys = dict(w.split("=", 1) for w in words if re.match(r"^\w+=", w))
        out.append(commands[name](*[w for w in words if not re.match(r"^\w+=", w)], **keys))
    return out
