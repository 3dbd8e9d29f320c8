"""Leaves of Lua data tables: ``name = { ... }`` files without code."""

from __future__ import annotations

import re
from collections.abc import Iterator

_TOKEN = re.compile(r"""\s*(?:--\[\[.*?\]\]|--[^\n]*)?\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>-?(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+))|(?P<name>[A-Za-z_][\w.]*)|(?P<sign>[{}\[\]=,;()])|(?P<end>$))""", re.DOTALL)


class _Bad(Exception):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    at, out = 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise _Bad
        if m.lastgroup != "end":
            out.append((m.lastgroup, m[m.lastgroup]))
        if m.end() == at:
            break
        at = m.end()
    return out


def leaves(text: str | None) -> list[tuple[list[str], str]]:
    """(path of keys, value) of every leaf below the text's assignments, the assigned name's last part left out; [] if it is not plain data."""
    try:
        return list(_walk(_tokens(text or "")))
    except (_Bad, IndexError):
        return []


def _walk(tokens: list[tuple[str, str]]) -> Iterator[tuple[list[str], str]]:
    """Leaves in order, by one loop over the tokens and a stack of open tables: (key, next list place)."""
    stack: list[list] = []
    key: str | None = None
    at = 0
    while at < len(tokens):
        kind, value = tokens[at]
        nxt = tokens[at + 1][1] if at + 1 < len(tokens) else ""
        if stack and value == "[":
            if tokens[at + 2][1] != "]" or tokens[at + 3][1] != "=":
                raise _Bad
            key, at = _plain(*tokens[at + 1]), at + 4
        elif kind == "name" and nxt == "=":
            key, at = value.rpartition(".")[2] if not stack else value, at + 2
        elif value == "{":
            if stack and key is None:
                key, stack[-1][1] = str(stack[-1][1]), stack[-1][1] + 1
            stack.append([key, 1])
            key, at = None, at + 1
        elif value == "}":
            if not stack or key is not None:
                raise _Bad
            stack.pop()
            at += 1
        elif value in (",", ";") or (not stack and value in ("local", "return")):
            at += 1
        elif stack and (kind in ("text", "number") or value in ("true", "false", "nil")):
            if key is None:
                key, stack[-1][1] = str(stack[-1][1]), stack[-1][1] + 1
            if value != "nil":
                yield [*(k for k, _ in stack[1:]), key], _plain(kind, value)
            key, at = None, at + 1
        else:
            raise _Bad
    if stack:
        raise _Bad


def _plain(kind: str, value: str) -> str:
    return re.sub(r"\\(.)", r"\1", value[1:-1]) if kind == "text" else value
