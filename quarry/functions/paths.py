"""Paths into documents: keys and indexes, as a.b[0].c, for updates.

Dots and brackets are alike; inside brackets a dot is part of the token."""

from __future__ import annotations

from typing import Any

from quarry.errors import InvalidUpdate


class PathError(InvalidUpdate):
    """A path that can't be read or followed."""


def parse(path: str) -> list[str]:
    out, i, n, need = [], 0, len(path), True
    while i < n:
        if path[i] == "[":
            if need:
                raise PathError(f"empty token in {path!r}")
            end = path.find("]", i + 1)
            if end <= i + 1:
                raise PathError(f"bad bracket in {path!r}")
            out.append(path[i + 1 : end])
            i, need = end + 1, False
            if i < n and path[i] not in ".[":
                raise PathError(f"text after a bracket in {path!r}")
            if i < n and path[i] == ".":
                i, need = i + 1, True
            continue
        stop = min((p for p in (path.find(".", i), path.find("[", i)) if p >= 0), default=n)
        if stop == i:
            raise PathError(f"empty token in {path!r}")
        out.append(path[i:stop])
        i, need = stop, False
        if i < n and path[i] == ".":
            i, need = i + 1, True
    if need or not out:
        raise PathError(f"empty token in {path!r}")
    return out


def is_index(token: str) -> bool:
    return token.isascii() and token.isdigit()


def _index(token: str) -> int:
    if not is_index(token):
        raise PathError(f"{token!r} is no index")
    return int(token)


MISSING = object()


def get(value: Any, tokens: list[str]) -> Any:
    """The value at a path, or MISSING."""
    for t in tokens:
        if isinstance(value, dict):
            value = value.get(t, MISSING)
        elif isinstance(value, list) and is_index(t) and int(t) < len(value):
            value = value[int(t)]
        else:
            return MISSING
        if value is MISSING:
            return MISSING
    return value


def put(value: Any, tokens: list[str], new: Any) -> Any:
    """value with new at the path; containers on the way are made, and a null
    slot becomes one. An array is padded with null before an index beyond its end
    only where that index leads further into an array."""
    head, rest = tokens[0], tokens[1:]
    if value is None:
        value = [None] * (int(head) + 1) if is_index(head) else {}
    if isinstance(value, dict):
        old = value.get(head)
        return value | {head: put(old, rest, new) if rest else new}
    if isinstance(value, list):
        i, out = _index(head), list(value)
        if i > len(out):
            raise PathError(f"index {i} is beyond an array of {len(out)}")
        old = out[i] if i < len(out) else None
        made = put(old, rest, new) if rest else new
        return out[:i] + [made] + out[i + 1 :]
    raise PathError(f"{head!r} leads into a scalar")


def drop(value: Any, tokens: list[str]) -> Any:
    """value without what is at the path. What is missing changes nothing."""
    head, rest = tokens[0], tokens[1:]
    if isinstance(value, dict):
        if head not in value:
            return value
        if rest:
            return value | {head: drop(value[head], rest)}
        return {k: v for k, v in value.items() if k != head}
    if isinstance(value, list):
        i = _index(head)
        if i > len(value) or (rest and i == len(value)):
            if rest:
                return value
            raise PathError(f"index {i} is beyond an array of {len(value)}")
        if rest:
            return value[:i] + [drop(value[i], rest)] + value[i + 1 :]
        return value[:i] + value[i + 1 :]
    raise PathError(f"{head!r} leads into a scalar")
