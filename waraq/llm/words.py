"""What the operators of this package agree on: words, and what workers keep between tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

import regex

T = TypeVar("T")

#: A word is an unbroken run of letters, digits and combining marks. The class is valid in Java, RE2 and regex.
WORD_CLASS = r"[\p{L}\p{M}\p{Nd}]+"
WORD = regex.compile(WORD_CLASS)


_kept: dict[str, object] = {}


def new_name() -> str:
    """A name under which workers keep what they make from one broadcast."""
    return uuid.uuid4().hex


def kept(name: str, make: Callable[[], T], alone: bool = False) -> T:
    """make() once for each worker process; the last few are kept, or this alone where it is large."""
    if name not in _kept:
        if alone or len(_kept) >= 4:
            _kept.clear()
        _kept[name] = make()
    return _kept[name]
