"""Vocabulary files of public tokenizers, read on the driver: executors get their content."""

from __future__ import annotations

from functools import cache
from pathlib import Path

import public_tokenizers


@cache
def content(name: str) -> str:
    """A file's text by its name, or by a path of the caller's own."""
    path = Path(name)
    return (path if path.is_absolute() else Path(public_tokenizers.path(name))).read_text()
