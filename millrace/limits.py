"""Sizes beyond which input is refused, and the errors of doing so."""

from __future__ import annotations

from dataclasses import dataclass


class FormatError(ValueError):
    """Bytes that are no recording, or that exceed a limit."""


@dataclass(frozen=True)
class Limits:
    """Bytes or numbers of things; `need` raises beyond them."""

    body: int = 64 << 20
    decoded: int = 256 << 20
    message: int = 64 << 20
    table: int = 64 << 20
    table_decoded: int = 256 << 20
    table_entries: int = 1 << 20
    entry: int = 8 << 20
    text: int = 1 << 20
    classes: int = 1 << 16
    class_id: int = (1 << 16) - 1
    serializers: int = 1 << 16
    fields: int = 1 << 20
    symbols: int = 1 << 20
    array: int = 1 << 16
    updates: int = 1 << 14
    paths: int = 1 << 16

    def need(self, what: str, actual: int) -> None:
        if actual > getattr(self, what):
            raise FormatError(f"{what}: {actual} exceeds {getattr(self, what)}")
