"""Argument checks shared by the operators."""

from __future__ import annotations


def positive(name: str, value: int) -> None:
    if value is None or value <= 0:
        raise ValueError(f"{name} must be positive, got {value}")


def fraction(name: str, value: float) -> None:
    if value is None or not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must lie between 0.0 and 1.0, got {value}")


def one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, got {value!r}")
