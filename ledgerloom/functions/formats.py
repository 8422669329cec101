"""Text forms of figures, for reports."""

from __future__ import annotations


def money(x: float) -> str:
    for size, unit in ((1e9, "bn"), (1e6, "M"), (1e3, "k")):
        if abs(x) >= size:
            return f"{x / size:.2f}{unit}"
    return f"{x:.2f}"


def thousands(n: int) -> str:
    return f"{n:,}"


def duration(hours: float) -> str:
    return f"{hours * 60:.0f}m" if hours < 1 else f"{hours:.1f}h" if hours < 48 else f"{hours / 24:.1f}d"


def short_ns(ns: float) -> str:
    for size, unit in ((1e9, "s"), (1e6, "ms"), (1e3, "µs")):
        if ns >= size:
            return f"{ns / size:.3g}{unit}"
    return f"{ns:.0f}ns"


def wrap(text: str, width: int) -> list[str]:
    import textwrap

    return textwrap.wrap(text, width)


def truncate(text: str, n: int) -> str:
    return text if len(text) <= n else text[: max(0, n - 1)] + "…"


def account_label(key: str) -> str:
    bank, _, account = key.partition("|")
    return f"{account} @ {bank}" if account else key
