"""Series identity: every keyed operator accepts one key name or a list of them."""

from __future__ import annotations


def as_keys(keys) -> list[str]:
    """``"site"`` -> ``["site"]``; a sequence -> list; ``None`` -> ``[]``."""
    return [keys] if isinstance(keys, str) else list(keys or [])
