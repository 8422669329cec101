"""Settings from a ``.env`` file."""

from __future__ import annotations

import os


def load_env(path: str = ".env", environ=os.environ) -> dict[str, str]:
    """Set what the file names and the environment lacks; a missing file sets nothing. Returns what was set."""
    done: dict[str, str] = {}
    try:
        with open(path) as f:
            lines = f.read().splitlines()
    except FileNotFoundError:
        return done
    for line in lines:
        key, sep, value = line.strip().partition("=")
        if not sep or key.startswith("#"):
            continue
        key, value = key.strip(), value.strip().strip("\"'")
        if key not in environ:
            environ[key] = done[key] = value
    return done
