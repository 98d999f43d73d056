"""Secrets by name: resolved where a request is made, never held in plans, options or logs."""

from __future__ import annotations

import os
import re
from pathlib import Path

_KEY = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.\-]{0,127}")
MAX_BYTES = 64 * 1024


class SecretError(ValueError):
    """A secret that is missing, misnamed or too large."""


class SecretProvider:
    def get(self, key: str) -> str:
        raise NotImplementedError


class EnvSecrets(SecretProvider):
    def get(self, key):
        value = os.environ.get(key)
        if not value:
            raise SecretError(f"environment variable {key} is not set")
        return value


class StaticSecrets(SecretProvider):
    """For tests and notebooks."""

    def __init__(self, values: dict[str, str]):
        self._values = dict(values)

    def __repr__(self):
        return f"StaticSecrets({sorted(self._values)})"

    def get(self, key):
        if key not in self._values:
            raise SecretError(f"no secret {key!r}")
        return self._values[key]


class FileSecrets(SecretProvider):
    """One file a secret in a folder; links out of it and path components are refused."""

    def __init__(self, folder: str):
        self.folder = Path(folder).resolve()

    def get(self, key):
        if not isinstance(key, str) or not _KEY.fullmatch(key) or ".." in key:
            raise SecretError("a secret's name holds letters, digits, '.', '_' and '-'")
        path = (self.folder / key).resolve()
        if self.folder not in path.parents:
            raise SecretError("a secret's file lies outside its folder")
        if not path.is_file():
            raise SecretError(f"no secret {key!r}")
        if path.stat().st_size > MAX_BYTES:
            raise SecretError(f"secret {key!r} is larger than {MAX_BYTES} bytes")
        return path.read_text(encoding="utf-8").rstrip("\r\n")
