"""Custody of a store's key in a file that only its owner can read."""

from __future__ import annotations

import os
import secrets

from .store import Sealed


class KeyFile:
    """generate, set, get and delete of one key; the file has mode 0600 and is replaced as a whole."""

    def __init__(self, path: str):
        self.path = path

    def present(self) -> bool:
        return os.path.exists(self.path)

    def _put(self, key: str, force: bool) -> None:
        if self.present() and not force:
            raise FileExistsError("a key is there already")
        staged = f"{self.path}.{secrets.token_hex(4)}"
        with open(os.open(staged, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            f.write(key)
        os.replace(staged, self.path)

    def generate(self, force: bool = False) -> Sealed:
        """A new random key of 256 bits; one that is there is kept unless ``force``."""
        self._put(secrets.token_hex(32), force)
        return self.get()

    def set(self, key: str, force: bool = False) -> None:
        if not key.strip():
            raise ValueError("an empty key is none")
        self._put(key.strip(), force)

    def get(self) -> Sealed:
        if not self.present():
            raise FileNotFoundError("no key there")
        with open(self.path) as f:
            return Sealed(f.read())

    def delete(self) -> None:
        """Deleting what isn't there is no fault."""
        if self.present():
            os.remove(self.path)
