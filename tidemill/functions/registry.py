"""Named extension points: estimators, losses, penalties, scorers, reward managers, parsers, samplers."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    """Names to functions or classes. A second object under a name raises, unless ``overwrite``; the same object may come
    again with ``allow_same``. Unknown names raise with the list of known ones."""

    def __init__(self, kind: str, *, overwrite: bool = False, allow_same: bool = False):
        self.kind, self.overwrite, self.allow_same = kind, overwrite, allow_same
        self._known: dict[str, T] = {}

    def register(self, *names: str) -> Callable[[T], T]:
        def add(thing: T) -> T:
            for name in names:
                old = self._known.get(name)
                if old is not None and not self.overwrite and not (self.allow_same and old is thing):
                    raise ValueError(f"{self.kind} {name!r} is registered already")
                self._known[name] = thing
            return thing

        return add

    def __getitem__(self, name: str) -> T:
        if name not in self._known:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self._known))}")
        return self._known[name]

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def __iter__(self) -> Iterator[str]:
        return iter(self._known)


def load_object(where: str, name: str):
    """An object by ``pkg://package.module`` or by a file's path."""
    if where.startswith("pkg://"):
        module = importlib.import_module(where.removeprefix("pkg://"))
    else:
        spec = importlib.util.spec_from_file_location(f"tidemill_extension_{abs(hash(where))}", where)
        if spec is None or spec.loader is None:
            raise FileNotFoundError(where)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{where} has no {name}")
    return getattr(module, name)
