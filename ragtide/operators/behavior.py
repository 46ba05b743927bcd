"""Behaviors: methods and properties of named records.

A class registered under a record's name gives its methods and properties to arrays of such records; they get the array
and return one, built of lazy operators. A property or method can have a second form, used on lazy arrays only, named by
the decorators' `lazy`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Any

_registry: dict[str, type] = {}


def register(name: str, cls: type | None = None) -> Any:
    """Also a decorator: @register("point")."""
    if cls is None:
        return lambda c: register(name, c)
    _registry[name] = cls
    return cls


def registered() -> dict[str, type]:
    return dict(_registry)


class lazy_property(property):
    """A property; @x.lazy gives what lazy arrays use in its place. no_dispatch: the plain form serves both."""

    def __init__(self, fget: Callable | None = None, no_dispatch: bool = False):
        super().__init__(fget)
        self.of_lazy = fget if no_dispatch else None

    def lazy(self, fn: Callable) -> lazy_property:
        self.of_lazy = fn
        return self


class lazy_method:
    """The like for methods."""

    def __init__(self, fn: Callable, no_dispatch: bool = False):
        self.fn, self.of_lazy = fn, fn if no_dispatch else None

    def lazy(self, fn: Callable) -> lazy_method:
        self.of_lazy = fn
        return self

    def __get__(self, obj: Any, cls: type | None = None) -> Any:
        return self if obj is None else partial(self.fn, obj)


def lookup(record: str | None, name: str) -> Callable[[Any], Any] | None:
    """What gives the attribute for an array, or None."""
    found = getattr(_registry.get(record or ""), name, None)
    if found is None:
        return None
    if isinstance(found, lazy_property | lazy_method):
        fn = found.of_lazy or (found.fget if isinstance(found, lazy_property) else found.fn)
        return fn if isinstance(found, lazy_property) else lambda array: partial(fn, array)
    if isinstance(found, property):
        return found.fget
    return lambda array: partial(found, array)


def names(record: str | None) -> list[str]:
    cls = _registry.get(record or "")
    return [n for n in vars(cls) if not n.startswith("_")] if cls else []
