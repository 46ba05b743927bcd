"""Settings. Most of what there is to set is Spark's own."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, fields


@dataclass
class Config:
    """bucket_bits: rows are numbered in buckets of 2 to this power (see operators.frame)."""

    bucket_bits: int = 20


config = Config()


@contextmanager
def settings(**changes):
    """Settings within a with block."""
    known = {f.name for f in fields(Config)}
    if wrong := set(changes) - known:
        raise KeyError(f"no such setting: {', '.join(sorted(wrong))}")
    old = {k: getattr(config, k) for k in changes}
    try:
        for k, v in changes.items():
            setattr(config, k, v)
        yield config
    finally:
        for k, v in old.items():
            setattr(config, k, v)
