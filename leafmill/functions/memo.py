"""A bounded memory of a function's results that travels empty to other processes."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """``memo[x]`` is ``f(x)``; everything is forgotten once ``bound`` results are held."""

    def __init__(self, f: Callable, bound: int = 4096) -> None:
        super().__init__()
        self.f, self.bound = f, bound

    def __missing__(self, x):
        if len(self) >= self.bound:
            self.clear()
        y = self[x] = self.f(x)
        return y

    def __reduce__(self):
        return type(self), (self.f, self.bound)
