"""Checks of arguments that operators share.  Each returns the value it was given, in the type the operator works with."""

from __future__ import annotations

import math
from collections.abc import Collection, Iterable

import numpy as np


def one_of(what: str, value, allowed: Collection[str]) -> str:
    if value not in allowed:
        raise ValueError(f"{what} is {value!r}, not one of {', '.join(map(repr, allowed))}")
    return value


def number(what: str, value, *, above: float = -math.inf, least: float = -math.inf) -> float:
    """A finite number, greater than ``above`` and not less than ``least``."""
    x = float(value)
    if not math.isfinite(x) or x <= above or x < least:
        bound = f" greater than {above:g}" if above > -math.inf else f" not less than {least:g}" if least > -math.inf else ""
        raise ValueError(f"{what} is {x:g}, not a finite number{bound}; it must be " + ("positive" if above == 0 else "nonnegative" if least == 0 else "finite"))
    return x


def whole(what: str, value, least: int = 1) -> int:
    if isinstance(value, bool) or int(value) != value or value < least:
        raise ValueError(f"{what} is {value!r}, not a whole number of {least} or more")
    return int(value)


def interval(what: str, low, high, *, least: float = 0.0) -> tuple[float, float]:
    """A nonempty range whose lower end is not below ``least``."""
    a = number(f"lower end of {what}", low, least=least)
    return a, number(f"upper end of {what}", high, above=a)


def ascending(what: str, values: Iterable[float], *, points: int = 1, least: float = -math.inf) -> np.ndarray:
    """A one-dimensional grid of finite values, each greater than the one before."""
    x = np.asarray(values, float)
    faults = {
        "one-dimensional": x.ndim == 1,
        f"of {points} points or more": x.size >= points,
        "finite": bool(np.isfinite(x).all()),
        f"not below {least:g}": not x.size or not bool((x < least).any()),
        "strictly increasing": x.ndim != 1 or bool((np.diff(x) > 0).all()),
    }
    if broken := [k for k, fine in faults.items() if not fine]:
        raise ValueError(f"{what} must be {', '.join(broken)}")
    return x


def unlike(what: str, values: Iterable) -> list:
    """One value or more, none of them twice."""
    out = list(values)
    if not out:
        raise ValueError(f"{what}: none was given")
    if len(set(out)) < len(out):
        raise ValueError(f"{what} must be unique; repeated: {sorted({str(v) for v in out if out.count(v) > 1})}")
    return out


def among(what: str, names: Iterable[str], known: Collection[str]) -> None:
    if strange := sorted(set(names).difference(known)):
        raise ValueError(f"unknown species in {what}: {', '.join(strange)}")
