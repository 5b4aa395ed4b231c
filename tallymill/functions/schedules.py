"""Schedule formulas as Column arithmetic over epochs and cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def ceil_div(a: Column, b) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.floor((a + b - 1) / b).cast("bigint")


def steps(samples: Column, epochs: int, warmup_epochs: int, batch: int) -> dict[str, Column]:
    """Total, warm-up and per-epoch steps; only the final division rounds up."""
    if epochs <= 0 or batch <= 0 or not 0 <= warmup_epochs <= epochs:
        raise ValueError("need epochs > 0, batch > 0 and 0 <= warmup_epochs <= epochs")
    per = lambda e: F.expr("0").cast("bigint") if e == 0 else ceil_div(samples * e, batch)
    return {"num_steps": per(epochs), "warmup_steps": per(warmup_epochs), "steps_per_epoch": per(1)}


def _shape(p: Column, kind: str) -> Column:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    if kind == "cosine":
        return (F.lit(1.0) - F.cos(p * math.pi)) * 0.5
    if kind == "linear":
        return p
    raise ValueError(f"unknown schedule {kind!r}")


def alpha(
    epoch: Column, cycle: Column, low: float, high: float, cycles_per_epoch: Column, kind: str = "fixed",
    reverse: bool = False, per_epoch: bool = True, warmup_cycles: Column | None = None, total_cycles: Column | None = None,
) -> Column:
    """Mixing concentration at a cycle: held at one end during warm-up, then moving to the other."""
    if kind == "fixed":
        return F.lit(float(low))
    warm = warmup_cycles if warmup_cycles is not None else F.lit(0)
    index = epoch * cycles_per_epoch + cycle
    if per_epoch:
        p = cycle / F.greatest(cycles_per_epoch - 1, F.lit(1))
    else:
        if total_cycles is None:
            raise ValueError("a schedule over the whole run needs total_cycles")
        p = (index - warm) / F.greatest(total_cycles - warm - 1, F.lit(1))
    start, end = (high, low) if reverse else (low, high)
    return F.when(index < warm, F.lit(float(start))).otherwise(F.lit(float(start)) + _shape(p, kind) * (end - start))


def group_size(
    epoch: Column, low: int, high: int, kind: str = "linear", reverse: bool = False, warmup_epochs: int = 0,
    total_epochs: int = 1, cooldown_epochs: int = 0,
) -> Column:
    """Integer group size at an epoch, rounded half up; the cooldown at the end forces 1."""
    if low < 1 or high < low:
        raise ValueError("need 1 <= low <= high")
    if kind == "fixed" or low == high:
        size = F.lit(low)
    else:
        start, end = (high, low) if reverse else (low, high)
        p = (epoch - warmup_epochs) / F.lit(max(1, total_epochs - warmup_epochs - 1))
        moving = F.floor(F.lit(float(start)) + _shape(p, kind) * (end - start) + 0.5).cast("int")
        size = F.when(epoch < warmup_epochs, F.lit(start)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), moving)))
    if cooldown_epochs > 0:
        return F.when(epoch >= max(0, total_epochs - cooldown_epochs), F.lit(1)).otherwise(size)
    return size
