"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from seqlab.functions.exprs import (
    class_name,
    display_name,
    epoch_seconds,
    is_missing,
    is_finite,
    prob_to_label,
    safe_div,
    torque_ratio,
)

__all__ = [
    "class_name",
    "display_name",
    "epoch_seconds",
    "is_missing",
    "is_finite",
    "prob_to_label",
    "safe_div",
    "torque_ratio",
]
