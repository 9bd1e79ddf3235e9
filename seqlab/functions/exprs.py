"""Scalar column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_div(num: str | Column, den: str | Column, default: float = 0.0) -> Column:
    """``num / den`` with ``default`` on a zero or null denominator (ANSI-safe)."""
    return F.coalesce(F.try_divide(_c(num), _c(den)), F.lit(default))


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970-01-01 of a TIMESTAMP_NTZ column as a double.

    Built from the calendar fields, so no session time zone enters (a cast to
    TIMESTAMP would apply one).  Equals ``epoch_us(ts) / 1e6``.
    """
    c = F.col(ts)
    micros = (F.unix_date(c.cast("date")).cast("long") * F.lit(86_400_000_000)
              + F.hour(c).cast("long") * F.lit(3_600_000_000)
              + F.minute(c).cast("long") * F.lit(60_000_000)
              + (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long"))
    return micros / F.lit(1e6)


def is_missing(col: str | Column) -> Column:
    """NULL or NaN (CSV NaN arrives as NULL; computed NaN does not)."""
    c = _c(col)
    return c.isNull() | F.isnan(c)


def is_finite(col: str | Column) -> Column:
    """Not NULL, not NaN, not +/-infinity."""
    c = _c(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def prob_to_label(prob: str | Column, threshold: float = 0.5) -> Column:
    """Hard label from a probability: strictly greater than ``threshold`` -> 1."""
    return (_c(prob) > F.lit(threshold)).cast("int")


# Fixed machine constants of the torque-ratio standard formula (values must match
# the workload for equal results): number of cutters, cutter radius [mm],
# cutterhead diameter [m], idle torque M0 [kNm].
N_CUTTERS = 50
CUTTER_RADIUS_MM = 241.3
CUTTERHEAD_DIAMETER_M = 7
M0_KNM = 180


def torque_ratio(advance_force: str | Column, penetration: str | Column,
                 torque: str | Column) -> tuple[Column, Column]:
    """Theoretical torque and the ratio real / theoretical.

    ``Fn = F / n``; ``alpha = acos((r - p) / r)``; ``Ft = tan(alpha / 2) * Fn``;
    ``M = 0.3 * Ft * n * d + M0``.  An out-of-domain ``acos`` yields NaN, as in
    numpy.  The ratio is an IEEE division (NaN/inf propagate, no ANSI error).
    """
    fn = _c(advance_force) / F.lit(float(N_CUTTERS))
    alpha = F.acos((F.lit(CUTTER_RADIUS_MM) - _c(penetration)) / F.lit(CUTTER_RADIUS_MM))
    f_tang = F.tan(alpha / F.lit(2.0)) * fn
    theo = F.lit(0.3) * f_tang * F.lit(float(N_CUTTERS)) * F.lit(float(CUTTERHEAD_DIAMETER_M)) \
        + F.lit(float(M0_KNM))
    ratio = F.when(theo == 0, F.lit(None).cast("double")).otherwise(_c(torque) / theo)
    return theo, ratio


def display_name(name: str | Column) -> Column:
    """Report label of a model name: upper case with underscores removed."""
    return F.upper(F.regexp_replace(_c(name), "_", ""))


# Fixed class names of the binary label (0 = regular, 1 = collapse).
CLASS_NAMES = {0: "regular", 1: "collapse"}


def class_name(label: str | Column, names: dict[int, str] | None = None) -> Column:
    """Class number -> name; an unknown number maps to its own string."""
    names = CLASS_NAMES if names is None else names
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    c = _c(label)
    return F.coalesce(m[c], c.cast("string"))
