"""The pair score: a product of six Gaussian terms, as column expressions over a pair's two sides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.config import DEFAULT, Settings
from farpoint.functions import geo
from farpoint.operators.tables import staged

TERMS = ("T_radius", "T_nls", "T_rcr", "T_ellipticity", "T_orientation", "T_position")
#: Settings that can be columns too, for scoring pairs under many settings at once.
SIGMAS = ("sigma_radius", "sigma_nls", "sigma_rcr", "sigma_ellipticity", "sigma_orientation_deg", "sigma_position_deg")


def gaussian(diff: Column, sigma: Column | float) -> Column:
    q = diff / sigma
    return F.exp(-(q * q))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < geo.inf())


def mod180_difference(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def exit_sigma(sep: Column, e: Column, orientation_unc: Column, ellipticity_unc: Column) -> Column:
    """Degrees: the bearing's error across the track and the ellipticity's along it, combined."""
    across = F.radians(sep) * F.sin(F.least(F.radians(orientation_unc), F.lit(math.pi / 2)))
    f = F.greatest(e, F.lit(1.001))
    along = 2.0 / (f * f * F.sqrt(F.greatest(1.0 - 1.0 / (f * f), F.lit(1e-12)))) * ellipticity_unc
    return F.degrees(F.greatest(F.sqrt(across * across + along * along), F.lit(1e-6)))


def exits(v: geo.Vec, e: Column, orientation: Column) -> tuple[geo.Vec, geo.Vec]:
    """Where the shape says the other end lies, on either bearing of its axis."""
    arc = F.radians(geo.separation_from_ellipticity(e))
    at = F.radians(90.0 - orientation)
    return geo.destination(v, at, arc), geo.destination(v, at + math.pi, arc)


def with_exits(df: DataFrame, lon: str = "lon_deg", lat: str = "lat_deg", ellipticity: str = "ellipticity", orientation: str = "orientation_deg", prefix: str = "e") -> DataFrame:
    """``df`` with the two ends that each row's shape points to, as ``prefix``1x to ``prefix``2z; null without a shape.

    Step by step, so that each value is computed once for each row instead of once for each place that it stands in.
    """
    c = F.col
    e = F.when(finite(c(ellipticity)), F.greatest(c(ellipticity), F.lit(1.0)))
    df = df.withColumns({"__arc": F.radians(geo.separation_from_ellipticity(e)), "__at": F.radians(90.0 - c(orientation)), "__la": F.radians(c(lat)), "__lo": F.radians(c(lon))})
    df = df.withColumns({"__sl": F.sin("__la"), "__cl": F.cos("__la"), "__sa": F.sin("__arc"), "__ca": F.cos("__arc"), "__sb": F.sin("__at"), "__cb": F.cos("__at")})
    for k, sign in ((1, 1.0), (2, -1.0)):
        df = df.withColumn("__s", geo.clip(c("__sl") * c("__ca") + c("__cl") * c("__sa") * c("__cb") * sign, -1, 1))
        df = df.withColumns({"__to": c("__lo") + F.atan2(c("__sb") * c("__sa") * c("__cl") * sign, c("__ca") - c("__sl") * c("__s")), "__c": F.sqrt(F.lit(1.0) - c("__s") * c("__s"))})
        df = df.withColumns({f"{prefix}{k}x": c("__c") * F.cos("__to"), f"{prefix}{k}y": c("__c") * F.sin("__to"), f"{prefix}{k}z": c("__s")})
    return df.drop("__arc", "__at", "__la", "__lo", "__sl", "__cl", "__sa", "__ca", "__sb", "__cb", "__s", "__to", "__c")


def with_parts(pairs: DataFrame, side: Callable[[str, str], Column], sep: str, ends: dict[str, str]) -> DataFrame:
    """``pairs`` with chord_length_m, expected_ellipticity and what the terms are made of, as columns __*: all that no sigma changes.

    side(name, "a" or "b"): the column of one end. ends: for "a" and "b" the prefix of the unit vector's columns, below
    which ``with_exits`` has left the ends that its shape points to. Missing values are null or not finite; a term that
    lacks what it needs is 1, so it is 0 off. What costs is computed only where a term needs it, each end in a step of
    its own (``staged``).
    """
    v = {s: geo.vec(ends[s] + "v") for s in "ab"}
    df = pairs.withColumns({"expected_ellipticity": geo.expected_ellipticity(F.col(sep)), "chord_length_m": geo.chord_from_separation(F.col(sep))})
    df = df.withColumns({f"__ok_{s}": F.coalesce(side("shape_reliable", s), F.lit(False)) & finite(side("ellipticity", s)) for s in "ab"})
    expected, one = F.col("expected_ellipticity"), F.lit(1.0)
    ok = {s: F.col(f"__ok_{s}") for s in "ab"}
    sharp = {s: finite(side("orientation_deg", s)) & (side("ellipticity", s) > 1.05) for s in "ab"}
    df = df.withColumns({"__radius": F.abs(side("radius_m", "a") - side("radius_m", "b")), "__nls": side("nls", "a") - side("nls", "b"), "__rcr": side("rcr", "a") - side("rcr", "b")})
    df = staged(df)
    for s, t in ("ab", "ba"):
        tmp: dict[str, Column] = {}
        known = finite(side("orientation_unc_deg", s)) & finite(side("ellipticity_unc", s))
        has = ok[s] & (side("ellipticity", s) >= 1.0)
        tmp[f"__known_{s}"] = known
        tmp[f"__sigma_{s}"] = F.when(has & known, exit_sigma(F.col(sep), side("ellipticity", s), side("orientation_unc_deg", s), side("ellipticity_unc", s)))
        # the nearer end is the one with the larger cosine
        nearer = F.greatest(*[geo.vec(f"{ends[s]}e{k}").dot(v[t]) for k in "12"])
        tmp[f"__off_{s}"] = F.when(has, F.degrees(F.acos(F.greatest(F.least(nearer, one), F.lit(-1.0)))))
        tmp[f"__turn_{s}"] = F.when(ok["a"] & ok["b"] & sharp["a"] & sharp["b"], mod180_difference(side("orientation_deg", s), geo.pair_bearing(v[s], v[t]))).otherwise(F.lit(0.0))
        tmp[f"__shape_{s}"] = F.when(ok[s], F.when(expected < geo.inf(), side("ellipticity", s) - expected).otherwise(geo.inf())).otherwise(F.lit(0.0))
        df = staged(df.withColumns(tmp))
    return df


def position_sigma(s: str, get: Callable[[str], Column]) -> Column:
    return F.when(F.col(f"__known_{s}"), F.col(f"__sigma_{s}")).otherwise(get("sigma_position_deg"))


def at_most(get: Callable[[str], Column]) -> Column:
    """A pair's score by one exponential of its ``with_parts``, and a billionth: never below its product of terms. Null where that is, or where parts lack."""
    off = sum(((F.col(f"__{c}") / get(f"sigma_{c}")) * (F.col(f"__{c}") / get(f"sigma_{c}")) for c in ("radius", "nls", "rcr")), F.lit(0.0))
    for c, sigma in (("shape", "sigma_ellipticity"), ("turn", "sigma_orientation_deg")):
        off = off + (F.col(f"__{c}_a") * F.col(f"__{c}_a") + F.col(f"__{c}_b") * F.col(f"__{c}_b")) / (get(sigma) * get(sigma))
    q = {s: F.col(f"__off_{s}") / position_sigma(s, get) for s in "ab"}
    p = {s: q[s] * q[s] for s in "ab"}
    return F.exp(-off - F.when(p["a"].isNotNull() & p["b"].isNotNull(), (p["a"] + p["b"]) / 2.0).otherwise(F.coalesce(p["a"], p["b"], F.lit(0.0)))) + 1e-9


def with_product(df: DataFrame, settings: Settings | Callable[[str], Column] = DEFAULT) -> DataFrame:
    """``df``, which has the columns of ``with_parts``, with T_* and score. settings: values, or a function that gives a column for each of ``SIGMAS``."""
    get = settings if callable(settings) else lambda n: F.lit(float(getattr(settings, n)))
    p = {s: gaussian(F.col(f"__off_{s}"), position_sigma(s, get)) for s in "ab"}
    df = df.withColumns({f"__p_{s}": c for s, c in p.items()})
    both = lambda c, sigma: gaussian(F.col(f"__{c}_a"), get(sigma)) * gaussian(F.col(f"__{c}_b"), get(sigma))
    pa, pb = F.col("__p_a"), F.col("__p_b")
    df = df.withColumns({f"T_{c}": gaussian(F.col(f"__{c}"), get(f"sigma_{c}")) for c in ("radius", "nls", "rcr")} | {
        "T_ellipticity": both("shape", "sigma_ellipticity"),
        "T_orientation": both("turn", "sigma_orientation_deg"),
        "T_position": F.when(pa.isNotNull() & pb.isNotNull(), F.sqrt(pa * pb)).otherwise(F.coalesce(pa, pb, F.lit(1.0))),
    })
    total = F.lit(1.0)
    for t in TERMS:
        total = total * F.col(t)
    return df.withColumn("score", total).drop(*[c for c in df.columns if c.startswith("__")])


def with_terms(pairs: DataFrame, side: Callable[[str, str], Column], sep: str, ends: dict[str, str], settings: Settings | Callable[[str], Column] = DEFAULT) -> DataFrame:
    """``pairs`` with T_*, score, chord_length_m and expected_ellipticity (see ``with_parts`` and ``with_product``)."""
    return with_product(with_parts(pairs, side, sep, ends), settings)


def freshness(nls: Column, rcr: Column, settings: Settings = DEFAULT) -> Column:
    """Of 1: the strength above 1 and the rim's contrast, each on its scale and cut to 0..1."""
    s = geo.clip((nls - 1.0) / (settings.nls_scale - 1.0), 0, 1)
    return settings.weight_strength * s + settings.weight_contrast * geo.clip(rcr / settings.rcr_scale, 0, 1)


def relative_strength(strength: Column, threshold: Column) -> Column:
    return strength / F.greatest(threshold, F.lit(1e-30))
