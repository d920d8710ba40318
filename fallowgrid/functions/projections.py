"""Map projections as Column expressions, and the reference systems that files name.

A `System` says how degrees of its ellipsoid become plane coordinates.  `forward` and `inverse` give pairs of Columns: series, and a fixed
number of iterations as a fold over a literal array; values that come again are bound once, so expressions stay small.  Transverse Mercator is the Krüger series to the sixth order in the third
flattening, Albers the equal-area cone on the ellipsoid, whose inverse latitude takes a fixed number of Newton steps.  Datums are taken as they are:
systems on one datum (such as SIRGAS 2000 and WGS 84, which agree within centimetres) may be mixed, others not.

A system comes from well-known text (a .prj file, a GeoPackage's table) by `parse`, or from a code by `from_code`.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening.
WGS84, GRS80 = (6378137.0, 298.257223563), (6378137.0, 298.257222101)
#: Names of projections in well-known text.
KINDS = {"transverse_mercator": "tm", "gauss_kruger": "tm", "albers_conic_equal_area": "albers", "albers": "albers", "mercator_auxiliary_sphere": "web", "popular_visualisation_pseudo_mercator": "web", "mercator_1sp": "web"}


@dataclass(frozen=True)
class System:
    """kind: degrees, tm, albers or web; angles in degrees, the rest in metres."""

    kind: str = "degrees"
    axis: float = WGS84[0]
    flattening: float = WGS84[1]
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0


def utm(zone: int, south: bool, ellipsoid: tuple[float, float] = WGS84) -> System:
    return System("tm", *ellipsoid, lon0=6.0 * zone - 183, scale=0.9996, east=500_000.0, north=1e7 if south else 0.0)


def from_code(code: int) -> System:
    """Systems whose codes follow a rule: degrees (4326, 4674), web Mercator, zones on WGS 84 (326zz, 327zz) and on SIRGAS 2000 (31965 to 31985)."""
    if code in (4326, 4674):
        return System(axis=WGS84[0], flattening=WGS84[1] if code == 4326 else GRS80[1])
    if code == 3857:
        return System("web")
    if code // 100 in (326, 327) and 1 <= code % 100 <= 60:
        return utm(code % 100, code // 100 == 327)
    if 31965 <= code <= 31976:  # north: zones 11 to 22
        return utm(code - 31954, False, GRS80)
    if 31977 <= code <= 31985:  # south: zones 17 to 25
        return utm(code - 31960, True, GRS80)
    raise ValueError(f"no rule for the reference system {code}")


def parse(text: str) -> System:
    """The system of well-known text (first version, as .prj files have it); units other than metre and degree are an error."""
    number = r"(-?[\d.]+(?:[eE][-+]?\d+)?)"
    ball = re.search(rf'SPHEROID\[\s*"[^"]*"\s*,\s*{number}\s*,\s*{number}', text, re.I)
    if not ball:
        raise ValueError("no ellipsoid in the reference system")
    own = {"axis": float(ball[1]), "flattening": float(ball[2]) or math.inf}
    kind = re.search(r'PROJECTION\[\s*"([^"]+)"', text, re.I)
    if not kind:
        return System(**own)
    name = kind[1].lower()
    if name not in KINDS:
        raise ValueError(f"no projection {kind[1]}")
    units = re.findall(rf'UNIT\[\s*"[^"]*"\s*,\s*{number}', text, re.I)
    if units and float(units[-1]) != 1:
        raise ValueError("plane coordinates in other units than metres")
    given = {k.lower(): float(v) for k, v in re.findall(rf'PARAMETER\[\s*"([^"]+)"\s*,\s*{number}', text, re.I)}
    pick = lambda *names: next((given[n] for n in names if n in given), 0.0)
    return System(
        KINDS[name], **own, lon0=pick("central_meridian", "longitude_of_center"), lat0=pick("latitude_of_origin", "latitude_of_center"), lat1=pick("standard_parallel_1"), lat2=pick("standard_parallel_2"),
        scale=given.get("scale_factor", 1.0), east=pick("false_easting"), north=pick("false_northing"),
    )


def _third(s: System) -> float:
    f = 1 / s.flattening
    return f / (2 - f)


def _radius(s: System) -> float:
    """Of the circle with the meridian's length."""
    n = _third(s)
    return s.axis / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def kruger(s: System) -> tuple[list[float], list[float]]:
    """The published coefficients of the series there and back, to the sixth order in the third flattening."""
    n = _third(s)
    there = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    )
    back = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    )
    return list(there), list(back)


def _ecc(s: System) -> float:
    f = 1 / s.flattening
    return math.sqrt(f * (2 - f))


def _meridian(s: System, lat: float) -> float:
    """Length from the equator, for the origin of latitudes."""
    e, phi = _ecc(s), math.radians(lat)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi = math.atan(t)
    return _radius(s) * (xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(kruger(s)[0])))


def _cone(s: System) -> tuple[float, float, float]:
    """(n, C, radius at the origin) of the Albers cone."""
    e = _ecc(s)

    def m2(lat: float) -> float:
        return math.cos(math.radians(lat)) ** 2 / (1 - (e * math.sin(math.radians(lat))) ** 2)

    def q(lat: float) -> float:
        sin = math.sin(math.radians(lat))
        return (1 - e * e) * (sin / (1 - (e * sin) ** 2) + (math.atanh(e * sin) / e if e else sin))

    n = math.sin(math.radians(s.lat1)) if s.lat1 == s.lat2 else (m2(s.lat1) - m2(s.lat2)) / (q(s.lat2) - q(s.lat1))
    c = m2(s.lat1) + n * q(s.lat1)
    return n, c, s.axis * math.sqrt(c - n * q(s.lat0)) / n


def _bound(values: dict[str, Column], then) -> Column:
    """`then` of a struct of the values, each computed once however often it is mentioned."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then)[0]


def _fold(start: Column, steps: int, step) -> Column:
    """`step` applied `steps` times."""
    return F.aggregate(F.array(*[F.lit(i) for i in range(steps)]), start, lambda acc, _: step(acc))


def _pair(values: dict[str, Column], then) -> tuple[Column, Column]:
    both = _bound(values, lambda v: F.struct(*[c.alias(k) for k, c in zip("xy", then(v), strict=True)]))
    return both["x"], both["y"]


def forward(s: System, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to plane coordinates."""
    if s.kind == "degrees":
        return lon, lat
    if s.kind == "web":
        return F.radians(lon - s.lon0) * s.axis + s.east, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * s.axis + s.north
    e, sin = _ecc(s), F.sin(F.radians(lat))
    if s.kind == "albers":
        n, c, rho0 = _cone(s)
        q = (1 - e * e) * (sin / (1 - (e * sin) * (e * sin)) + (F.atanh(e * sin) / e if e else sin))
        rho, theta = s.axis * F.sqrt(c - n * q) / n, n * F.radians(lon - s.lon0)
        return rho * F.sin(theta) + s.east, rho0 - rho * F.cos(theta) + s.north
    there, _ = kruger(s)
    r = s.scale * _radius(s)
    low = s.scale * _meridian(s, s.lat0)

    def plane(v: Column) -> tuple[Column, Column]:
        x, y = v["eta"], v["xi"]
        for j, k in enumerate(there, 1):
            x = x + k * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
            y = y + k * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
        return r * x + s.east, r * y - low + s.north

    turn = F.radians(lon - s.lon0)
    angles = _bound({"t": F.sinh(F.atanh(sin) - e * F.atanh(e * sin)), "c": F.cos(turn), "s": F.sin(turn)}, lambda v: F.struct(F.atan2(v["t"], v["c"]).alias("xi"), F.asinh(v["s"] / F.sqrt(v["t"] * v["t"] + v["c"] * v["c"])).alias("eta")))
    return _pair({"xi": angles["xi"], "eta": angles["eta"]}, plane)


def inverse(s: System, x: Column, y: Column, steps: int = 6) -> tuple[Column, Column]:
    """Plane coordinates to degrees; `steps` Newton steps reach the last digits within the projections' usual extent."""
    if s.kind == "degrees":
        return x, y
    if s.kind == "web":
        return F.degrees((x - s.east) / s.axis) + s.lon0, F.degrees(2 * F.atan(F.exp((y - s.north) / s.axis)) - math.pi / 2)
    e = _ecc(s)
    if s.kind == "albers":
        n, c, rho0 = _cone(s)
        sign = 1 if n >= 0 else -1

        def degrees(v: Column) -> tuple[Column, Column]:
            q = (c - (v["dx"] * v["dx"] + v["dy"] * v["dy"]) * (n / s.axis) ** 2) / n

            def newton(acc: Column) -> Column:
                return _bound({"p": acc, "s": F.sin(acc)}, lambda w: w["p"] + F.pow(1 - e * e * w["s"] * w["s"], F.lit(2.0)) / (2 * F.cos(w["p"])) * (q / (1 - e * e) - w["s"] / (1 - e * e * w["s"] * w["s"]) - (F.atanh(e * w["s"]) / e if e else w["s"])))

            phi = _fold(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / 2))), steps, newton)
            return F.degrees(F.atan2(sign * v["dx"], sign * v["dy"]) / n) + s.lon0, F.degrees(phi)

        return _pair({"dx": x - s.east, "dy": rho0 - (y - s.north)}, degrees)
    r = s.scale * _radius(s)
    _, back = kruger(s)

    def sphere(v: Column) -> Column:
        xi, eta = v["xi"], v["eta"]
        for j, k in enumerate(back, 1):
            xi = xi - k * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta - k * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return F.struct(xi.alias("u"), eta.alias("v"))

    conformal = _bound({"xi": (y - s.north + s.scale * _meridian(s, s.lat0)) / r, "eta": (x - s.east) / r}, sphere)

    def geodetic(w: Column) -> tuple[Column, Column]:
        sin = F.sin(w["u"]) / F.cosh(w["v"])
        # isometric to geodetic latitude
        phi = _bound({"psi": F.atanh(sin)}, lambda z: _fold(F.asin(F.tanh(z["psi"])), steps, lambda acc: F.asin(F.tanh(z["psi"] + e * F.atanh(e * F.sin(acc))))))
        return F.degrees(F.atan2(F.sinh(w["v"]), F.cos(w["u"]))) + s.lon0, F.degrees(phi)

    return _pair({"u": conformal["u"], "v": conformal["v"]}, geodetic)


def between(a: System, b: System, x: Column, y: Column) -> tuple[Column, Column]:
    """Coordinates of one system in another."""
    return (x, y) if a == b else forward(b, *inverse(a, x, y))
