"""Column expressions over bands, terrain, runoff and risk. Everything stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid, kilometres a degree on the sphere, and terrain and runoff constants.
WGS84_A, WGS84_E2 = 6378137.0, 6.69437999014e-3
KM_LON, KM_LAT = 111.320, 110.574
TAN_SLOPE_MIN = 0.001
CN_IMPERVIOUS = 98.0
# Decibels of digital numbers; hazard weights, reaches (m) and tiers; retention (mm) and wet curve numbers.
DN_FACTOR, DN_OFFSET = 20.0, 55.0
HAZARD_LOW, HAZARD_WATER, HAZARD_DENSITY = 0.45, 0.35, 1 / 5
LOW_REACH, WATER_REACH = 18.0, 600.0
TIER_2, TIER_3 = 0.35, 0.55
RETENTION, RETENTION_OFFSET, INITIAL_LOSS, LATER_LOSS = 25400.0, 254.0, 0.2, 0.8
WET_UP, WET_BASE, WET_SLOPE = 23.0, 10.0, 0.13


def as_col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def masked(x: Column, nodata: float | None = None) -> Column:
    """x, with NaN, infinities and the nodata value as null."""
    ok = finite(x.cast("double"))
    return F.when(ok & (x != nodata) if nodata is not None else ok, x)


def floored_mod(x: Column, m: float) -> Column:
    """x modulo m with the sign of m, as array languages define it."""
    return F.pmod(x, F.lit(m))


# bands ------------------------------------------------------------------------------------------------------


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 10.0)


def linear_to_db(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1e-10))) * 10.0


def dn_to_db(dn: Column) -> Column:
    return F.log10(F.greatest(dn, F.lit(1.0))) * DN_FACTOR - DN_OFFSET


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return F.try_divide(a - b, a + b)


def quantise(x: Column, scale: float = 200.0, nodata: int = 255) -> Column:
    """A fraction as a small integer, half to even; nodata for null."""
    return F.coalesce(F.bround(x * scale).cast("int"), F.lit(nodata))


def dequantise(q: Column, scale: float = 200.0, nodata: int = 255) -> Column:
    return F.when(q != nodata, q / scale)


# grid geometry ----------------------------------------------------------------------------------------------


def pixel_lon(c: Column, origin: float, step: float) -> Column:
    return F.lit(origin) + (c + 0.5) * step


def pixel_lat(r: Column, origin: float, step: float) -> Column:
    """step: negative from north to south."""
    return F.lit(origin) + (r + 0.5) * step


def ellipsoid_cell(lat: Column, step_lon: float, step_lat: float) -> tuple[Column, Column, Column]:
    """Width, height (m) and area (m2) of a cell at a latitude (degrees) on the ellipsoid."""
    s = F.sin(F.radians(lat))
    w = F.lit(1.0) - s * s * WGS84_E2
    height = F.lit(WGS84_A * (1 - WGS84_E2)) / F.pow(w, F.lit(1.5)) * math.radians(abs(step_lat))
    width = F.lit(WGS84_A) / F.sqrt(w) * F.cos(F.radians(lat)) * math.radians(abs(step_lon))
    return width, height, width * height


def sphere_cell_km2(lat: Column, step_lon: float, step_lat: float) -> Column:
    return F.cos(F.radians(lat)) * (abs(step_lon) * KM_LON) * (abs(step_lat) * KM_LAT)


def block_id(x: Column, y: Column, size: float) -> Column:
    """'i_j' of the square block of this size that holds (x, y)."""
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def flat_index(r: Column, c: Column, width: int) -> Column:
    return (r.cast("long") * width + c).cast("long")


def web_mercator_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """(x, y) of the map tile that holds a point."""
    n = float(2**zoom)
    x = F.floor((lon + 180.0) / 360.0 * n)
    t = F.tan(F.radians(lat))
    # asinh without cancelling: Spark's is minus infinity far below 0, and coarse next to it
    north = F.signum(t) * F.log1p(F.abs(t) + t * t / (F.sqrt(t * t + 1.0) + 1.0))
    y = F.floor((F.lit(1.0) - north / math.pi) / 2.0 * n)
    return x.cast("int"), y.cast("int")


def utm(lon: Column, lat: Column, zone: int, false_northing: float = 0.0) -> tuple[Column, Column]:
    """Easting and northing (m), by the Krueger series to the sixth order in the third flattening."""
    n = (1 - math.sqrt(1 - WGS84_E2)) / (1 + math.sqrt(1 - WGS84_E2))
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    # Coefficients of the series, lowest power of n first.
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]
    e = math.sqrt(WGS84_E2)
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(zone * 6 - 183)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1.0))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * a
        y = y + F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * a
    return x * (0.9996 * radius) + 500000.0, y * (0.9996 * radius) + false_northing


# terrain ----------------------------------------------------------------------------------------------------


def slope_deg(p: Column, q: Column) -> Column:
    return F.degrees(F.atan(F.hypot(p, q)))


def aspect_deg(p: Column, q: Column) -> Column:
    """Direction of steepest descent in [0, 360), -1 where flat."""
    return F.when((p == 0) & (q == 0), F.lit(-1.0)).otherwise(floored_mod(F.degrees(F.atan2(-p, -q)), 360.0))


def wetness(acc: Column, width: Column, p: Column, q: Column) -> Column:
    """ln of the specific catchment area over the tangent of the slope, the latter not below its floor."""
    return F.log(acc / width / F.greatest(F.hypot(p, q), F.lit(TAN_SLOPE_MIN)))


def hillshade(p: Column, q: Column, azimuth: float = 315, altitude: float = 45) -> Column:
    zenith = math.radians(90 - altitude)
    slope = F.atan(F.hypot(p, q))
    lit = F.cos(slope) * math.cos(zenith) + F.sin(slope) * F.cos(F.lit(math.radians(azimuth)) - F.atan2(-p, -q)) * math.sin(zenith)
    return clip(lit, 0.0, 1.0)


def surface_curvatures(z: dict[int, Column], dx: Column, dy: Column) -> tuple[Column, Column, Column]:
    """General, plan and profile curvature (1 / 100 m, convex is positive) from the 3 x 3 window z[1..9], row by row."""
    xx, yy = ((z[4] + z[6]) / 2 - z[5]) / (dx * dx), ((z[2] + z[8]) / 2 - z[5]) / (dy * dy)
    xy = (z[3] + z[7] - z[1] - z[9]) / (dx * dy * 4.0)
    gx, gy = (z[6] - z[4]) / (dx * 2.0), (z[2] - z[8]) / (dy * 2.0)
    steep = gx * gx + gy * gy
    along = F.when(steep > 0, (xx * gx * gx + yy * gy * gy + xy * gx * gy) * -200.0 / steep).otherwise(0.0)
    across = F.when(steep > 0, (xx * gy * gy + yy * gx * gx - xy * gx * gy) * -200.0 / steep).otherwise(0.0)
    return (xx + yy) * -200.0, across, along


# runoff and scenarios ---------------------------------------------------------------------------------------


def wet_curve_number(cn: Column) -> Column:
    return cn * WET_UP / (cn * WET_SLOPE + WET_BASE)


def runoff(rain: Column, cn: Column) -> Column:
    """Depth of direct runoff by the curve-number method."""
    s = F.lit(RETENTION) / cn - RETENTION_OFFSET
    return F.when(rain > s * INITIAL_LOSS, F.pow(rain - s * INITIAL_LOSS, F.lit(2.0)) / (rain + s * LATER_LOSS)).otherwise(0.0)


def mixed_curve_number(paved: Column, pervious_cn: float) -> Column:
    return paved * CN_IMPERVIOUS + (F.lit(1.0) - paved) * pervious_cn


def hybrid_fraction(anchor: Column, now: Column, then: Column, k: Column) -> Column:
    """The anchor map moved by the scaled change of another source, within [0, 1]."""
    return clip(anchor + k * (now - then), 0.0, 1.0)


def trend(now: Column, then: Column, share: float) -> Column:
    """The change so far carried on by a share, within [0, 1]."""
    return clip(now + (now - then) * share, 0.0, 1.0)


def cagr(first: Column, last: Column, years: Column | float) -> Column:
    return F.pow(last / first, F.lit(1.0) / as_col(years)) - 1.0


def hazard_index(elevation: Column, lowest: Column, water_m: Column, density: Column) -> Column:
    low = F.lit(1.0) - clip((elevation - lowest) / LOW_REACH, 0.0, 1.0)
    near = F.lit(1.0) - clip(water_m / WATER_REACH, 0.0, 1.0)
    # a fifth by division: the product with 0.2 is off by a bit, which decides ties at a tier's limit
    return low * HAZARD_LOW + near * HAZARD_WATER + density / (1 / HAZARD_DENSITY)


def hazard_tier(index: Column) -> Column:
    """1 below TIER_2, 2 below TIER_3, else 3."""
    return F.when(index >= TIER_3, 3).when(index >= TIER_2, 2).otherwise(1)


def growth_risk(grown: Column, low: Column, near: Column) -> Column:
    """0 without growth, else 1 plus the number of hazards."""
    return F.when(grown, F.lit(1) + low.cast("int") + near.cast("int")).otherwise(0)


def impact_class(prone: Column, wetter: Column) -> Column:
    """3 both, 2 more water, 1 flood-prone, 0 neither."""
    return wetter.cast("int") * 2 + prone.cast("int")


# scores -----------------------------------------------------------------------------------------------------


def logit(p: Column) -> Column:
    c = clip(p, 1e-6, 1 - 1e-6)
    return F.log(c / (F.lit(1.0) - c))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.exp(-x) + 1.0)


def prior_corrected(p: Column, prevalence: Column | float) -> Column:
    """The score of a model trained on equal classes, brought to a prevalence."""
    c, pi = clip(p, 1e-6, 1 - 1e-6), as_col(prevalence)
    return c * pi / (c * pi + (F.lit(1.0) - c) * (F.lit(1.0) - pi))


def digitise(x: Column, breaks: list[float]) -> Column:
    """1 plus the number of breaks at or below x."""
    out = F.lit(1)
    for b in breaks:
        out = out + (x >= b).cast("int")
    return out


def quintile(percentile: Column) -> Column:
    return F.least(F.greatest(F.floor(percentile / 20.0), F.lit(0)), F.lit(4)).cast("int")


def f_quantile(share: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution: bisection on the regularised incomplete beta function. A number, made once a job."""

    def beta_share(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta_share(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        return front * fraction(a, b, x)

    def fraction(a: float, b: float, x: float) -> float:
        # the continued fraction, by modified Lentz steps
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 5000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_share(d1 / 2, d2 / 2, mid) < share else (low, mid)
    x = (low + high) / 2
    return d2 * x / (d1 * (1 - x))
