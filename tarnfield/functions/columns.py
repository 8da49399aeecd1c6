"""Column expressions for depth, velocity, class, time and URL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfield import config


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """NaN and infinities become NULL, so that no aggregate ever meets them."""
    value = col_of(value).cast("double")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def wet(depth: Column | str, threshold: float = config.DISPLAY_DRY_M, inclusive: bool = False) -> Column:
    depth = col_of(depth)
    return depth >= threshold if inclusive else depth > threshold


def speed(u: Column | str = "u", v: Column | str = "v") -> Column:
    u, v = col_of(u), col_of(v)
    return F.sqrt(u * u + v * v)


def class_index(value: Column, breaks: Column) -> Column:
    """Number of inner breaks strictly below the value."""
    inner = F.slice(breaks, 2, F.greatest(F.size(breaks) - 2, F.lit(0)))
    below = F.size(F.filter(inner, lambda b: b < value))
    return F.least(below, F.greatest(F.size(breaks) - 2, F.lit(0)))


def resource_class(cells: Column) -> Column:
    return (
        F.when(cells <= 250_000, "small")
        .when(cells <= 1_000_000, "medium")
        .when(cells <= 4_000_000, "large")
        .otherwise("very_large")
    )


def output_interval_s(duration_s: Column) -> Column:
    """About 120 frames per run, in whole minutes between one and fifteen."""
    target = F.greatest(F.lit(60.0), duration_s / 119)
    return F.least(F.lit(900), F.greatest(F.lit(60), (F.ceil(target / 60) * 60).cast("int")))


def zoom_stride(zoom: Column) -> Column:
    """Half-up rounding, as the browser rounds."""
    stride = F.floor(6 * F.pow(F.lit(2.0), 18 - zoom) + 0.5)
    return F.greatest(F.lit(1), F.least(F.lit(4096), stride)).cast("int")


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def duration_label(minutes: Column) -> Column:
    whole = F.floor(minutes + 0.5).cast("long")
    clock = F.concat(_two(F.floor(whole % 1440 / 60)), F.lit(":"), _two(whole % 60))
    days = F.floor(whole / 1440)
    return F.when(days > 0, F.concat(days.cast("string"), F.lit("日 "), clock)).otherwise(clock)


NUMERIC_TIME = r"^-?\d+(\.\d+)?$"


def elapsed_label(value: Column, start: Column, fallback: Column) -> Column:
    """Seconds or ISO times become elapsed labels; anything else is shown as it is."""
    numeric = value.rlike(NUMERIC_TIME) & start.rlike(NUMERIC_TIME)
    seconds = F.when(numeric, value.try_cast("double") - start.try_cast("double")).otherwise(
        (F.unix_micros(value.try_cast("timestamp")) - F.unix_micros(start.try_cast("timestamp"))) / 1e6
    )
    label = F.when(seconds.isNotNull(), duration_label(F.greatest(seconds, F.lit(0.0)) / 60))
    return F.coalesce(label, value, F.concat(F.lit("index "), fallback.cast("string")))


def uniform_intensity(total_mm: Column, minutes: Column) -> Column:
    """Mean rate in mm/h; a total that is not positive and finite has none."""
    total = finite(total_mm)
    return F.when((total > 0) & (minutes > 0), total / (minutes / 60))


def official_url(url: Column, host: str) -> Column:
    """https, default port, no credentials, and the host itself or one of its subdomains."""
    name = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.+$", "")
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    ok = (
        (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https")
        & ((name == host) | name.endswith("." + host))
        & port.isin("", "443")
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    )
    return F.coalesce(ok, F.lit(False))


def short_id(prefix: str, parts: list[Column], length: int = 24) -> Column:
    """Truncated SHA-256 of the parts joined by a bar; missing parts are empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def plain_number(value: Column) -> Column:
    """Shortest decimal text of an ordinary measurement (no exponent, no trailing zeros)."""
    fixed = F.format_string("%.9f", value)
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def phase_hash(row: Column, col: Column) -> Column:
    """Stable pseudo-random phase in [0, 1): two 32-bit products, xor-ed, unsigned."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    a = ((row.cast("long") + 1) * 73856093).bitwiseAND(mask)
    b = ((col.cast("long") + 1) * 19349663).bitwiseAND(mask)
    return a.bitwiseXOR(b) / F.lit(4294967296.0)


def nice_numbers(value: Column) -> Column:
    """Readable numbers around a value, closest first (smaller magnitude on ties)."""
    exponent = F.floor(F.log10(F.abs(value)))
    mantissas = F.array(*[F.lit(float(m)) for m in config.NICE_MANTISSAS])
    scaled = F.flatten(
        F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)),
            lambda d: F.transform(mantissas, lambda m: m * F.pow(F.lit(10.0), exponent + d) * F.signum(value)),
        )
    )
    ranked = F.transform(F.array_distinct(scaled), lambda n: F.struct(F.abs(n - value).alias("d"), F.abs(n).alias("m"), n.alias("n")))
    return F.transform(F.array_sort(ranked), lambda s: s["n"])


def hex_colour(rgba: tuple[int, ...]) -> str:
    return "#{:02X}{:02X}{:02X}".format(*rgba[:3])


def depth_colour(index: Column) -> Column:
    """Colour of a depth class."""
    ramp = F.array(*[F.lit(hex_colour(rgba)) for _, rgba in config.DEPTH_BANDS])
    return F.get(ramp, F.least(index, F.lit(len(config.DEPTH_BANDS) - 1)))


def block_colour(size: Column) -> Column:
    """Colour of a block size."""
    table = F.create_map(*[F.lit(v) for k, rgba in config.BLOCK_COLOURS.items() for v in (k, hex_colour(rgba))])
    return F.try_element_at(table, size)


def elevation_colour(index: Column) -> Column:
    """Colour of an elevation class."""
    ramp = F.array(*[F.lit(hex_colour(rgba)) for rgba in config.ELEVATION_COLOURS])
    return F.get(ramp, F.least(index, F.lit(len(config.ELEVATION_COLOURS) - 1)))


def flow_colour(value: Column, low: Column, high: Column) -> Column:
    """Linear colour class of a speed within its display range."""
    colours = F.array(*[F.lit(c) for c in config.FLOW_COLOURS])
    n = len(config.FLOW_COLOURS)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))
    index = F.when(high <= low, n - 1).otherwise(F.least(F.lit(n - 1), F.floor(share * n)))
    return F.get(colours, index.cast("int"))
