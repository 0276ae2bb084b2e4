"""Layout of the packed browser-capability string and its parser.

The string holds a one-character version, a separator, one character per
capability flag, then ``;``-separated fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Character offsets (1-based) of the version and the 33 flags.
VERSION_OFFSET = ("version_nbr", 1)
FLAG_NAMES = (
    "fontface", "canvas", "svg", "vidh264", "vidogg", "vidwebm", "webgl", "rtc",
    "rtc_data", "performance", "raf", "json", "haschange", "postmessage",
    "page_vis", "security_pol", "cookies", "cors", "orientation", "motion",
    "touch", "vibration", "fullscreen", "sandboxing", "seamless", "parent_top",
    "framed", "sandboxed", "moz_viz", "vml", "subpixelfont", "ie8_as_ie7",
    "active_x",
)
FIRST_FLAG_OFFSET = 3

# Fixed values: ';'-separated fields 3 to 19, in order.
FIELD_NAMES = (
    "total_iframes", "iframe_order", "frame_depth", "zoom", "pixel_dens",
    "screen_size", "available_size", "viewport", "flash_version",
    "silverlight_version", "unity_version", "do_not_track", "ie_doc",
    "browser_version", "os", "browser_render_engine", "vendor",
)
FIRST_FIELD = 3


def flag_layout() -> list[tuple[str, int]]:
    return [VERSION_OFFSET] + [(n, FIRST_FLAG_OFFSET + i) for i, n in enumerate(FLAG_NAMES)]


def field_layout() -> list[tuple[str, int]]:
    return [(n, FIRST_FIELD + i) for i, n in enumerate(FIELD_NAMES)]


FEATURE_COLUMNS = tuple(n for n, _ in flag_layout()) + FIELD_NAMES


def flag_chars(c: str, layout: list[tuple[str, int]] | None = None) -> list[Column]:
    """One single-character column per (name, offset); past the end -> ''.

    ``c`` is a column name.  Each column is one SQL expression (one call to
    the JVM rather than one per sub-expression: 51 of them per parse).
    """
    return [F.expr(f"substring(`{c}`, {pos}, 1) AS `{name}`") for name, pos in (layout or flag_layout())]


def split_fields(c: str, layout: list[tuple[str, int]] | None = None, sep: str = ";") -> list[Column]:
    """``split_part`` per (name, field number); missing field -> ''."""
    return [F.expr(f"split_part(`{c}`, '{sep}', {n}) AS `{name}`") for name, n in (layout or field_layout())]


def parse_feature_string(c: str) -> list[Column]:
    """All 51 feature columns of a packed string."""
    return flag_chars(c) + split_fields(c)
