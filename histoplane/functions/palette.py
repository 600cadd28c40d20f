"""Colours for categories."""

from __future__ import annotations

import math
from collections.abc import Iterable

# A pair, and public qualitative palettes of nine and twelve colours.
PAIR = ["#1F77B4", "#FF7F0E"]
NINE = ["#E41A1C", "#377EB8", "#4DAF4A", "#984EA3", "#FF7F00", "#FFFF33", "#A65628", "#F781BF", "#999999"]
TWELVE = ["#8DD3C7", "#FFFFB3", "#BEBADA", "#FB8072", "#80B1D3", "#FDB462", "#B3DE69", "#FCCDE5", "#D9D9D9", "#BC80BD", "#CCEBC5", "#FFED6F"]

# Colours of cell types in plots.
CELL_TYPES = [
    "#E5D2DD", "#53A85F", "#F1BB72", "#F3B1A0", "#D6E7A3", "#57C3F3",
    "#476D87", "#E95C59", "#E59CC4", "#AB3282", "#23452F", "#BD956A",
    "#8C549C", "#585658", "#9FA3A8", "#E0D4CA", "#5F3D69", "#C5DEBA",
    "#58A4C3", "#E4C755", "#F7F398", "#AA9A59", "#E63863", "#E39A35",
    "#C1E6F3", "#6778AE", "#91D0BE", "#B53E2B", "#712820", "#DCC1DD",
    "#CCE0F5", "#CCC9E6", "#625D9E", "#68A180", "#3A6963", "#968175",
]


def palette(n: int) -> list[str]:
    """n colours: a fixed pair, parts of the palettes, or evenly spaced hues of one lightness and chroma."""
    if n <= 2:
        return PAIR[:n]
    if n <= 9:
        return NINE[:n]
    if n <= 12:
        return TWELVE[:n]
    return [hue(15 + 360 * i / n) for i in range(n)]


def hue(degrees: float, chroma: float = 100, lightness: float = 65) -> str:
    """A colour of the polar CIE-LUV space (white D65) in sRGB, parts outside its range cut off."""
    at = math.radians(degrees)
    y = ((lightness + 16) / 116) ** 3
    u, v = chroma * math.cos(at) / (13 * lightness) + 0.1978398, chroma * math.sin(at) / (13 * lightness) + 0.4683363
    x = 9 * y * u / (4 * v)
    z = -x / 3 - 5 * y + 3 * y / v
    linear = (3.240479 * x - 1.537150 * y - 0.498535 * z, -0.969256 * x + 1.875992 * y + 0.041556 * z, 0.055648 * x - 0.204043 * y + 1.057311 * z)
    curved = (1.055 * c ** (1 / 2.4) - 0.055 if c > 0.00304 else 12.92 * c for c in linear)
    return "#%02X%02X%02X" % tuple(int(255 * min(max(c, 0), 1) + 0.5) for c in curved)


def type_colours(types: Iterable[str]) -> dict[str, str]:
    """A colour for each cell type in order of its name; more types than there are colours get hues."""
    names = sorted(set(types))
    return dict(zip(names, CELL_TYPES if len(names) <= len(CELL_TYPES) else palette(len(names))))
