"""Raster file formats: geometry, file names, and decoding of one file's bytes."""

from __future__ import annotations

import io
import math
import zipfile
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Format:
    name: str
    raw: int  # samples across in the file
    size: int  # samples across in memory
    degrees: float
    utm: bool = False
    appended: bool = False  # neighbours' edges are appended rather than copied over

    @property
    def per_degree(self) -> float:
        return self.raw / self.degrees if self.name.startswith("CUSTOM") else (self.size - 1) / self.degrees

    @property
    def kind(self) -> str:
        return self.name.split("-")[0] if self.name.startswith("CUSTOM") else self.name


# The sizes of the public formats.
FORMATS = {
    f.name: f
    for f in (
        Format("SRTM", 1201, 1201, 1),
        Format("SRTM30", 3601, 3601, 1),
        Format("NED1-ZIP", 3612, 3601, 1),
        Format("NED13", 10812, 10801, 1),
        Format("NED13-ZIP", 10812, 10801, 1),
        Format("NED19", 8112, 8101, 0.25),
        Format("3DEP-1M", 10012, 10001, 1, utm=True),
        Format("GLO30", 3600, 3601, 1, appended=True),
        Format("FABDEM", 3600, 3601, 1, appended=True),
    )
}
#: GLO30 files narrow towards the poles: from this latitude on (or below its negative), so many samples.
GLO_WIDTHS = ((85, 360), (80, 720), (70, 1200), (60, 1800), (50, 2400), (0, 3600))


def parse_format(name: str) -> Format | None:
    """A format by name; CUSTOM-<degrees>-<samples> needs degrees that divide one."""
    if name in FORMATS:
        return FORMATS[name]
    parts = name.split("-")
    if len(parts) != 3 or parts[0] != "CUSTOM":
        return None
    try:
        degrees, samples = float(parts[1]), int(parts[2])
    except ValueError:
        return None
    if not 0 < degrees <= 1 or samples <= 0 or abs(1 / degrees - round(1 / degrees)) > 1e-3:
        return None
    return Format(name, samples, samples + 1, degrees, appended=True)


def hundredths(x: float) -> int:
    return int(math.floor(100 * abs(x - int(x)) + 0.5))


def glo_width(min_lat: float) -> int:
    return next(width for edge, width in GLO_WIDTHS if min_lat >= edge or min_lat < -edge or not edge)


def file_name(fmt: Format, min_lat: float, min_lng: float, zone: int = 0) -> str:
    """The name of a tile's file.  SRTM, GLO30 and FABDEM are named by the south-west corner, the rest by the north-west."""
    top, lat, lng = min_lat + fmt.degrees, abs(int(min_lat)), abs(int(min_lng))
    north, east = "ns"[min_lat < 0], "ew"[min_lng < 0]
    up = abs(int(top))
    match fmt.kind:
        case "SRTM" | "SRTM30":
            return f"{north.upper()}{lat:02d}{east.upper()}{lng:03d}.hgt"
        case "FABDEM":
            return f"{north.upper()}{lat:02d}{east.upper()}{lng:03d}_FABDEM_V1-0.flt"
        case "GLO30":
            return f"Copernicus_DSM_COG_10_{north.upper()}{lat:02d}_00_{east.upper()}{lng:03d}_00_DEM.flt"
        case "NED1-ZIP" | "NED13-ZIP":
            return f"{north}{up:02d}{east}{lng:03d}.zip"
        case "NED13":
            return f"USGS_13_{north}{up:02d}{east}{lng:03d}.flt"
        case "NED19":
            return f"ned19_{north}{up:02d}x{hundredths(top):02d}_{east}{lng:03d}x{hundredths(min_lng):02d}.flt"
        case "3DEP-1M":
            return f"USGS_1M_{zone:02d}_x{int(min_lng):02d}y{int(min_lat):03d}.flt"
        case "CUSTOM":
            sign = "-" if int(top) < 0 else ""
            return f"tile_{sign}{up:02d}x{hundredths(top):02d}_{'-' if min_lng < 0 else ''}{lng:03d}x{hundredths(min_lng):02d}.flt"
    raise ValueError(fmt.name)


def member_name(fmt: Format, min_lat: float, min_lng: float) -> str:
    """The raster inside a NED zip file."""
    return f"float{file_name(fmt, min_lat, min_lng)[:-4]}_{'13' if fmt.name == 'NED13-ZIP' else '1'}.flt"


def parse_name(fmt: Format, name: str) -> tuple[float, float] | None:
    """(min_lat, min_lng) of a file by its name; None for other files."""
    import re

    signed = lambda s, whole, part=0: (int(whole) + int(part) / 100) * (-1 if s in ("S", "s", "W", "w", "-") else 1)
    match fmt.kind:
        case "SRTM" | "SRTM30":
            pattern = r"([NS])(\d{2})()([EW])(\d{3})()\.hgt"
        case "FABDEM":
            pattern = r"([NS])(\d{2})()([EW])(\d{3})()_FABDEM_V1-0\.flt"
        case "GLO30":
            pattern = r"Copernicus_DSM_COG_10_([NS])(\d{2})_(00)_([EW])(\d{3})_(00)_DEM\.flt"
        case "NED1-ZIP" | "NED13-ZIP":
            pattern = r"([ns])(\d{2})()([ew])(\d{3})()\.zip"
        case "NED13":
            pattern = r"USGS_13_([ns])(\d{2})()([ew])(\d{3})()\.flt"
        case "NED19":
            pattern = r"ned19_([ns])(\d{2})x(\d{2})_([ew])(\d{3})x(\d{2})\.flt"
        case "CUSTOM":
            pattern = r"tile_(-?)(\d{2})x(\d{2})_(-?)(\d{3})x(\d{2})\.flt"
        case "3DEP-1M":
            m = re.fullmatch(r"USGS_1M_(\d{2})_x(\d{2})y(\d{3})\.flt", name)
            return (float(m[3]), float(m[2])) if m else None
    m = re.fullmatch(pattern, name)
    if not m:
        return None
    lat, lng = signed(m[1], m[2], m[3] or 0), signed(m[4], m[5], m[6] or 0)
    named_by_top = fmt.kind in ("NED1-ZIP", "NED13-ZIP", "NED13", "NED19", "CUSTOM")
    return (lat - fmt.degrees if named_by_top else lat), float(lng)


def decode(fmt: Format, data: bytes, min_lat: float = 0.0, min_lng: float = 0.0) -> np.ndarray:
    """Rows of samples as float32, no data as NaN.  Files of the wrong size are an error."""
    if fmt.name.endswith("-ZIP"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            inside = {n.rsplit("/", 1)[-1].lower(): n for n in z.namelist()}
            data = z.read(inside[member_name(fmt, min_lat, min_lng).lower()])
    width, height = (glo_width(min_lat), fmt.raw) if fmt.name == "GLO30" else (fmt.raw, fmt.raw)
    kind = np.dtype(">i2" if fmt.name.startswith("SRTM") else "<f4")
    if len(data) != width * height * kind.itemsize:
        raise ValueError(f"{fmt.name}: {len(data)} bytes, expected {width * height * kind.itemsize}")
    out = np.frombuffer(data, kind).reshape(height, width).astype(np.float32)
    if fmt.name.startswith("SRTM"):
        out[out == -32768] = np.nan
        return out
    if fmt.name == "GLO30":
        if width * 3 == fmt.raw * 2:  # two samples to three: the first of each pair twice
            out = np.repeat(out, np.tile([2, 1], width // 2), axis=1)
        else:
            out = np.repeat(out, fmt.raw // width, axis=1)
        out[(np.abs(out + 32767) < 0.01) | (np.abs(out + 9999) < 0.01)] = np.nan
        return out
    if fmt.name == "FABDEM":
        out[np.abs(out + 9999) < 0.01] = np.nan
        return out
    if not fmt.appended:  # all but one sample of the overlap goes
        border = (fmt.raw - fmt.size + 1) // 2
        out = out[border : border + fmt.size, border : border + fmt.size].copy()
    out[out < -9998] = np.nan
    return out


def check_bounds(fmt: Format, *bounds: float) -> None:
    """Bounds must be multiples of the tile's size."""
    for b in bounds:
        if abs(b / fmt.degrees - round(b / fmt.degrees)) * fmt.degrees > 1e-3:
            raise ValueError(f"{b} is not a multiple of {fmt.degrees}")
