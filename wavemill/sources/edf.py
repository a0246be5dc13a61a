"""EDF (16-bit) and BDF (24-bit) recordings: bytes in, physical values out."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Multipliers to volts by unit.
UNITS = {"uv": 1e-6, "µv": 1e-6, "mv": 1e-3, "nv": 1e-9, "v": 1.0}


@dataclass
class Recording:
    rate: float
    names: list[str]
    units: list[str]
    values: np.ndarray  # [channel][sample], in the file's units

    def volts(self) -> np.ndarray:
        """Values in volts; channels of other units are left as they are."""
        return self.values * np.array([UNITS.get(u.strip().lower(), 1.0) for u in self.units])[:, None]


def header(data: bytes) -> dict[str, object]:
    """What the header states, without the samples."""
    if len(data) < 256:
        raise ValueError("file too short for an EDF header")
    wide = data[:1] == b"\xff"
    try:
        signals, records, seconds, size = int(data[252:256]), int(data[236:244]), float(data[244:252]), int(data[184:192])
    except ValueError as error:
        raise ValueError("not an EDF header") from error
    if signals <= 0 or seconds <= 0 or len(data) < 256 + 256 * signals:
        raise ValueError("not an EDF header")

    at, fields = 256, {}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("phys_min", 8), ("phys_max", 8), ("dig_min", 8), ("dig_max", 8), ("filter", 80), ("samples", 8)):
        fields[name] = [data[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(signals)]
        at += width * signals
    return fields | {"signals": signals, "records": records, "seconds": seconds, "size": size, "width": 3 if wide else 2}


def read(data: bytes) -> Recording:
    """All ordinary signals, at the rate of the fastest; annotations are left out."""
    h = header(data)
    width, counts = h["width"], np.array([int(x) for x in h["samples"]])
    per_record = int(counts.sum())
    body = np.frombuffer(data, np.uint8, offset=h["size"])
    records = h["records"] if h["records"] >= 0 else len(body) // (per_record * width)
    if records * per_record * width > len(body):
        raise ValueError("EDF file ends early")
    body = body[: records * per_record * width]
    if width == 2:
        values = body.view("<i2").astype(np.float64)
    else:
        parts = body.reshape(-1, 3).astype(np.int32)
        values = (parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16).astype(np.int32)
        values = np.where(values >= 1 << 23, values - (1 << 24), values).astype(np.float64)
    values = values.reshape(records, per_record)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    ordinary = [i for i, name in enumerate(h["label"]) if "Annotations" not in name and name != "Status"]
    if not ordinary:
        raise ValueError("EDF file has no signals")
    most = counts[ordinary].max()
    if any(counts[i] != most for i in ordinary):
        raise ValueError("EDF signals differ in rate")
    out = []
    for i in ordinary:
        low, high, dig_low, dig_high = (float(h[k][i]) for k in ("phys_min", "phys_max", "dig_min", "dig_max"))
        if dig_high == dig_low:
            raise ValueError("EDF signal has no digital range")
        out.append((values[:, cuts[i] : cuts[i + 1]].ravel() - dig_low) * (high - low) / (dig_high - dig_low) + low)
    return Recording(most / h["seconds"], [h["label"][i] for i in ordinary], [h["unit"][i] for i in ordinary], np.array(out))


def write(values: np.ndarray, rate: int, names: list[str], unit: str = "uV", wide: bool = False) -> bytes:
    """A file with records of a second; the tail is filled with zeros."""
    channels, length = values.shape
    records = -(-length // rate)
    padded = np.zeros((channels, records * rate))
    padded[:, :length] = values
    peak = max(1.0, float(np.ceil(np.abs(values).max(initial=0))))
    top = (1 << 23) - 1 if wide else (1 << 15) - 1
    digital = np.rint(padded / peak * top).astype(np.int32)

    def column(items: list[object], width: int) -> bytes:
        return b"".join(str(x).encode("latin-1").ljust(width)[:width] for x in items)

    head = (b"\xffBIOSEMI" if wide else b"0".ljust(8)) + b" " * 160 + b"01.01.2400.00.00" + str(256 + 256 * channels).encode().ljust(8) + b" " * 44
    head += column([records, 1], 8) + str(channels).encode().ljust(4)
    head += column(names, 16) + b" " * 80 * channels + column([unit] * channels, 8)
    for x in (-peak, peak, -top, top):
        head += column([int(x)] * channels, 8)
    head += b" " * 80 * channels + column([rate] * channels, 8) + b" " * 32 * channels
    blocks = digital.reshape(channels, records, rate).transpose(1, 0, 2).ravel()
    if not wide:
        return head + blocks.astype("<i2").tobytes()
    raw = np.stack([blocks & 0xFF, (blocks >> 8) & 0xFF, (blocks >> 16) & 0xFF], 1).astype(np.uint8)
    return head + raw.tobytes()
