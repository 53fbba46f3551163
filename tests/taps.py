"""Filter taps by numpy, one size pair at a time: what the kernel tables are compared with."""

import math

import numpy as np
import pandas as pd

ONE = 16383
PHASES = 128


def _cubic(frac: np.ndarray) -> np.ndarray:
    """Weights of the four taps around a fraction (cubic convolution, a = -0.5)."""
    d = np.stack([1 + frac, frac, 1 - frac, 2 - frac], axis=-1)
    near = 1.5 * d**3 - 2.5 * d**2 + 1
    far = -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    return np.stack([far[..., 0], near[..., 1], near[..., 2], far[..., 3]], axis=-1)


def _profile(name: str, x: np.ndarray, sharpen: float) -> np.ndarray:
    """Continuous kernel shapes; ``sharpen`` scales the negative lobes."""
    a = np.abs(x)
    if name == "quality":
        return np.where(a > 2, 0.0, np.where(a < 1, 1 - x * x, -sharpen * (1 - (2 * a - 3) ** 2)))
    if name == "narrow":
        return np.where(a > 1.5, 0.0, np.where(a < 0.5, 1 - (2 * x) ** 2, -sharpen * (1 - (2 * a - 2) ** 2)))
    with np.errstate(divide="ignore", invalid="ignore"):
        lobe = 2 * np.sin(np.pi * x) * np.sin(np.pi / 2 * x) / (np.pi**2 * x * x)
    lobe = np.where(a < 1e-6, 1.0, lobe)
    return np.where(a > 2, 0.0, np.where(a < 1, lobe, sharpen * lobe))


def _half_away(v: np.ndarray) -> np.ndarray:
    return np.trunc(v + np.where(v < 0, -0.5, 0.5)).astype(np.int64)


def _scale_to_one(taps: np.ndarray) -> np.ndarray:
    """Integer rescale so that the taps add up to ONE; the first tap takes the remainder."""
    total = int(taps.sum())
    if total <= 0:
        return taps
    scaled = np.trunc(taps * ONE / total).astype(np.int64)
    scaled[0] += ONE - scaled.sum()
    return scaled


class ResizeTaps:
    """Taps for one size pair and filter: ``bicubic`` (growing) or ``quality``, ``lanczos``, ``narrow`` (shrinking)."""

    def __init__(self, src: int, dst: int, name: str, sharpen: float = 0.0):
        self.src, self.dst, self.name = src, dst, name
        factor = src / dst
        sharpen = min(0.5, max(0.0, sharpen))
        if name == "bicubic":
            self.length, self.offset, self.mult = 4, 1, 1.0
        elif name == "quality":
            self.mult = 1 / (factor - 0.5) if factor < 2 else 1 / ((factor + 1) * 0.5)
            self.length = int(4 * ((factor + 1) * 0.5) + 0.99)
            sharpen = 0.0 if abs(factor - 1) < 0.01 else sharpen
        elif name == "lanczos":
            self.mult, self.length, sharpen = 1 / factor, int(5 * factor), 1 + sharpen * 7
        elif name == "narrow":
            self.mult, self.length, sharpen = 1 / factor, int(4 * factor + 0.99), sharpen / 2
        else:
            raise ValueError(f"unknown filter {name}")
        self.sharpen = sharpen
        if name != "bicubic":
            self.offset = (self.length - 1) // 2

    def weights(self, frac16: np.ndarray) -> np.ndarray:
        """Integer taps (rows) for 16-bit fractions."""
        frac = frac16 / 65535.0
        if self.name == "bicubic":
            raw = _cubic(frac)
        else:
            at = np.arange(self.length) - self.offset - frac[:, None]
            if self.name == "lanczos":
                raw = _profile("lanczos", self.mult * at, self.sharpen)
            else:
                # box of one source pixel, taken at 32 points
                inside = np.linspace(-0.5, 0.5, 32) * self.mult
                raw = _profile(self.name, (self.mult * at)[..., None] + inside, self.sharpen).sum(axis=-1)
        taps = _half_away(ONE * raw / raw.sum(axis=1, keepdims=True))
        taps[:, 0] += ONE - taps.sum(axis=1)
        return taps

    def table(self) -> pd.DataFrame:
        src, dst = self.src, self.dst
        if self.name == "bicubic":
            step = (src << 16) // dst if 1 in (src, dst) else ((src - 1) << 16) // (dst - 1)
            step, start = max(1, step), 0
        else:
            step = (src << 16) // dst + 1
            start = (step - 65536) >> 1
        at = start + step * np.arange(dst, dtype=np.int64)
        whole, frac = at >> 16, at & 0xFFFF
        left = whole < self.offset
        right = ~left & (whole - self.offset + self.length > src)
        inner = ~left & ~right
        phase = np.where(inner, (frac >> 9) * (65535 // (PHASES - 1)), frac)
        taps = self.weights(phase)
        first = whole - self.offset
        out = []
        if inner.any():
            rows = np.flatnonzero(inner)
            out.append((np.repeat(rows, self.length), (first[rows, None] + np.arange(self.length)).ravel(), taps[rows].ravel()))
        for row in np.flatnonzero(left | right):
            cut = int(self.offset - whole[row]) if left[row] else 0
            keep = self.length - cut if left[row] else int(src - whole[row] + self.offset)
            part = _scale_to_one(taps[row, cut:cut + min(keep, src)].copy())
            begin = 0 if left[row] else int(first[row])
            out.append((np.full(len(part), row), begin + np.arange(len(part)), part))
        dst_i, src_i, weight = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"src_size": src, "dst_size": dst, "dst": dst_i, "src": src_i, "weight": weight}).astype("int32")


def gauss_taps(radius: float, least: float = 0.002) -> np.ndarray:
    """Blur taps as far as their weight is above ``least``; a wider radius reaches further."""
    reach = 7
    while math.exp(-(reach**2) / (2 * radius * radius)) > least:
        reach *= 2
    half = np.exp(-(np.arange(1 + reach) ** 2) / (2 * radius * radius))
    half = half / (half[0] + 2 * half[1:].sum())
    half = _half_away(half[half > least] * ONE)
    return _scale_to_one(np.concatenate([half[:0:-1], half]))


def gauss_table(size: int, radius: float) -> pd.DataFrame:
    """Symmetric blur of one side length; cut and rescaled at both ends."""
    full = gauss_taps(radius)
    reach = len(full) // 2
    out = []
    for dst in range(size):
        if dst < reach:
            cut = reach - dst
            part = _scale_to_one(full[cut:cut + min(size, len(full) - cut)].copy())
            first = 0
        elif dst >= size - reach:
            over = dst - (size - reach)
            part, first = _scale_to_one(full[:min(size, len(full) - over - 1)].copy()), dst - reach
        else:
            part, first = full, dst - reach
        out.append(pd.DataFrame({"dst": dst, "src": first + np.arange(len(part)), "weight": part}))
    table = pd.concat(out)
    # a tap past the end of a very short side has no source pixel
    table = table[table["src"] < size]
    return table.assign(src_size=size, dst_size=size)[["src_size", "dst_size", "dst", "src", "weight"]].astype("int32")
