"""Image kernels on numpy arrays (height x width, or height x width x 3 in BGR order).

They run inside one ``mapInPandas``/Arrow pass (see ``lumenframe.plans.pipeline``), on
what the JVM's image source has decoded. Borders are mirrored without repeating the
edge, unless said otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Shares of blue, green and red in luma, of 2 to the power of 14.
LUMA = np.array([1868, 9617, 4899])


def to_uint8(image: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def to_gray(image: np.ndarray) -> np.ndarray:
    """Luma in whole numbers, halves up."""
    return image if image.ndim == 2 else ((image[..., :3].astype(np.int64) @ LUMA + (1 << 13)) >> 14).astype(np.uint8)


def per_channel(image: np.ndarray, f) -> np.ndarray:
    return f(image) if image.ndim == 2 else np.stack([f(image[..., k]) for k in range(image.shape[2])], axis=-1)


# Linear RGB to XYZ (D65 white) and its white point; bounds and slopes of the CIE curves.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])
_CIE_BOUND, _CIE_SLOPE = 0.008856, 7.787


def to_lab(image: np.ndarray) -> np.ndarray:
    """BGR bytes as CIE L, a, b bytes: L times 255/100, a and b plus 128."""
    rgb = image[..., 2::-1].astype(float) / 255
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    ratio = linear @ _XYZ.T / _WHITE
    curve = np.where(ratio > _CIE_BOUND, np.cbrt(ratio), _CIE_SLOPE * ratio + 16 / 116)
    x, y, z = (curve[..., k] for k in range(3))
    return to_uint8(np.stack([(116 * y - 16) * 2.55, 500 * (x - y) + 128, 200 * (y - z) + 128], axis=-1))


def from_lab(lab: np.ndarray) -> np.ndarray:
    """BGR bytes of L, a, b bytes."""
    y = (lab[..., 0] / 2.55 + 16) / 116
    curve = np.stack([y + (lab[..., 1] - 128.0) / 500, y, y - (lab[..., 2] - 128.0) / 200], axis=-1)
    ratio = np.where(curve**3 > _CIE_BOUND, curve**3, (curve - 16 / 116) / _CIE_SLOPE)
    linear = np.clip((ratio * _WHITE) @ np.linalg.inv(_XYZ).T, 0, 1)
    rgb = np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055)
    return to_uint8(rgb[..., ::-1] * 255)


def on_lightness(image: np.ndarray, f) -> np.ndarray:
    """Apply ``f`` to a gray image, or to the lightness channel of a colour image."""
    if image.ndim == 2:
        return f(image)
    lab = to_lab(image)
    lab[..., 0] = f(np.ascontiguousarray(lab[..., 0]))
    return from_lab(lab)


def truncated(image: np.ndarray) -> np.ndarray:
    """Clipped to bytes, fractions cut off."""
    return np.clip(image, 0, 255).astype(np.uint8)


def windows(image: np.ndarray, size: int) -> np.ndarray:
    pad = size // 2
    mode = "reflect" if min(image.shape) > pad else "edge"
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode=mode), (size, size))


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return np.einsum("ijkl,kl->ij", windows(image.astype(float), kernel.shape[0]), kernel)


def convolve_lines(image: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Convolution with the outer product of ``line`` with itself, one axis after the other."""
    out, pad = image.astype(float), len(line) // 2
    for axis in (0, 1):
        width = [(pad, pad) if k == axis else (0, 0) for k in range(2)]
        padded = np.pad(out, width, mode="reflect" if out.shape[axis] > 1 else "edge")
        out = sum(w * np.take(padded, range(k, k + out.shape[axis]), axis) for k, w in enumerate(line))
    return out


def odd(size: int) -> int:
    size = max(1, int(size))
    return size + 1 - size % 2


def gaussian_line(size: int, sigma: float = 0.0) -> np.ndarray:
    size = odd(size)
    sigma = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return line / line.sum()


def gaussian_kernel(size: int, sigma: float = 0.0) -> np.ndarray:
    return np.outer(gaussian_line(size, sigma), gaussian_line(size, sigma))


LAPLACIAN = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float)
SOBEL_X = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)


# -- measures ----------------------------------------------------------------


def measures(image: np.ndarray) -> dict[str, float]:
    gray = to_gray(image)
    counts = np.bincount(gray.ravel(), minlength=256)
    share = counts[counts > 0] / gray.size
    gx, gy = convolve(gray, SOBEL_X), convolve(gray, SOBEL_X.T)
    return {
        "brightness": float(gray.mean()),
        "contrast": float(gray.std()),
        "dynamic_range": float(gray.max()) - float(gray.min()),
        "entropy": float(-(share * np.log2(share)).sum()),
        "blur_score": float(convolve(gray, LAPLACIAN).var()),
        "sharpness": float(np.hypot(gx, gy).mean()),
        "noise_level": float((gray - convolve(gray, gaussian_kernel(3))).std()),
    }


# -- size --------------------------------------------------------------------


def resize(image: np.ndarray, width: int, height: int, method: str = "linear") -> np.ndarray:
    """``nearest``, ``linear``, or ``area`` (means of source cells, for shrinking)."""
    h, w = image.shape[:2]
    if method == "nearest":
        return image[np.minimum(np.arange(height) * h // height, h - 1)][:, np.minimum(np.arange(width) * w // width, w - 1)]
    if method == "area" and height <= h and width <= w:
        return to_uint8(_cells(_cells(image.astype(float), height, 0), width, 1))
    if method not in ("linear", "area"):
        raise ValueError(f"unknown resize method: {method}")
    return to_uint8(_between(_between(image.astype(float), height, 0), width, 1))


def _between(image: np.ndarray, n: int, axis: int) -> np.ndarray:
    size = image.shape[axis]
    at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, size - 1)
    share = (at - low).reshape([-1 if k == axis else 1 for k in range(image.ndim)])
    return np.take(image, low, axis) * (1 - share) + np.take(image, high, axis) * share


def _cells(image: np.ndarray, n: int, axis: int) -> np.ndarray:
    size = image.shape[axis]
    sums = np.concatenate([np.zeros_like(np.take(image, [0], axis)), np.cumsum(image, axis)], axis)
    edges = np.arange(n + 1) * size / n
    low = np.minimum(np.floor(edges).astype(int), size)
    share = (edges - low).reshape([-1 if k == axis else 1 for k in range(image.ndim)])
    at = np.take(sums, low, axis) * (1 - share) + np.take(sums, np.minimum(low + 1, size), axis) * share
    return np.diff(at, axis=axis) * (n / size)


def letterbox(image: np.ndarray, width: int, height: int, fill: int = 0, method: str = "linear") -> np.ndarray:
    """Keep the aspect ratio and centre on a filled frame."""
    h, w = image.shape[:2]
    scale = min(width / w, height / h)
    small = resize(image, max(1, round(w * scale)), max(1, round(h * scale)), method)
    out = np.full((height, width, *image.shape[2:]), fill, np.uint8)
    top, left = (height - small.shape[0]) // 2, (width - small.shape[1]) // 2
    out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


# -- noise and sharpness -----------------------------------------------------


def gaussian_blur(image: np.ndarray, size: int = 5, sigma: float = 0.0) -> np.ndarray:
    line = gaussian_line(size, sigma)
    return per_channel(image, lambda c: to_uint8(convolve_lines(c, line)))


def median_blur(image: np.ndarray, size: int = 5) -> np.ndarray:
    return per_channel(image, lambda c: np.median(windows(c, odd(size)), axis=(2, 3)).astype(np.uint8))


def bilateral(image: np.ndarray, size: int = 9, sigma_color: float = 75.0, sigma_space: float = 75.0) -> np.ndarray:
    """Weights by distance, within a circle, and by difference of levels."""
    away = np.arange(odd(size)) - odd(size) // 2
    apart = away[:, None] ** 2 + away[None, :] ** 2
    near = np.exp(-apart / (2 * sigma_space**2)) * (apart <= (odd(size) // 2) ** 2)

    def one(c: np.ndarray) -> np.ndarray:
        view = windows(c.astype(float), odd(size))
        weight = near * np.exp(-((view - c[..., None, None]) ** 2) / (2 * sigma_color**2))
        return to_uint8((view * weight).sum((2, 3)) / weight.sum((2, 3)))

    return per_channel(image, one)


def non_local_means(image: np.ndarray, strength: float = 10.0, template: int = 7, search: int = 21) -> np.ndarray:
    def one(c: np.ndarray) -> np.ndarray:
        reach = search // 2
        flat = np.full((template, template), 1.0 / template**2)
        padded = np.pad(c.astype(float), reach, mode="reflect" if min(c.shape) > reach else "edge")
        total, weights = np.zeros(c.shape), np.zeros(c.shape)
        for dr in range(search):
            for dc in range(search):
                moved = padded[dr : dr + c.shape[0], dc : dc + c.shape[1]]
                weight = np.exp(-convolve((moved - c) ** 2, flat) / strength**2)
                total += weight * moved
                weights += weight
        return to_uint8(total / weights)

    return per_channel(image, one)


def unsharp_mask(image: np.ndarray, amount: float = 1.0, size: int = 5, sigma: float = 1.0, threshold: int = 0) -> np.ndarray:
    blurred = gaussian_blur(image, size, sigma).astype(float)
    sharp = to_uint8((1 + amount) * image - amount * blurred)
    return np.where(np.abs(image - blurred) < threshold, image, sharp) if threshold > 0 else sharp


def kernel_sharpen(image: np.ndarray, strength: float = 0.0) -> np.ndarray:
    kernel = np.array([[0, -1, 0], [-1, 5 + strength, -1], [0, -1, 0]], float)
    return per_channel(image, lambda c: to_uint8(convolve(c, kernel)))


def laplacian_sharpen(image: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """The Laplacian of the gray image, taken from every channel."""
    edges = strength * convolve(to_gray(image), LAPLACIAN)
    return truncated(image - (edges if image.ndim == 2 else edges[..., None]))


# -- tone --------------------------------------------------------------------


def clahe(image: np.ndarray, clip_limit: float = 2.0, grid: int = 8, lightness_only: bool = True, keep_brightness: bool = False) -> np.ndarray:
    """Contrast-limited equalisation in a grid of tiles, blended between tile centres."""

    def one(c: np.ndarray) -> np.ndarray:
        h, w = c.shape
        rows, columns = min(grid, h), min(grid, w)
        r_edges, c_edges = np.linspace(0, h, rows + 1).astype(int), np.linspace(0, w, columns + 1).astype(int)
        tables = np.empty((rows, columns, 256))
        for i in range(rows):
            for k in range(columns):
                tile = c[r_edges[i] : r_edges[i + 1], c_edges[k] : c_edges[k + 1]]
                counts = np.bincount(tile.ravel(), minlength=256).astype(float)
                if clip_limit > 0:
                    most = max(1.0, clip_limit * tile.size / 256)
                    over = np.maximum(counts - most, 0).sum()
                    counts = np.minimum(counts, most) + over / 256
                tables[i, k] = np.cumsum(counts) * 255 / tile.size
        r_at = np.clip((np.arange(h) + 0.5) * rows / h - 0.5, 0, rows - 1)
        c_at = np.clip((np.arange(w) + 0.5) * columns / w - 0.5, 0, columns - 1)
        r0, c0 = r_at.astype(int), c_at.astype(int)
        r1, c1 = np.minimum(r0 + 1, rows - 1), np.minimum(c0 + 1, columns - 1)
        fr, fc = (r_at - r0)[:, None], (c_at - c0)[None, :]

        def value(r, k):
            return tables[r[:, None], k[None, :], c]

        top = value(r0, c0) * (1 - fc) + value(r0, c1) * fc
        bottom = value(r1, c0) * (1 - fc) + value(r1, c1) * fc
        return to_uint8(top * (1 - fr) + bottom * fr)

    out = on_lightness(image, one) if lightness_only else per_channel(image, one)
    return restore_brightness(image, out) if keep_brightness else out


def restore_brightness(original: np.ndarray, changed: np.ndarray) -> np.ndarray:
    mean = changed.mean()
    return to_uint8(changed * (original.mean() / mean)) if mean > 0 else changed


def equalize(image: np.ndarray) -> np.ndarray:
    def one(c: np.ndarray) -> np.ndarray:
        sums = np.cumsum(np.bincount(c.ravel(), minlength=256))
        first = sums[sums > 0][0]
        if sums[-1] == first:
            return c
        return to_uint8((sums - first) * 255.0 / (sums[-1] - first))[c]

    return on_lightness(image, one)


def match_histogram(image: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Values go to the least reference value whose cumulative share reaches theirs."""
    tone = to_gray(reference) if image.ndim == 2 else to_lab(reference)[..., 0]
    wanted = np.cumsum(np.bincount(tone.ravel(), minlength=256)) / tone.size

    def one(c: np.ndarray) -> np.ndarray:
        have = np.cumsum(np.bincount(c.ravel(), minlength=256)) / c.size
        return np.minimum(np.searchsorted(wanted, have - 1e-12), 255).astype(np.uint8)[c]

    return on_lightness(image, one)


def gamma(image: np.ndarray, g: float) -> np.ndarray:
    return _gamma(image, g)


def _gamma(image: np.ndarray, g: float) -> np.ndarray:
    if g <= 0:
        raise ValueError("gamma must be positive")
    return (np.power(np.arange(256) / 255.0, 1.0 / g) * 255.0).astype(np.uint8)[image]


def contrast_stretch(image: np.ndarray, low: int = 0, high: int = 255) -> np.ndarray:
    if high <= low:
        raise ValueError("upper bound must exceed lower bound")
    return truncated((image.astype(float) - low) * (255.0 / (high - low)))


def histogram_stretch(image: np.ndarray) -> np.ndarray:
    """Each channel spread over 0..255; a constant one stays."""

    def one(c: np.ndarray) -> np.ndarray:
        low, span = float(c.min()), float(c.max()) - float(c.min())
        return truncated((c - low) * 255.0 / span) if span else c

    return per_channel(image, one)


def brightness_normalize(image: np.ndarray, target: float = 128.0) -> np.ndarray:
    """Scaled to a mean level."""
    mean = image.mean()
    return truncated(image * (target / mean)) if mean > 0 else image


def histogram_operation(image: np.ndarray, operation: str, **options) -> np.ndarray:
    """One of the histogram operations by name; ``histogram`` leaves the image as it is."""
    check_histogram_options(operation, options)
    found = {
        "equalize": equalize, "clahe": clahe, "gamma": lambda x, gamma=1.0: _gamma(x, gamma), "contrast_stretch": contrast_stretch, "stretch": histogram_stretch,
        "brightness": brightness_normalize, "matching": match_histogram, "histogram": lambda x: x,
    }
    return found[operation](image, **options)


HISTOGRAM_OPERATIONS = ("equalize", "clahe", "gamma", "contrast_stretch", "stretch", "brightness", "matching", "histogram")


def check_histogram_options(operation: str, options: dict) -> None:
    """Raise where an operation is unknown or its options make no sense."""
    if operation not in HISTOGRAM_OPERATIONS:
        raise TypeError(f"unknown histogram operation: {operation}")
    if operation == "gamma" and options.get("gamma", 1.0) <= 0:
        raise ValueError("gamma must be positive")
    if operation == "contrast_stretch" and options.get("high", 255) <= options.get("low", 0):
        raise ValueError("upper bound must exceed lower bound")
    if operation == "matching" and options.get("reference") is None:
        raise ValueError("matching needs a reference image")


def stain_operation(image: np.ndarray, method: str, reference=None, standardize: bool = False) -> np.ndarray:
    """Stain normalisation by name, after the lightness is standardised if asked."""
    if method not in ("macenko", "reinhard", "none"):
        raise ValueError(f"unknown stain method: {method}")
    image = standardize_brightness(image) if standardize else image
    return image if method == "none" else {"macenko": macenko, "reinhard": reinhard}[method](image, reference)


def gray_world(image: np.ndarray) -> np.ndarray:
    means = image.reshape(-1, 3).mean(0)
    return to_uint8(image * (means.mean() / np.where(means > 0, means, 1)))


def simple_white_balance(image: np.ndarray) -> np.ndarray:
    low, high = image.min((0, 1)).astype(float), image.max((0, 1)).astype(float)
    return to_uint8(np.where(high > low, (image - low) * 255.0 / np.where(high > low, high - low, 1), image))


def to_hsv(image: np.ndarray) -> np.ndarray:
    """Hue 0..180, saturation and value 0..255, as floats."""
    b, g, r = (image[..., k].astype(float) for k in range(3))
    high, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = high - low
    safe = np.where(span > 0, span, 1)
    hue = np.select([high == r, high == g], [(g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe)
    hue = np.where(span > 0, hue * 30 % 180, 0)
    return np.stack([hue, np.where(high > 0, span * 255 / np.where(high > 0, high, 1), 0), high], axis=-1)


def from_hsv(hsv: np.ndarray) -> np.ndarray:
    h, s, v = hsv[..., 0] / 30 % 6, np.clip(hsv[..., 1], 0, 255) / 255, np.clip(hsv[..., 2], 0, 255)

    def channel(n: int) -> np.ndarray:
        k = (n + h) % 6
        return v - v * s * np.clip(np.minimum(k, 4 - k), 0, 1)

    return to_uint8(np.stack([channel(1), channel(3), channel(5)], axis=-1))


def adjust_saturation(image: np.ndarray, factor: float) -> np.ndarray:
    hsv = to_hsv(image)
    hsv[..., 1] = np.clip(hsv[..., 1] * factor, 0, 255)
    return from_hsv(hsv)


def adjust_hue(image: np.ndarray, shift: float) -> np.ndarray:
    hsv = to_hsv(image)
    hsv[..., 0] = (hsv[..., 0] + shift) % 180
    return from_hsv(hsv)


# -- morphology --------------------------------------------------------------


def element(shape: str = "rectangle", size: int = 3) -> np.ndarray:
    size = odd(size)
    axis = np.abs(np.arange(size) - size // 2)
    if shape == "rectangle":
        return np.ones((size, size), bool)
    if shape == "cross":
        return (axis[:, None] == 0) | (axis[None, :] == 0)
    if shape == "ellipse":  # each row as wide as the ellipse is there, rounded
        half = size // 2
        wide = np.rint(half * np.sqrt(1 - (axis / max(half, 1)) ** 2))
        return axis[None, :] <= wide[:, None]
    raise ValueError(f"unknown element: {shape}")


def erode(image: np.ndarray, kernel: np.ndarray, iterations: int = 1) -> np.ndarray:
    return _extreme(image, kernel, iterations, np.min, 255)


def dilate(image: np.ndarray, kernel: np.ndarray, iterations: int = 1) -> np.ndarray:
    return _extreme(image, kernel, iterations, np.max, 0)


def _extreme(image: np.ndarray, kernel: np.ndarray, iterations: int, pick, border: int) -> np.ndarray:
    def one(c: np.ndarray) -> np.ndarray:
        pad = kernel.shape[0] // 2
        for _ in range(iterations):
            view = np.lib.stride_tricks.sliding_window_view(np.pad(c, pad, constant_values=border), kernel.shape)
            c = pick(view[..., kernel], axis=-1)
        return c

    return per_channel(image, one)


def morphology(image: np.ndarray, operation: str, shape: str = "rectangle", size: int = 3, iterations: int = 1) -> np.ndarray:
    k = element(shape, size)
    low = lambda x: erode(x, k, iterations)
    high = lambda x: dilate(x, k, iterations)
    signed = image.astype(int)
    results = {
        "erosion": lambda: low(image),
        "dilation": lambda: high(image),
        "opening": lambda: high(low(image)),
        "closing": lambda: low(high(image)),
        "gradient": lambda: to_uint8(high(image).astype(int) - low(image)),
        "tophat": lambda: to_uint8(signed - high(low(image))),
        "blackhat": lambda: to_uint8(low(high(image)).astype(int) - signed),
    }
    if operation not in results:
        raise ValueError(f"unknown operation: {operation}")
    return results[operation]()


# -- stain -------------------------------------------------------------------


def optical_density(image: np.ndarray) -> np.ndarray:
    return -np.log(np.maximum(image.astype(float), 1) / 255.0)


def from_optical_density(density: np.ndarray) -> np.ndarray:
    return np.clip(255.0 * np.exp(-density), 0, 255).astype(np.uint8)


def tissue_mask(density: np.ndarray, threshold: float = 0.15) -> np.ndarray:
    return (density > threshold).any(-1)


def stain_vectors(density: np.ndarray, percentile: float = 1.0) -> np.ndarray:
    """Two unit stain directions (rows) of optical densities (pixels x 3)."""
    density = valid_density(density)
    _, basis = np.linalg.eigh(np.cov(density.T))
    plane = basis[:, [2, 1]]
    plane = plane * np.where(plane.sum(0) < 0, -1, 1)
    angles = np.arctan2(*(density @ plane).T[::-1])
    ends = np.percentile(angles, [percentile, 100 - percentile])
    found = np.array([plane @ (np.cos(a), np.sin(a)) for a in ends])
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return found[np.argsort(-found[:, 0])]


def concentrations(density: np.ndarray, stains: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(stains.T, density.T, rcond=None)[0].T


@dataclass(frozen=True)
class Stains:
    """What ``macenko`` needs of a reference image."""

    vectors: np.ndarray
    most: np.ndarray


def _stained(image: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    density = optical_density(image)
    mask = tissue_mask(density, threshold)
    inside = density[mask]
    vectors = stain_vectors(inside)
    found = concentrations(inside, vectors)
    return mask, vectors, found, np.maximum(np.percentile(found, 99, axis=0), 1e-8)


def stains_of(reference: np.ndarray, threshold: float = 0.15) -> Stains:
    _, vectors, _, most = _stained(as_reference(reference), threshold)
    return Stains(vectors, most)


def macenko(image: np.ndarray, reference: np.ndarray | Stains, threshold: float = 0.15) -> np.ndarray:
    """Stains of the image rescaled to the reference's (an image, or its ``Stains``); background pixels stay."""
    wanted = reference if isinstance(reference, Stains) else stains_of(reference, threshold)
    mask, _, found, most = _stained(image, threshold)
    out = image.copy()
    out[mask] = from_optical_density(found * (wanted.most / most) @ wanted.vectors)
    return out


def as_reference(image: np.ndarray) -> np.ndarray:
    """A reference image, if it is one: three channels of bytes, not empty."""
    if image is None:
        raise ValueError("a reference image is needed")
    if not isinstance(image, np.ndarray) or image.dtype != np.uint8:
        raise TypeError("a reference image holds bytes")
    if image.ndim != 3 or image.shape[2] != 3 or not image.size:
        raise ValueError("a reference image has three channels and at least one pixel")
    return image


def valid_density(density: np.ndarray) -> np.ndarray:
    """Optical densities (pixels x 3) that are finite; at least two pixels must be left."""
    if density.ndim != 2 or density.shape[1] != 3:
        raise ValueError("optical densities have three columns")
    kept = density[np.isfinite(density).all(-1)]
    if len(kept) < 2:
        raise ValueError("too few pixels with tissue")
    return kept


def background_mask(image: np.ndarray, threshold: int = 220) -> np.ndarray:
    """Pixels that are darker than the background."""
    return to_gray(image) < threshold


def without_background(image: np.ndarray, threshold: int = 220) -> np.ndarray:
    """Pixels (rows of three) that are darker than the background."""
    return image[background_mask(image, threshold)]


def channel_moments(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = image.reshape(-1, image.shape[-1]).astype(float)
    return flat.mean(0), flat.std(0)


@dataclass(frozen=True)
class Moments:
    """Means and deviations of the L, a and b channels of a reference image."""

    mean: np.ndarray
    std: np.ndarray


def lab_moments(image: np.ndarray) -> Moments:
    return Moments(*channel_moments(to_lab(as_reference(image))))


def matched_moments(channels: np.ndarray, wanted: Moments) -> np.ndarray:
    """Channels shifted and scaled to the wanted means and deviations, within bytes."""
    mean, std = channel_moments(channels)
    return np.clip((channels - mean) * (wanted.std / np.maximum(std, 1e-8)) + wanted.mean, 0, 255)


def reinhard(image: np.ndarray, reference: np.ndarray | Moments) -> np.ndarray:
    """Means and deviations of the L, a and b channels matched to a reference's (an image, or its ``Moments``)."""
    wanted = reference if isinstance(reference, Moments) else lab_moments(reference)
    return from_lab(truncated(matched_moments(to_lab(image), wanted)))


def standardize_brightness(image: np.ndarray, percentile: float = 90.0) -> np.ndarray:
    """Lightness scaled so that its percentile becomes 255."""

    def scaled(c: np.ndarray) -> np.ndarray:
        most = np.percentile(c, percentile)
        return truncated(c * (255.0 / most)) if most > 0 else c

    return on_lightness(image, scaled)


# -- features ----------------------------------------------------------------


def crop(image: np.ndarray, xc: float, yc: float, w: float, h: float, padding: float = 0.1) -> np.ndarray | None:
    height, width = image.shape[:2]
    bw, bh = w * width * (1 + 2 * padding), h * height * (1 + 2 * padding)
    x1, x2 = (int(np.clip(int(v), 0, width)) for v in (xc * width - bw / 2, xc * width + bw / 2))
    y1, y2 = (int(np.clip(int(v), 0, height)) for v in (yc * height - bh / 2, yc * height + bh / 2))
    return image[y1:y2, x1:x2] if x2 > x1 and y2 > y1 else None


def canny(gray: np.ndarray, low: float = 100.0, high: float = 200.0) -> np.ndarray:
    """Edge pixels: ridges of the gradient (sum of its absolute parts) above ``high``, and those above ``low`` that hang on them."""
    padded = np.pad(gray.astype(float), 1, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view(padded, (3, 3))
    gx, gy = np.einsum("ijkl,kl->ij", view, SOBEL_X), np.einsum("ijkl,kl->ij", view, SOBEL_X.T)
    size = np.abs(gx) + np.abs(gy)
    around = np.pad(size, 1)

    def moved(dr: int, dc: int) -> np.ndarray:
        return around[1 + dr : 1 + dr + size.shape[0], 1 + dc : 1 + dc + size.shape[1]]

    slope = np.tan(np.pi / 8)
    flat, steep = np.abs(gy) < np.abs(gx) * slope, np.abs(gy) > np.abs(gx) / slope
    down = (gx * gy) >= 0
    ridge = np.select(
        [flat, steep, down],
        [(size > moved(0, -1)) & (size >= moved(0, 1)), (size > moved(-1, 0)) & (size >= moved(1, 0)), (size > moved(-1, -1)) & (size > moved(1, 1))],
        (size > moved(-1, 1)) & (size > moved(1, -1)),
    )
    weak, edges = ridge & (size > low), ridge & (size > high)
    while True:
        grown = weak & np.lib.stride_tricks.sliding_window_view(np.pad(edges, 1), (3, 3)).any((2, 3))
        if (grown == edges).all():
            return edges
        edges = grown


#: Names of the patch features, in order.
FEATURE_NAMES = (
    "B_mean", "B_std", "G_mean", "G_std", "R_mean", "R_std", "gray_mean", "gray_std", "gray_entropy", *(f"hue_{k}" for k in range(8)), "edge_density",
)


def patch_features(patch: np.ndarray, size: int = 64) -> np.ndarray:
    """18 numbers: mean and deviation of each channel, gray mean, deviation and entropy, 8 hue shares, edge share."""
    patch = resize(patch, size, size)
    gray = to_gray(patch)
    mean, std = channel_moments(patch)
    share = np.bincount(gray.ravel(), minlength=256) / (gray.size + 1e-8)
    share = share[share > 0]
    hue = np.rint(to_hsv(patch)[..., 0]).astype(int) % 180
    hues = np.histogram(hue, bins=8, range=(0, 180))[0] / (size**2 + 1e-8)
    by_channel = np.column_stack([mean, std]).ravel()
    entropy = float(-(share * np.log2(share)).sum())
    return np.concatenate([by_channel, [gray.mean(), gray.std(), entropy], hues, [canny(gray).mean()]]).astype(np.float32)


def hog(gray: np.ndarray, size: int = 64, cell: int = 8, bins: int = 9) -> np.ndarray:
    """Histograms of gradient directions in cells, normalised in blocks of 2 x 2 cells."""
    gray = resize(gray, size, size).astype(float)
    gx, gy = convolve(gray, np.array([[0, 0, 0], [-1, 0, 1], [0, 0, 0]], float)), convolve(gray, np.array([[0, -1, 0], [0, 0, 0], [0, 1, 0]], float))
    strength, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180
    n = size // cell
    index = (angle * bins / 180).astype(int) % bins
    cells = np.zeros((n, n, bins))
    rows, columns = np.indices(gray.shape) // cell
    np.add.at(cells, (rows, columns, index), strength)
    blocks = np.lib.stride_tricks.sliding_window_view(cells, (2, 2), axis=(0, 1)).reshape((n - 1) ** 2, -1)
    return (blocks / np.sqrt((blocks**2).sum(1, keepdims=True) + 1e-6)).ravel().astype(np.float32)


def color_histogram(image: np.ndarray, bins: int = 16) -> np.ndarray:
    parts = [np.bincount(image[..., k].ravel() // (256 // bins), minlength=bins) / image[..., k].size for k in range(image.shape[2])]
    return np.concatenate(parts).astype(np.float32)


# -- explanation -------------------------------------------------------------


def class_activation_map(activations: np.ndarray, gradients: np.ndarray) -> np.ndarray:
    """Heat map (0 to 1) of a network's layer: its channels weighted by their mean gradients, negative parts cut off.

    Both arrays are channels x rows x columns, from any deep-learning library.
    """
    heat = np.maximum(np.tensordot(gradients.mean((1, 2)), activations, 1), 0)
    heat = heat - heat.min()
    return heat / (heat.max() + 1e-8)


def rainbow(level: np.ndarray) -> np.ndarray:
    """BGR colours from blue over green to red of levels 0 to 1."""
    return to_uint8(np.stack([np.clip(1.5 - np.abs(4 * level - k), 0, 1) for k in (1, 2, 3)], axis=-1) * 255)


def heatmap_overlay(heat: np.ndarray, image: np.ndarray, alpha: float = 0.4) -> np.ndarray:
    """A heat map (0 to 1) in colours over an image of any size."""
    height, width = image.shape[:2]
    sized = _between(_between(heat.astype(float), height, 0), width, 1)
    colored = rainbow((sized * 255).astype(np.uint8) / 255)
    return to_uint8(colored * alpha + image * (1 - alpha))


# Sizes of the blur and strengths of the noise and the darkening.
BLUR_SIZES, NOISE = (9, 15, 21), 35.0
DARK_BLUR_SIZES, DARK_FACTORS = (121, 151, 171), (0.05, 0.10)


def degrade(image: np.ndarray, rng: np.random.Generator, darken: bool = False) -> np.ndarray:
    """Blur with noise, or heavy blur with darkening (noise would raise contrast, entropy and the blur score)."""
    if darken:
        blurred = gaussian_blur(image, int(rng.choice(DARK_BLUR_SIZES)))
        return truncated(blurred * rng.uniform(*DARK_FACTORS))
    blurred = gaussian_blur(image, int(rng.choice(BLUR_SIZES)))
    return truncated(blurred + rng.normal(0, NOISE, image.shape))
