"""Sound and picture redaction on arrays: samples of WAV files, and pixels as height x width x channels."""

from __future__ import annotations

import io
import wave

import numpy as np

# Sound


def read_wav(raw: bytes) -> tuple[np.ndarray, int, int]:
    """Samples (frames x channels), rate and bytes a sample."""
    with wave.open(io.BytesIO(raw)) as w:
        width, n = w.getsampwidth(), w.getnchannels()
        data = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width])
        return data.reshape(-1, n).copy(), w.getframerate(), width


def encode_wav(samples: np.ndarray, rate: int, width: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(samples.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples.tobytes())
    return out.getvalue()


def redact_samples(samples: np.ndarray, rate: int, start_us: int, end_us: int, how: str = "silence", hz: float = 1000.0, amplitude: float = 0.5, waveform: str = "sine") -> np.ndarray:
    """[start, end) in microseconds to silence or a tone, or cut out (how: erase)."""
    a, b = (min(len(samples), max(0, int(t * rate // 1_000_000))) for t in (start_us, end_us))
    if how == "erase":
        return np.concatenate([samples[:a], samples[b:]])
    out = samples.copy()
    rest, peak = (128, 127) if out.dtype == np.uint8 else (0, np.iinfo(out.dtype).max)
    out[a:b] = rest
    if how == "tone":
        t = np.arange(b - a) * hz / rate
        wave_ = np.sin(2 * np.pi * t) if waveform == "sine" else np.where(t % 1 < 0.5, 1.0, -1.0) if waveform == "square" else 2 * (t % 1) - 1
        out[a:b] = (rest + amplitude * peak * wave_[:, None]).astype(out.dtype)
    return out


def write_wav(raw: bytes, edits) -> bytes:
    """Edits carry microseconds in start and end, and the operator in replacement."""
    samples, rate, width = read_wav(raw)
    for e in sorted(edits, key=lambda e: -e.start):
        samples = redact_samples(samples, rate, e.start, e.end, e.replacement or "silence")
    return encode_wav(samples, rate, width)


# Pictures


def _box(shape, left: int, top: int, right: int, bottom: int) -> tuple[slice, slice]:
    return slice(max(0, top), min(shape[0], bottom)), slice(max(0, left), min(shape[1], right))


def blackbox(pixels: np.ndarray, box: tuple[int, int, int, int], color=(0, 0, 0)) -> np.ndarray:
    out = pixels.copy()
    out[_box(out.shape, *box)] = np.array(color[: out.shape[2]], out.dtype)
    return out


def pixelate(pixels: np.ndarray, box: tuple[int, int, int, int], block: int = 16) -> np.ndarray:
    """Each block takes its first pixel's color."""
    out = pixels.copy()
    ys, xs = _box(out.shape, *box)
    part = out[ys, xs]
    y, x = (np.arange(n) // block * block for n in part.shape[:2])
    out[ys, xs] = part[y[:, None], x[None, :]]
    return out


def blur(pixels: np.ndarray, box: tuple[int, int, int, int], sigma: float = 16.0) -> np.ndarray:
    """A Gaussian over the region, edges repeated."""
    out = pixels.copy()
    ys, xs = _box(out.shape, *box)
    part = out[ys, xs].astype(float)
    if not part.size:
        return out
    r = max(1, int(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(r, r) if i == axis else (0, 0) for i in range(3)]
        wide = np.pad(part, pad, mode="edge")
        part = sum(w * np.take(wide, np.arange(i, i + part.shape[axis]), axis=axis) for i, w in enumerate(k))
    out[ys, xs] = np.clip(np.rint(part), 0, 255).astype(out.dtype)
    return out
