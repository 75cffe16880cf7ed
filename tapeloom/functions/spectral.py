"""Log-mel arithmetic on whole clips of bounded length (NumPy, inside tasks)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tapeloom.schemas import SAMPLE_RATE_HZ

# Shape of the features.
N_FFT = 400
HOP = 160
N_MELS = 80
CLIP_SECONDS = 30
N_SAMPLES = CLIP_SECONDS * SAMPLE_RATE_HZ
N_FRAMES = N_SAMPLES // HOP
# The mel scale is linear up to 1 kHz and logarithmic above.
MEL_LINEAR_HZ = 200.0 / 3.0
MEL_BREAK_HZ = 1000.0
MEL_LOG_STEP = np.log(6.4) / 27.0


@lru_cache
def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def hz_to_mel(hz: np.ndarray) -> np.ndarray:
    upper = MEL_BREAK_HZ / MEL_LINEAR_HZ + np.log(np.maximum(hz, 1e-9) / MEL_BREAK_HZ) / MEL_LOG_STEP
    return np.where(hz >= MEL_BREAK_HZ, upper, hz / MEL_LINEAR_HZ)


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    knee = MEL_BREAK_HZ / MEL_LINEAR_HZ
    return np.where(
        mel >= knee, MEL_BREAK_HZ * np.exp(MEL_LOG_STEP * (mel - knee)), MEL_LINEAR_HZ * mel
    )


@lru_cache
def mel_filters(n_mels: int = N_MELS, n_fft: int = N_FFT, rate: int = SAMPLE_RATE_HZ) -> np.ndarray:
    """Triangles of equal area, one row per mel band."""
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    top = float(hz_to_mel(np.array(rate / 2.0)))
    edges = mel_to_hz(np.linspace(0.0, top, n_mels + 2))
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rising = (bins - left) / (centre - left)
    falling = (right - bins) / (right - centre)
    return np.maximum(np.minimum(rising, falling), 0.0) * 2.0 / (right - left)


def reflect_index(index: np.ndarray, length: int) -> np.ndarray:
    """Mirror positions back into range without repeating the edge sample."""
    if length <= 1:
        return np.zeros_like(index)
    period = 2 * (length - 1)
    folded = np.mod(index, period)
    return np.minimum(folded, period - folded)


def pad_or_trim(samples: np.ndarray, length: int = N_SAMPLES) -> np.ndarray:
    out = np.zeros(length, samples.dtype)
    kept = min(length, len(samples))
    out[:kept] = samples[:kept]
    return out


def frame_matrix(samples: np.ndarray, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """Centred frames, one per hop, mirrored at both ends."""
    half = n_fft // 2
    at = reflect_index(np.arange(-half, len(samples) + half), len(samples))
    padded = samples[at]
    return np.lib.stride_tricks.sliding_window_view(padded, n_fft)[: (len(samples) // hop) * hop : hop]


def power_spectrum(frames: np.ndarray) -> np.ndarray:
    """Hann-windowed squared magnitudes, n_fft/2 + 1 per frame."""
    spectrum = np.fft.rfft(frames * hann(frames.shape[-1]), axis=-1)
    return spectrum.real**2 + spectrum.imag**2


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(frames, mels) log-mel features of one clip, padded or cut to the fixed length.

    Frames past the last sample are silent, so only those that reach a sample are transformed.
    """
    clip = pad_or_trim(np.asarray(samples, np.float64))
    live = min(N_FRAMES, (min(len(samples), N_SAMPLES) + N_FFT // 2) // HOP + 2)
    energy = np.zeros((N_FRAMES, N_MELS))
    frames = frame_matrix(clip)
    energy[:live] = power_spectrum(frames[:live]) @ mel_filters().T
    if live < N_FRAMES:
        # the mirrored right edge can reach back into the signal
        tail = max(live, N_FRAMES - N_FFT // HOP - 2)
        energy[tail:] = power_spectrum(frames[tail:]) @ mel_filters().T
    levels = np.log10(np.maximum(energy, 1e-10))
    return ((np.maximum(levels, levels.max() - 8.0) + 4.0) / 4.0).astype(np.float32)
