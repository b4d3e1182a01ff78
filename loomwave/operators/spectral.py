"""Spectral kernels over packed rows: each row is one signal, so every operator is a narrow Arrow pass.

The kernels are plain numpy functions on matrices (signals x samples); rows of one length in a batch run together.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Constants of the Gaussian filter bank (fixed values): lowest centre, slope and offset of the bandwidth.
_BANK_F0, _BANK_A1, _BANK_A2 = 0.018, np.log10(0.39), 0.5
#: Constants of the Morlet wavelets of superlets (fixed values).
_MORLET_SD, _MORLET_SPREAD = 2.5, 6.0


def per_row(df: DataFrame, values: str, out: str, kernel: Callable[[np.ndarray], np.ndarray], nested: bool = False) -> DataFrame:
    """df with `out`: the kernel's result for each row's signal (nested: a list of lists).

    The kernel takes a matrix of signals of one length. Null or empty signals, and signals with a missing sample,
    give null. Other columns pass through.
    """
    kind = T.ArrayType(T.ArrayType(T.DoubleType())) if nested else T.ArrayType(T.DoubleType())
    source = df.drop(out) if out != values else df
    schema = T.StructType([*(f for f in source.schema.fields if f.name != out), T.StructField(out, kind)])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signals = batch[values].to_pylist()
            results: list = [None] * len(signals)
            groups: dict[int, list[int]] = {}
            for i, s in enumerate(signals):
                if s and None not in s:
                    groups.setdefault(len(s), []).append(i)
            for rows in groups.values():
                matrix = np.array([signals[i] for i in rows], float)
                ok = np.isfinite(matrix).all(1)
                if ok.any():
                    for i, r in zip(np.array(rows)[ok], kernel(matrix[ok])):
                        results[i] = r.tolist()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(results, pa.list_(pa.list_(pa.float64())) if nested else pa.list_(pa.float64()))], names=[*kept, out])

    return source.mapInArrow(run, schema)


def bank_centers(low: float, high: float, spacing: float = 1 / 7) -> np.ndarray:
    """Centre frequencies of the Gaussian bank: steps of the bandwidth under 4 Hz, of an octave's share above."""
    if low >= high:
        raise ValueError("the band is empty")
    centers = [_BANK_F0]
    while centers[-1] < high:
        c = centers[-1]
        centers.append(c + 10 ** (_BANK_A1 + _BANK_A2 * np.log10(c)) if c < 4 else c * 2**spacing)
    centers = np.array(centers)
    inside = centers[(centers >= low) & (centers <= high)]
    if not len(inside):
        raise ValueError("no filter lies in the band")
    return inside


def bank_envelopes(x: np.ndarray, sfreq: float, low: float, high: float, spacing: float = 1 / 7) -> np.ndarray:
    """Envelope in each filter of the bank: signals x filters x samples."""
    n = x.shape[-1]
    freqs = np.fft.fftfreq(n, 1 / sfreq)
    analytic = np.where(freqs > 0, 2.0, 0.0)
    if n % 2 == 0:
        analytic[n // 2] = 1.0
    centers = bank_centers(low, high, spacing)
    spread = 10 ** (_BANK_A1 + _BANK_A2 * np.log10(centers)) * np.sqrt(2)
    gain = np.exp(-0.5 * ((np.abs(freqs)[None] - centers[:, None]) / spread[:, None]) ** 2) * analytic
    return np.abs(np.fft.ifft(np.fft.fft(x)[:, None] * gain[None]))


def band_envelope(x: np.ndarray, sfreq: float, low: float = 70, high: float = 150, spacing: float = 1 / 7) -> np.ndarray:
    """Sum of the band's envelopes."""
    return bank_envelopes(x, sfreq, low, high, spacing).sum(1)


def morlet_bank(sfreq: float, low: float, high: float, n: int, k0: float = 6) -> tuple[np.ndarray, np.ndarray]:
    """Morlet wavelets in the frequency domain (scales x n) and their periods, lowest frequency first; any n."""
    first = 1 / (1.1 * high)
    scales = first * 2 ** (0.2 * np.arange(0, np.log2(n / sfreq / first) / 0.2))
    factor = 4 * np.pi / (k0 + np.sqrt(2 + k0**2))
    beyond = np.nonzero(1 / (factor * scales) < low)[0]
    scales = scales[: beyond[0]] if len(beyond) else scales
    scales = scales[::-1]
    omega = 2 * np.pi * np.fft.fftfreq(n, 1 / sfreq)
    norm = np.sqrt(scales * 2 * np.pi * sfreq / n) * np.pi**-0.25 * np.sqrt(n) * np.sqrt(2)
    waves = norm[:, None] * np.exp(-((scales[:, None] * omega - k0) ** 2) / 2) * (omega > 0)
    return waves, factor * scales


def scaleogram(x: np.ndarray, sfreq: float, low: float = 2, high: float = 1000, k0: float = 6, decim: int = 1) -> np.ndarray:
    """Magnitude of the wavelet transform: signals x scales x every decim-th sample."""
    waves, _ = morlet_bank(sfreq, low, high, x.shape[-1], k0)
    return np.abs(np.fft.ifft(np.fft.fft(x)[:, None] * waves[None]))[..., ::decim]


def _morlet(frequency: float, cycles: float, sfreq: float) -> np.ndarray:
    sd = cycles / 2 / abs(frequency) / _MORLET_SD
    half = int(np.floor(np.round(sd * sfreq * _MORLET_SPREAD) / 2))
    at = np.arange(-half, half + 1)
    window = np.exp(-((at * (_MORLET_SPREAD / 2) / max(half, 1)) ** 2) / 2)
    return window / window.sum() * np.exp(2j * np.pi * frequency * at / sfreq)


def _convolve_same(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    n, m = x.shape[-1], len(w)
    size = 1 << (n + m - 2).bit_length()
    full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(w, size))
    start = (m - 1) // 2
    return full[..., start : start + n]


def superlets(x: np.ndarray, sfreq: float, frequencies: np.ndarray, cycles: float = 3, order: tuple[float, float] = (1, 30)) -> np.ndarray:
    """Superlet power: the geometric mean over wavelets of growing length, with a fractional last one."""
    orders = np.linspace(*order, len(frequencies))
    out = np.empty((len(x), len(frequencies), x.shape[-1]))
    for i, (f, o) in enumerate(zip(frequencies, orders)):
        whole, part = int(o), o - int(o)
        logs = np.zeros((len(x), x.shape[-1]))
        for k in range(1, whole + 1 + (part > 0)):
            power = 2 * np.abs(_convolve_same(x, _morlet(f, cycles * k, sfreq))) ** 2
            logs += np.log(np.maximum(power, 1e-300)) * (1 if k <= whole else part)
        out[:, i] = np.exp(logs / o)
    return out


@functools.lru_cache(8)
def dpss(n: int, half_bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """Slepian tapers of n samples (those that keep over nine tenths of their energy in the band) and their shares.

    Eigenvectors of the tridiagonal matrix that commutes with the band limit: bisection for the largest
    eigenvalues, then inverse iteration, so long windows need no dense matrix.
    """
    count = max(1, int(np.floor(2 * half_bandwidth - 1)))
    w = half_bandwidth / n
    i = np.arange(n)
    diagonal = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w)
    off = i[1:] * (n - i[1:]) / 2
    if n <= 1024:
        _, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
        tapers = vectors[:, ::-1][:, :count].T
    else:
        tapers = _largest_tridiagonal(diagonal, off, count)
    lags = 2 * w * np.sinc(2 * w * np.arange(n))
    size = 1 << (2 * n - 1).bit_length()
    auto = np.fft.irfft(np.abs(np.fft.rfft(tapers, size)) ** 2, size)[:, :n]
    share = auto[:, 0] * lags[0] + 2 * (auto[:, 1:] * lags[1:]).sum(1)
    for t, k in zip(tapers, range(count)):
        if (k % 2 == 0 and t.sum() < 0) or (k % 2 and t[np.argmax(np.abs(t) > 1e-7)] < 0):
            t *= -1
    good = share > 0.9
    return (tapers[good], share[good]) if good.any() else (tapers[:1], share[:1])


def _largest_tridiagonal(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """Unit eigenvectors of the `count` largest eigenvalues of a symmetric tridiagonal matrix."""
    bound = np.abs(d).max() + 2 * np.abs(e).max()
    squares = np.concatenate([[0.0], e**2])

    def above(points: np.ndarray) -> np.ndarray:
        """How many eigenvalues are over each point."""
        q, n = np.ones_like(points), np.zeros(len(points), int)
        for a, s in zip(d, squares):
            q = a - points - s / np.where(np.abs(q) < 1e-300, 1e-300, q)
            n += q > 0
        return n

    low, high = np.full(count, -bound), np.full(count, bound)
    for _ in range(60):
        middle = (low + high) / 2
        more = above(middle) > np.arange(count)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    vectors = []
    for value in (low + high) / 2:
        v = np.random.default_rng(1).standard_normal(len(d))
        for _ in range(4):
            v = _solve_tridiagonal(d - value - 1e-9 * bound, e, v)
            for u in vectors:
                v -= (u @ v) * u
            v /= np.linalg.norm(v)
        vectors.append(v)
    return np.array(vectors)


def _solve_tridiagonal(d: np.ndarray, e: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = len(d)
    c, x = np.empty(n - 1), b.tolist()
    d, e = d.tolist(), e.tolist()
    pivot = d[0]
    for i in range(n - 1):
        c[i] = e[i] / pivot
        x[i] /= pivot
        x[i + 1] -= e[i] * x[i]
        pivot = d[i + 1] - e[i] * c[i]
        pivot = pivot if abs(pivot) > 1e-300 else 1e-300
    x[-1] /= pivot
    for i in range(n - 2, -1, -1):
        x[i] -= c[i] * x[i + 1]
    return np.array(x)


def tapered_spectra(x: np.ndarray, tapers: np.ndarray, sfreq: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of each tapered, demeaned signal (signals x tapers x frequencies) and the frequencies."""
    n = x.shape[-1]
    spectra = np.fft.rfft((x - x.mean(-1, keepdims=True))[:, None] * tapers[None])
    spectra[..., 0] /= np.sqrt(2)
    if n % 2 == 0:
        spectra[..., -1] /= np.sqrt(2)
    return spectra, np.fft.rfftfreq(n, 1 / sfreq)


def harmonic_f(tapers: np.ndarray, spectra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thomson's F for a sine at each frequency, and its complex amplitude (signals x frequencies)."""
    even, odd = spectra[:, ::2], spectra[:, 1::2]
    sums = tapers[::2].sum(1)
    power = (sums**2).sum()
    amplitude = (even * sums[None, :, None]).sum(1) / power
    rest = (np.abs(even - amplitude[:, None] * sums[None, :, None]) ** 2).sum(1) + (np.abs(odd) ** 2).sum(1)
    return (len(tapers) - 1) * np.abs(amplitude) ** 2 * power / np.where(rest == 0, np.inf, rest), amplitude


def f_threshold(tapers: int, n: int, p: float = 0.05) -> float:
    """Critical value of F(2, 2K-2) at level p/n; with two degrees it has a closed form."""
    d = 2 * tapers - 2
    return np.inf if d <= 0 else d / 2 * ((p / n) ** (-2 / d) - 1)


def _remove_sines(x: np.ndarray, sfreq: float, lines: list[float] | None, width: float, half_bandwidth: float, p: float) -> np.ndarray:
    n = x.shape[-1]
    tapers, _ = dpss(n, half_bandwidth)
    spectra, freqs = tapered_spectra(x, tapers, sfreq)
    f, amplitude = harmonic_f(tapers, spectra)
    near = np.ones(len(freqs), bool) if lines is None else np.any([np.abs(freqs - line) <= width / 2 for line in lines], axis=0)
    coefficients = np.where((f > f_threshold(len(tapers), n, p)) & near, 2 * amplitude, 0)
    kept = np.nonzero(coefficients.any(0))[0]
    phase = np.exp(2j * np.pi * freqs[kept, None] * np.arange(n) / sfreq)
    return x - (coefficients[:, kept] @ phase).real


def overlap_add(x: np.ndarray, size: int, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The kernel on Hann-weighted windows that overlap by half; the last window takes the rest, edges are renormalised."""
    n = x.shape[-1]
    size = min(size, n)
    step = size - (size + 1) // 2
    if step < 1 or size == n:
        return kernel(x)
    starts = list(range(0, n - size + 1, step))
    out, weight = np.zeros_like(x, float), np.zeros(n)
    for i, a in enumerate(starts):
        b = n if i == len(starts) - 1 else a + size
        w = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(b - a) + 0.5) / (b - a))
        out[:, a:b] += w * kernel(x[:, a:b])
        weight[a:b] += w
    return out / weight


def line_filter(x: np.ndarray, sfreq: float, lines: list[float] | None, window: int, width: float = 10, bandwidth: float | None = None, p: float = 0.05) -> np.ndarray:
    """Signals without the significant sines near the line frequencies (None: anywhere)."""
    return overlap_add(x, window, lambda part: _remove_sines(part, sfreq, lines, width, bandwidth * part.shape[-1] / sfreq if bandwidth else 4, p))


def multitaper_power(x: np.ndarray, sfreq: float, frequencies: np.ndarray, cycles: np.ndarray, half_bandwidth: float = 2) -> np.ndarray:
    """Time-frequency power by tapered wavelets: signals x frequencies x samples."""
    out = np.empty((len(x), len(frequencies), x.shape[-1]))
    for i, (f, c) in enumerate(zip(frequencies, cycles)):
        n = max(3, int(round(c / f * sfreq)) | 1)
        tapers, _ = dpss(n, half_bandwidth)
        wave = np.exp(2j * np.pi * f * (np.arange(n) - n // 2) / sfreq)
        out[:, i] = np.mean([np.abs(_convolve_same(x, t * wave)) ** 2 for t in tapers], axis=0)
    return out


def welch(x: np.ndarray, sfreq: float, size: int) -> np.ndarray:
    """Power spectral density by averaged Hann windows that overlap by half."""
    size = min(size, x.shape[-1])
    w = np.hanning(size + 1)[:-1]
    parts = np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[:, :: max(1, size // 2)]
    power = np.abs(np.fft.rfft((parts - parts.mean(-1, keepdims=True)) * w)) ** 2 / (sfreq * (w**2).sum())
    power[..., 1 : -1 if size % 2 == 0 else None] *= 2
    return power.mean(1)


def band_power(x: np.ndarray, sfreq: float, low: float, high: float) -> np.ndarray:
    """log10 of the mean power between two frequencies (one number per signal)."""
    freqs = np.fft.rfftfreq(x.shape[-1], 1 / sfreq)
    spectrum = np.abs(np.fft.rfft(x)) ** 2 / x.shape[-1]
    return np.log10(np.maximum(spectrum[:, (freqs >= low) & (freqs <= high)].mean(1, keepdims=True), 1e-300))


def notch(x: np.ndarray, sfreq: float, frequency: float, quality: float = 30) -> np.ndarray:
    """Zero-phase second-order notch, forwards and backwards."""
    w = 2 * np.pi * frequency / sfreq
    alpha = np.sin(w) / (2 * quality)
    b = np.array([1, -2 * np.cos(w), 1]) / (1 + alpha)
    a = np.array([1, -2 * np.cos(w) / (1 + alpha), (1 - alpha) / (1 + alpha)])
    pad = min(3 * 10, x.shape[-1] - 1)
    y = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1) if pad > 0 else x
    for _ in range(2):
        y = _second_order(y, b, a)[:, ::-1]
    return y[:, pad : pad + x.shape[-1]]


def _second_order(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    y = np.empty_like(x)
    # start at rest for the first sample, so a constant passes without a transient
    gain = b.sum() / a.sum()
    z1, z2 = x[:, 0] * (gain - b[0]), x[:, 0] * (b[2] - a[2] * gain)
    for t in range(x.shape[-1]):
        v = x[:, t]
        out = b[0] * v + z1
        z1 = b[1] * v - a[1] * out + z2
        z2 = b[2] * v - a[2] * out
        y[:, t] = out
    return y


def cross_correlation_lag(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Lag at which each signal matches a template best (one number per signal)."""
    n, m = x.shape[-1], len(template)
    size = 1 << (n + m - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(template, size)), size)
    lag = np.argmax(c, axis=-1)
    return np.where(lag > size // 2, lag - size, lag)[:, None].astype(float)


def smoothed_log_power(x: np.ndarray, sfreq: float, low: float, high: float, smooth: float, baseline: int) -> np.ndarray:
    """log10 of the band's analytic power, smoothed by a Gaussian of `smooth` seconds, as z-scores of the first `baseline` samples."""
    n = x.shape[-1]
    freqs = np.fft.fftfreq(n, 1 / sfreq)
    analytic = np.fft.ifft(np.fft.fft(x) * np.where((freqs >= low) & (freqs <= high), 2.0, 0.0))
    damp = np.exp(-2 * (np.pi * np.fft.rfftfreq(n, 1 / sfreq) * smooth) ** 2)
    power = np.fft.irfft(np.fft.rfft(np.abs(analytic) ** 2) * damp, n)
    log = np.log10(np.maximum(power, 1e-300))
    first = log[:, :baseline]
    return (log - first.mean(1, keepdims=True)) / np.maximum(first.std(1, ddof=1, keepdims=True), 1e-12)


def mode_powers(x: np.ndarray, modes: int, rounds: int = 10) -> np.ndarray:
    """Mean power of each empirical mode of the signals (signals x modes), by sifting with linear envelopes."""
    out = np.zeros((len(x), modes))
    for i, signal in enumerate(x):
        rest = signal.astype(float)
        at = np.arange(len(rest))
        for m in range(modes):
            h = rest.copy()
            for _ in range(rounds):
                d = np.diff(h)
                tops = np.nonzero((d[:-1] > 0) & (d[1:] <= 0))[0] + 1
                lows = np.nonzero((d[:-1] < 0) & (d[1:] >= 0))[0] + 1
                if len(tops) < 2 or len(lows) < 2:
                    break
                h = h - (np.interp(at, tops, h[tops]) + np.interp(at, lows, h[lows])) / 2
            out[i, m] = (h**2).mean()
            rest = rest - h
    return out
