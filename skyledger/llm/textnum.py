"""Small numpy helpers on one text: words as 64-bit hashes with byte spans, and windows of words."""

from __future__ import annotations

import numpy as np

_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

#: Bytes that belong to words: digits and letters; bytes of characters beyond ASCII count too, but for ``ink``'s exceptions.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
# Unicode ranges (first, last).
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
PUNCTUATION = [(0x0080, 0x00A9), (0x00AB, 0x00B4), (0x00B6, 0x00B9), (0x00BB, 0x00BF), (0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """r^0 .. r^(n-1) modulo 2^64 (or of the inverse of r)."""
    key = "i" if inverse else "p"
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _R_INV if inverse else _R, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 1 << 21:
            _powers[key] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (splitmix's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _within(codes: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    return np.any([(codes >= low) & (codes <= high) for low, high in ranges], axis=0)


def ink(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(which bytes belong to words, where a word begins though the byte before belongs to one).

    Punctuation beyond ASCII belongs to none, and each character of a script without spaces is a word.
    """
    inside = WORD_BYTE[data]
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE0))  # the first bytes of all characters in question
    if not len(lead):
        return inside, None
    size = np.where(data[lead] < 0xE0, 2, np.where(data[lead] < 0xF0, 3, 4))
    code = data[lead].astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        code[more] = code[more] << 6 | data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F
    mark, alone = _within(code, PUNCTUATION), _within(code, UNSPACED)
    for k in range(4):
        inside[(lead + k)[mark & (size > k)]] = False
    begins = np.zeros(len(data) + 1, bool)
    begins[lead[alone]] = True
    begins[(lead + size)[alone].clip(max=len(data))] = True
    return inside, begins[:-1]


def spans(data: np.ndarray, inside: np.ndarray | None = None, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` (by default: of words), which also end where the next ``begins``."""
    if inside is None:
        inside, begins = ink(data)
    if begins is None:
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        return edge[::2], edge[1::2]
    before, here = np.append(False, inside), np.append(inside, False)
    cut = np.append(begins, False)
    return np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], by differences of one running polynomial sum."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power(len(data) + 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def as_bytes(text: str | None) -> np.ndarray:
    """UTF-8 bytes of a text; lone surrogates are replaced, null is empty."""
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of a text: runs of letters and digits, punctuation between them dropped.

    Each character of a script without spaces is a word.
    """
    data = as_bytes((text or "").lower())
    return span_hashes(data, *spans(data)) if len(data) else np.zeros(0, np.uint64)


def groups(texts: list, limit: int = 200_000) -> list[list]:
    """``texts`` in order, in lists of about ``limit`` characters, so that one numpy call serves many short texts."""
    out, size = [[]], 0
    for text in texts:
        if out[-1] and size + len(text or "") > limit:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text or "")
    return out


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the parts with a line end after each, where each part starts and at last the end)."""
    sizes = np.array([0, *(len(p) + 1 for p in parts)])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), np.cumsum(sizes)


def word_hashes_of(texts: list) -> list[np.ndarray]:
    """word_hashes of each text, made together."""
    out = []
    for group in groups(texts):
        data, begins = joined([(t or "").lower().encode("utf-8", "replace") for t in group])
        starts, ends = spans(data)
        out += np.split(span_hashes(data, starts, ends), np.searchsorted(starts, begins[1:-1]))
    return out


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; of all words together if there are fewer, of none if there is none."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(_R) + words[k : k + len(out)]
    return mixed(out)


def occurrence(values: np.ndarray) -> np.ndarray:
    """0 for the first place where a value stands, 1 for the second, and so on."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]] if len(values) else np.zeros(0, bool)
    place = np.arange(len(values))
    out = np.empty(len(values), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return out
