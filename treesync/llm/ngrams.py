"""Hashed character n-grams, vectorised: what the language and quality models see of a text."""

from __future__ import annotations

import numpy as np

DIMS = 8192
_TABLE: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Code point -> lower-case letter, or 0 for what isn't a letter; built once a worker."""
    if not _TABLE:
        out = np.zeros(0x33480, np.uint64)
        for c in range(0x3347F):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(out)
    return _TABLE[0]


def letters(text: str) -> np.ndarray:
    """Folded letters with a single 0 between words and at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    f = _folded()[np.minimum(codes, 0x3347F)]
    f = np.concatenate([np.zeros(1, np.uint64), f, np.zeros(1, np.uint64)])
    keep = np.ones(len(f), bool)
    keep[1:] = (f[1:] != 0) | (f[:-1] != 0)
    return f[keep]


def counts(text: str | None, dims: int = DIMS) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of letters and word ends; None without letters."""
    f = letters(text or "")
    if len(f) < 3:
        return None
    p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    two = f[:-1] * p + f[1:] + np.uint64(1)
    three = two[:-1] * p + f[2:] + np.uint64(2)
    grams = np.concatenate([f[f != 0], two, three]) * q
    return np.bincount((grams >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)


def tfidf(texts: list, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows (zero without letters) and the number of n-grams of each text."""
    out, sizes = np.zeros((len(texts), len(idf)), np.float32), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        c = counts(text, len(idf))
        if c is not None:
            sizes[i] = c.sum()
            x = np.log1p(c) * idf
            norm = np.linalg.norm(x)
            if norm:
                out[i] = x / norm
    return out, sizes
