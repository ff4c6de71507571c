"""Plain readings that several tests share."""

import numpy as np


def plain_passages(raws, length, words):
    """Each text without the runs of bytes that repeated strings cover and that hold enough words."""
    seen = {}
    for i, raw in raws.items():
        for p in range(len(raw) - length + 1):
            seen.setdefault(raw[p : p + length], []).append((i, p))
    gone = {i: np.zeros(len(raw), bool) for i, raw in raws.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = True
    out = {}
    for i, raw in raws.items():
        g = gone[i]
        edge = np.flatnonzero(np.diff(np.r_[0, g.astype(int), 0]))
        for s, e in zip(edge[::2], edge[1::2]):
            end = e
            while s < e and raw[s] & 0xC0 == 0x80:  # a character of which one half is covered stays
                g[s] = False
                s += 1
            while e < len(raw) and raw[e] & 0xC0 == 0x80:
                e -= 1
            g[e:end] = False
            if len(raw[s:e].split()) < words:
                g[s:e] = False
        out[i] = bytes(b for b, x in zip(raw, g) if not x)
    return out
