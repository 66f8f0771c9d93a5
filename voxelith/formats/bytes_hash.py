"""FNV-1a over bytes, in pieces that NumPy can multiply at once.

The hash of a byte string is a fold: each byte is mixed in and the state multiplied. Only the state's lowest byte meets
the next byte, so the low bytes are folded first, byte by byte through a table, and the rest is sums of products.
"""

from __future__ import annotations

import numpy as np

# The hash's offset and prime.
OFFSET, PRIME, WHOLE = 14695981039346656037, 1099511628211, (1 << 64) - 1
_LOW = PRIME & 0xFF
#: The lowest byte of the state after a mixed lowest byte.
_NEXT = bytes((x * _LOW) & 0xFF for x in range(256))
_PIECE = 1 << 16


def fnv1a64(data: bytes, state: int = OFFSET) -> int:
    """FNV-1a of ``data``, going on from ``state``.

    Mixing a byte b into a state s adds (s ^ b) - s, which depends on the low byte of s alone, and low bytes depend on low
    bytes alone. So the adds of a piece are known once its low bytes are, and the piece's hash is the sum of its adds times
    powers of the prime, modulo 2^64.
    """
    for at in range(0, len(data), _PIECE):
        piece = data[at:at + _PIECE]
        low, lows = state & 0xFF, bytearray(len(piece))
        for i, b in enumerate(piece):
            lows[i] = low
            low = _NEXT[low ^ b]
        before = np.frombuffer(bytes(lows), np.uint8).astype(np.int64)
        adds = ((before ^ np.frombuffer(piece, np.uint8)) - before).astype(np.uint64)
        n = len(piece)
        total = int((adds * _powers()[n:0:-1]).sum(dtype=np.uint64))
        state = (state * pow(PRIME, n, 1 << 64) + total) & WHOLE
    return state


_made: list[np.ndarray] = []


def _powers() -> np.ndarray:
    """Powers of the prime from 0 up to a piece's length, modulo 2^64."""
    if not _made:
        _made.append(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(_PIECE, PRIME, np.uint64))]))
    return _made[0]
