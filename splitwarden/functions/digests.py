"""The beginnings of MD5 digests of many short strings at once, in numpy."""

from __future__ import annotations

import math

import numpy as np

#: Bytes of a string that fits one block.
LONGEST = 55
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _words(texts: list[bytes], at: int, end: bytes = b"") -> np.ndarray:
    """The 16 words of blocks that hold these texts, all of one length, from byte ``at`` on."""
    block = np.zeros((len(texts), 64), np.uint8)
    width = len(texts[0]) + len(end)
    block[:, at : at + width] = np.frombuffer(b"".join(t + end for t in texts), np.uint8).reshape(len(texts), width)
    return block.view("<u4")


def md5_heads(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """The first 32 bits of the digest of each head followed by each tail: heads of one length, tails of one length,
    LONGEST bytes together at most."""
    many, more = len(heads[0]), len(tails[0])
    x, y = _words(heads, 0), _words(tails, many, b"\x80")
    word = []
    for i in range(16):
        # Words of heads or tails alone stay a row or a column.
        if i * 4 + 4 <= many:
            word.append(x[:, None, i])
        elif i * 4 >= many:
            word.append(y[None, :, i])
        else:
            word.append(x[:, None, i] | y[None, :, i])
    word[14] = np.full((1, 1), (many + more) * 8, np.uint32)
    # Five arrays take turns, so that all steps are in place.
    shape = (len(heads), len(tails))
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        f += word[g] + _SINES[i]
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=turned)
        f >>= np.uint32(32 - turn)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    return a.byteswap().astype(np.int64)
