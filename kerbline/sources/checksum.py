"""CRC-32C of many byte strings at once.

A checksum is linear: strings are cut into lanes of LANE bytes, filled up with zeros in front, which a checksum that
starts at zero does not see; the lanes of all strings are worked on abreast, eight bytes a step, and put together
string by string, long ones by bundles of lanes.
"""

from __future__ import annotations

import functools

import numpy as np

#: Reversed polynomial of CRC-32C and the constant that masks stored checksums, fixed values of the record format.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: Bytes of a lane, and lanes of a bundle.
LANE, BUNDLE = 256, 64


@functools.cache
def _tables() -> np.ndarray:
    """[k, b]: the checksum of byte b before k zero bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(POLYNOMIAL), first >> 1)
    out = [first]
    for _ in range(7):
        out.append((out[-1] >> 8) ^ first[out[-1] & 0xFF])
    return np.stack(out)


@functools.cache
def _past(zeros: int) -> np.ndarray:
    """[k, b]: what byte k of a checksum becomes when so many zeros follow."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).ravel()
    for _ in range(zeros):
        state = (state >> 8) ^ _tables()[0][state & 0xFF]
    return state.reshape(4, 256)


def _join(sums: np.ndarray, first: np.ndarray, count: np.ndarray, zeros: int) -> np.ndarray:
    """One checksum for `count` checksums from `first` on, each of `zeros` bytes."""
    past, state = _past(zeros), np.zeros(len(first), np.uint32)
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        s = state[live]
        state[live] = past[0][s & 0xFF] ^ past[1][s >> 8 & 0xFF] ^ past[2][s >> 16 & 0xFF] ^ past[3][s >> 24] ^ sums[first[live] + k]
    return state


def _steps(lanes: np.ndarray) -> np.ndarray:
    """Checksums, from zero, of rows of bytes; their number is a multiple of eight."""
    t = _tables()
    state = np.zeros(len(lanes), np.uint32)
    for i in range(0, lanes.shape[1], 8):
        b = lanes[:, i : i + 8]
        low = state ^ (b[:, 0] | b[:, 1].astype(np.uint32) << 8 | b[:, 2].astype(np.uint32) << 16 | b[:, 3].astype(np.uint32) << 24)
        state = t[7][low & 0xFF] ^ t[6][low >> 8 & 0xFF] ^ t[5][low >> 16 & 0xFF] ^ t[4][low >> 24]
        state ^= t[3][b[:, 4]] ^ t[2][b[:, 5]] ^ t[1][b[:, 6]] ^ t[0][b[:, 7]]
    return state


def checksums(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each string."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    count = -(-size // LANE)
    # long strings have whole bundles of lanes
    count = np.where(count > BUNDLE, -(-count // BUNDLE) * BUNDLE, count)
    ends = np.cumsum(count) * LANE
    flat = np.zeros(int(count.sum()) * LANE, np.uint8)
    state = np.zeros(len(parts), np.uint32)
    for part, end in zip(parts, ends.tolist(), strict=True):
        flat[end - len(part) : end] = np.frombuffer(part, np.uint8)
    # all ones at the start are the first four bytes turned round
    for k in range(4):
        some = np.flatnonzero(size > k)
        flat[ends[some] - size[some] + k] ^= 0xFF
    lanes = _steps(flat.reshape(-1, LANE))
    first = ends // LANE - count
    long = np.flatnonzero(count > BUNDLE)
    few = np.flatnonzero(count <= BUNDLE)
    state[few] = _join(lanes, first[few], count[few], LANE)
    if len(long):
        bundles = count[long] // BUNDLE
        begins = np.cumsum(bundles) - bundles
        at = np.repeat(first[long] - begins * BUNDLE, bundles) + np.arange(int(bundles.sum())) * BUNDLE
        state[long] = _join(_join(lanes, at, np.full(len(at), BUNDLE), LANE), begins, bundles, LANE * BUNDLE)
    for i in np.flatnonzero(size < 4).tolist():  # too short for the turned bytes
        s = 0xFFFFFFFF
        for b in parts[i]:
            s = (s >> 8) ^ int(_tables()[0][(s ^ b) & 0xFF])
        state[i] = s
    return state ^ np.uint32(0xFFFFFFFF)


def masked(sums: np.ndarray) -> np.ndarray:
    """As they stand in record files: turned by 15 bits, plus a constant."""
    return ((sums >> np.uint32(15)) | (sums << np.uint32(17))) + np.uint32(MASK)


def lengths_that_fit(data: np.ndarray) -> np.ndarray:
    """Offsets at which eight bytes stand before their own masked checksum."""
    n = len(data) - 11
    if n <= 0:
        return np.zeros(0, np.int64)
    t = _tables()
    state = np.zeros(n, np.uint32)
    for k in range(8):
        b = data[k : k + n]
        state ^= t[7 - k][b ^ np.uint8(0xFF) if k < 4 else b]
    word = np.zeros(n, np.uint32)
    for k in range(4):
        word |= data[8 + k : 8 + k + n].astype(np.uint32) << np.uint32(8 * k)
    return np.flatnonzero(masked(state ^ np.uint32(0xFFFFFFFF)) == word)
