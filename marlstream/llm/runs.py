"""Runs of bytes of a class (words) in the texts of a batch, block by block, and their CRC-32, with NumPy.

A block is cut where no run goes on, so that memory follows the block and the longest run and not the longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 20
#: longer runs get their CRC from zlib one by one
_SHORT = 48


def runs(data: np.ndarray, offsets: np.ndarray, inner: Callable[[np.ndarray], np.ndarray], most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, start, end, text number) of the runs of each block; a run never crosses texts. inner(bytes) says which
    bytes belong to runs; it may look at the byte before."""
    at = 0
    while at < len(data):
        to = min(len(data), at + most)
        while to < len(data):
            ends = np.flatnonzero(~inner(data[to - 1 : to + 4096])[1:])
            if len(ends):
                to += int(ends[0])
                break
            to = min(len(data), to + 4096)
        block = data[at:to]
        own = inner(block)
        first, last = np.searchsorted(offsets, [at, to], side="left")
        cut = np.zeros(len(block) + 1, bool)
        cut[offsets[first:last] - at] = True
        cut[[0, -1]] = True
        edge = np.flatnonzero(own[:-1] != own[1:]) + 1
        starts = np.unique(np.concatenate([np.flatnonzero(own & cut[:-1]), edge[own[edge]]]))
        ends = np.unique(np.concatenate([np.flatnonzero(own & cut[1:]) + 1, edge[~own[edge]]]))
        yield block, starts, ends, np.searchsorted(offsets, starts + at, side="right") - 1
        at = to


def _step_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_STEP = _step_table()
_BYTE = np.uint32(255)


def _apply(op: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values for each byte at each of four places."""
    return op[0][crc & _BYTE] ^ op[1][(crc >> np.uint32(8)) & _BYTE] ^ op[2][(crc >> np.uint32(16)) & _BYTE] ^ op[3][crc >> np.uint32(24)]


def _shifts() -> list[np.ndarray]:
    """Maps that put 1, 2, 4, ... zero bytes behind what a CRC has read."""
    byte = np.arange(256, dtype=np.uint32)
    op = np.stack([_STEP[x & _BYTE] ^ (x >> np.uint32(8)) for x in (byte << np.uint32(8 * j) for j in range(4))])
    out = [op]
    for _ in range(47):
        out.append(np.stack([_apply(out[-1], out[-1][j]) for j in range(4)]))
    return out


_SHIFTS = _shifts()


def crcs(block: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each run's bytes."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, n = start[order], length[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-n, -_SHORT, side="left"))
    alive = len(n)
    for j in range(int(n[long]) if long < len(n) else 0):
        alive = int(np.searchsorted(-n, -j, side="left"))
        state[long:alive] = _STEP[(state[long:alive] ^ block[at[long:alive] + j]) & _BYTE] ^ (state[long:alive] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        state[i] = zlib.crc32(block[at[i] : at[i] + n[i]].tobytes())
    out = np.empty_like(state)
    out[order] = state
    return out


def joined_crcs(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of texts put together, from those of both parts and the length of the second."""
    out = first.astype(np.uint32)
    for bit in range(int(length.max(initial=0)).bit_length()):
        some = np.flatnonzero((length >> bit) & 1)
        out[some] = _apply(_SHIFTS[bit], out[some])
    return out ^ second


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, four bits at a time."""
    table = list(range(16))
    for _ in range(4):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    x = f"hex(encode({text}))"
    digits = f"list_transform(range(1, len({x}) + 1), lambda i: (strpos('0123456789ABCDEF', {x}[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce({digits}, lambda a, v: xor(a >> 4, ({table}::BIGINT[])[(xor(a, v) & 15) + 1]), 4294967295::BIGINT))"
