"""Words, code points and 64-bit hashes of whole texts as numpy arrays.

A word is a run of anything but the six ASCII white space characters. Hashes depend on
the content alone: they are equal on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Powers of the base and of its inverse, as long as the longest piece so far."""

    up = _powers(_BASE, 4096)
    down = _powers(_INVERSE, 4096)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            cls.up, cls.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        return cls.up, cls.down


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for each run, whatever the place of the run."""
    up, down = _Tables.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; long texts are hashed in pieces."""
    starts, ends = word_spans(data)
    out = np.empty(len(starts), np.uint64)
    codes, at = np.frombuffer(data, np.uint8), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _CHUNK, "right")))
        low, high = starts[at], ends[to - 1]
        out[at:to] = run_hashes(_BYTE[codes[low:high]], starts[at:to] - low, ends[at:to] - low)
        at = to
    return starts, ends, out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive values."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out *= _BASE
        out += hashes[k : k + count]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of ``width`` consecutive values."""
    step, out = 1, values
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as BIGINT."""
    return values.view(np.int64)


def batched(schema: pa.Schema, fill: Callable[[pa.RecordBatch], Iterator[tuple]],
            rows: int = 2000) -> Callable:
    """A function for mapInArrow: ``fill`` yields row tuples of ``schema`` from a batch."""
    def run(batches):
        for batch in batches:
            held = []
            for row in fill(batch):
                held.append(row)
                if len(held) >= rows:
                    yield _table(held, schema)
                    held = []
            if held:
                yield _table(held, schema)
    return run


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
