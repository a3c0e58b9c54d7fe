"""Arrow arrays of texts in slices of bounded size, so that a worker's memory grows neither with rows nor with their lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that become Python strings at a time.
SLICE_BYTES = 2 << 20


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Slices of about `most` bytes each: at least a row, never part of one. An empty array is one slice."""
    start = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        if i > start and total + n > most:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += n
    yield texts.slice(start)
