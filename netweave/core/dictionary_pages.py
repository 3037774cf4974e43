"""Distinct candidates of one Parquet column chunk, from its dictionary page alone.

Page headers are walked without reading the pages' bodies. The dictionary holds every distinct value only
if all data pages are dictionary-encoded; otherwise None is returned and the caller scans the chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Fixed values of the Parquet format: page types and encodings.
DATA_PAGE, INDEX_PAGE, DICTIONARY_PAGE, DATA_PAGE_V2 = 0, 1, 2, 3
PLAIN_DICTIONARY, RLE_DICTIONARY = 2, 8
DTYPES = {"INT32": "<i4", "INT64": "<i8", "FLOAT": "<f4", "DOUBLE": "<f8"}


class _Header:
    """A page header in Thrift's compact protocol, as a nested dict of field numbers."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.fields = self._struct()

    def _byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def _varint(self) -> int:
        out = shift = 0
        while True:
            b = self._byte()
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def _signed(self) -> int:
        n = self._varint()
        return (n >> 1) ^ -(n & 1)

    def _value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self._byte()
        if kind in (4, 5, 6):
            return self._signed()
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self._varint()
            self.at += n
            return None
        if kind in (9, 10):
            head = self._byte()
            n = head >> 4 if head >> 4 < 15 else self._varint()
            return [self._value(head & 15) for _ in range(n)]
        if kind == 12:
            return self._struct()
        raise ValueError(f"field type {kind}")

    def _struct(self) -> dict:
        out, field = {}, 0
        while (head := self._byte()) != 0:
            field = field + (head >> 4) if head >> 4 else self._signed()
            out[field] = self._value(head & 15)
        return out


def _plain(data: bytes, kind: str, n: int) -> list | None:
    if kind in DTYPES:
        return np.frombuffer(data, DTYPES[kind], n).tolist()
    if kind != "BYTE_ARRAY":
        return None
    out, at = [], 0
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out


def dictionary_values(file, chunk) -> list | None:
    """All distinct non-null values of the chunk in physical form, or None where the dictionary can't tell."""
    if not chunk.has_dictionary_page:
        return None
    at = min(x for x in (chunk.dictionary_page_offset, chunk.data_page_offset) if x)
    end, seen, values = at + chunk.total_compressed_size, 0, None
    while at < end and seen < chunk.num_values:
        file.seek(at)
        try:
            header = _Header(file.read(min(4096, end - at)))
        except (IndexError, ValueError):
            return None
        kind, raw, packed, body = header.fields[1], header.fields[2], header.fields[3], at + header.at
        if kind == DICTIONARY_PAGE:
            file.seek(body)
            data = file.read(packed)
            if chunk.compression != "UNCOMPRESSED":
                try:
                    data = pa.decompress(data, raw, codec=chunk.compression.lower(), asbytes=True)
                except (ValueError, OSError, NotImplementedError):
                    return None
            values = _plain(data, chunk.physical_type, header.fields[7][1])
        elif kind in (DATA_PAGE, DATA_PAGE_V2):
            info = header.fields[5 if kind == DATA_PAGE else 8]
            if info[2 if kind == DATA_PAGE else 4] not in (PLAIN_DICTIONARY, RLE_DICTIONARY):
                return None
            seen += info[1]
        at = body + packed
    return values
