"""SCIP indexes as tables: protobuf decoding and symbol parsing.

Only the fields that the overlay needs are decoded; others are skipped by their wire type. Truncated input raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

OCCURRENCE = "document string, n int, begin_line int, begin_col int, symbol string, is_definition boolean, scope_begin array<int>, scope_end array<int>"
SYMBOL = "symbol string, owner string, member string, kind string, disambiguator string, skip_reason string"
#: Fixed values of the format: reasons why a symbol can't be a node.
MALFORMED, LOCAL, UNSUPPORTED = "malformed_symbol", "local_symbol", "unsupported_descriptor"
_DESCRIPTOR = re.compile(r"(?:`((?:[^`]|``)+)`|([\w+$-]+))(?:([/#.:!])|\(([^)]*)\)\.)|\[(?:`((?:[^`]|``)+)`|([\w+$-]+))\]|\((?:`((?:[^`]|``)+)`|([\w+$-]+))\)")


def fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of each field of a message: an integer for varints, else bytes."""
    at, n = 0, len(raw)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            if at >= n or shift > 63:
                raise ValueError("truncated varint")
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"wire type {kind}")
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        if at + size > n:
            raise ValueError("truncated field")
        at += size
        yield key >> 3, raw[at - size : at]


def _ints(value: bytes | int) -> list[int]:
    """Signed 32-bit integers of a packed or single field."""
    if isinstance(value, int):
        found = [value]
    else:
        found, at = [], 0
        while at < len(value):
            out = shift = 0
            while True:
                if at >= len(value):
                    raise ValueError("truncated varint")
                b = value[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            found.append(out)
    return [x - (1 << 64) if x >> 63 else x - (1 << 32) if x >> 31 == 1 else x for x in found]


def four(r: list[int]) -> list[int]:
    """A range as begin line, begin column, end line, end column; one line's has three numbers."""
    if len(r) == 3:
        return [r[0], r[1], r[0], r[2]]
    if len(r) == 4:
        return r
    raise ValueError(f"a range of {len(r)} numbers")


def occurrences(index: bytes) -> Iterator[dict]:
    """Rows of OCCURRENCE of a decoded index, its documents in order."""
    for number, document in fields(index):
        if number != 2:
            continue
        path, found = "", []
        for k, v in fields(document):
            if k == 1:
                path = v.decode()
            elif k == 2:
                own = {1: [], 7: [], 2: b"", 3: 0}
                for j, x in fields(v):
                    if j in (1, 7):
                        own[j] = own[j] + _ints(x)
                    elif j in (2, 3):
                        own[j] = x
                found.append(own)
        for n, own in enumerate(found):
            if not own[1]:
                continue
            at, definition = four(own[1]), bool(own[3] & 1)
            scope = four(own[7] or own[1]) if definition else None
            yield {
                "document": path, "n": n, "begin_line": at[0], "begin_col": at[1], "symbol": own[2].decode(), "is_definition": definition,
                "scope_begin": scope and scope[:2], "scope_end": scope and scope[2:],
            }


def read_occurrences(files: DataFrame) -> DataFrame:
    """OCCURRENCE rows of indexes (file, content). An index is one message, so a file is one task's."""
    schema = StructType.fromDDL(OCCURRENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = occurrences(content)
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist(some, schema=kind)

    return files.select("content").mapInArrow(run, OCCURRENCE)


def parse_symbol(symbol: str) -> dict:
    """What a symbol names: its owner type, and the member with its kind; or why it can't be a node."""
    out = dict.fromkeys(["owner", "member", "kind", "disambiguator", "skip_reason"]) | {"symbol": symbol}
    if symbol.startswith("local "):
        return out | {"skip_reason": LOCAL}
    parts = re.split(r"(?<! ) (?! )", symbol.strip(), maxsplit=4)
    if len(parts) < 5:
        head = symbol.strip().split(" ")
        parts = [*head[:4], " ".join(head[4:])] if len(head) >= 5 else []
    if not parts or not parts[4]:
        return out | {"skip_reason": MALFORMED}
    text, at, found = parts[4], 0, []
    while at < len(text):
        m = _DESCRIPTOR.match(text, at)
        if not m:
            return out | {"skip_reason": MALFORMED}
        name = (m[1] or m[5] or m[7] or "").replace("``", "`") or m[2] or m[6] or m[8]
        kind = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}.get(m[3]) or ("method" if m[4] is not None else "parameter")
        found.append((name, kind, m[4]))
        at = m.end()
    if any(k == "parameter" for _, k, _ in found):
        return out | {"skip_reason": UNSUPPORTED}
    package = [n for n, k, _ in found if k == "namespace"]
    rest = [f for f in found if f[1] != "namespace"]
    types = []
    while rest and rest[0][1] == "type":
        types.append(rest.pop(0)[0])
    owner = ".".join([*package, *types])
    if not owner:
        return out | {"skip_reason": MALFORMED}
    if not rest:
        return out | {"owner": owner, "kind": "type"}
    if len(rest) > 1 or rest[0][1] not in ("term", "method"):
        return out | {"skip_reason": UNSUPPORTED}
    return out | {"owner": owner, "member": rest[0][0], "kind": rest[0][1], "disambiguator": rest[0][2]}


def parse_symbols(symbols: DataFrame) -> DataFrame:
    """SYMBOL rows of distinct symbols (symbol)."""
    schema = StructType.fromDDL(SYMBOL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([parse_symbol(s) for s in batch.column(0).to_pylist()], schema=kind)

    return symbols.select("symbol").distinct().mapInArrow(run, SYMBOL)
