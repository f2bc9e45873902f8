"""Rows that fail to parse (problem 3).

A block of lines is parsed at once on Arrow columns: one linear-time pattern checks the
quoting and splits the fields, vectorised casts and look-ups make the values.  If any
line of a block is bad the block fails as a whole and is bisected; halves that parse are
kept, and only lines that fail alone are diagnosed by the strict scanner, which names the
reason.  Blocks never leave their task: no shuffle, one scan, memory for one Arrow batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.core.session import collect_bounded

BLANKS = " \t"
MAX_ID = 2**63 - 1
_FIELD = r'[ \t]*(?:"(?:[^"]|"")*"[ \t]*|[^" \t,][^",]*|)'
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NUMBER_RE = re.compile(_NUMBER)

SCHEMA = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("node_id", T.LongType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("node_embeds", T.ArrayType(T.DoubleType())),
        T.StructField("source_id", T.LongType()),
        T.StructField("dest_id", T.LongType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("dest_type", T.StringType()),
        T.StructField("edge_type", T.StringType()),
    ]
)
_ARROW = pa.schema(
    [
        ("file_name", pa.string()), ("line_no", pa.int64()), ("kind", pa.string()), ("reason", pa.string()),
        ("node_id", pa.int64()), ("node_type", pa.string()), ("node_embeds", pa.list_(pa.float64())),
        ("source_id", pa.int64()), ("dest_id", pa.int64()), ("source_type", pa.string()),
        ("dest_type", pa.string()), ("edge_type", pa.string()),
    ]
)


class BadBlock(ValueError):
    """Some line of the block is no valid record."""


@dataclass(frozen=True)
class Rules:
    """What is valid: types by lower-case name -> spelling, edge triples in lower case."""

    node_types: dict[str, str]
    edge_types: dict[tuple[str, str, str], tuple[str, str, str]]
    n_dims: int = 64


# --- strict scanner: one line -------------------------------------------------------


def split_strict(line: str) -> list[str] | None:
    """The fields of a line, or None where the quoting is broken."""
    fields, at, end = [], 0, len(line)
    while True:
        while at < end and line[at] in BLANKS:
            at += 1
        if at < end and line[at] == '"':
            at += 1
            value = []
            while True:
                close = line.find('"', at)
                if close < 0:
                    return None
                value.append(line[at:close])
                at = close + 1
                if at < end and line[at] == '"':
                    value.append('"')
                    at += 1
                else:
                    break
            while at < end and line[at] in BLANKS:
                at += 1
            if at < end and line[at] != ",":
                return None
            fields.append("".join(value))
        else:
            comma = line.find(",", at)
            stop = end if comma < 0 else comma
            raw = line[at:stop]
            if '"' in raw:
                return None
            fields.append(raw.rstrip(BLANKS))
            at = stop
        if at >= end:
            return fields
        at += 1


def _id(text: str) -> int | None:
    if not text or not text.isascii() or not text.isdigit():
        return None
    digits = text.lstrip("0")
    if len(digits) > 19:  # int() on a very long run of digits would be refused
        return None
    value = int(digits or "0")
    return value if value <= MAX_ID else None


def _vector(text: str, n: int) -> list[float] | None:
    if text == "":
        return []
    parts = text.split(":")
    if len(parts) != n or not all(_NUMBER_RE.fullmatch(p) for p in parts):
        return None
    values = [float(p) for p in parts]
    return values if all(map(math.isfinite, values)) else None


def diagnose(line: str | None, kind: str, rules: Rules) -> tuple[str | None, dict]:
    """(reason, {}) of a bad line, (None, record) of a valid one."""
    line = "" if line is None else line
    fields = split_strict(line[:-1] if line.endswith("\r") else line)
    if fields is None:
        return "quoting", {}
    if kind == "node":
        if len(fields) != 3:
            return "columns", {}
        node, name, vec = _id(fields[0]), rules.node_types.get(fields[1].lower()), _vector(fields[2], rules.n_dims)
        if node is None or name is None or vec is None:
            return "value", {}
        return None, {"node_id": node, "node_type": name, "node_embeds": vec}
    if kind == "edge":
        if len(fields) != 5:
            return "columns", {}
        src, dst = _id(fields[0]), _id(fields[1])
        triple = rules.edge_types.get((fields[2].lower(), fields[4].lower(), fields[3].lower()))
        if src is None or dst is None or triple is None:
            return "value", {}
        return None, {"source_id": src, "dest_id": dst, "source_type": triple[0], "edge_type": triple[1], "dest_type": triple[2]}
    return "columns", {}


# --- columnar path: a block of lines ------------------------------------------------


def _all(mask: pa.Array) -> None:
    if not pc.all(mask, skip_nulls=False).as_py():
        raise BadBlock


def _fields(lines: pa.Array, n: int) -> list[pa.Array]:
    pattern = "^" + ",".join(f"(?P<f{i}>{_FIELD})" for i in range(n)) + "$"
    if pc.any(pc.match_substring(lines, "\n")).as_py():  # `$` and `[^"]` treat line feeds apart
        raise BadBlock
    parts = pc.extract_regex(lines, pattern)
    if parts.null_count:
        raise BadBlock
    out = []
    for i in range(n):
        f = pc.utf8_trim(parts.field(i), BLANKS)
        quoted = pc.starts_with(f, '"')
        if pc.any(quoted).as_py():
            inner = pc.replace_substring(pc.utf8_slice_codeunits(f, 1, -1), '""', '"')
            f = pc.if_else(quoted, inner, f)
        out.append(f)
    return out


def _ids(f: pa.Array) -> pa.Array:
    _all(pc.match_substring_regex(f, "^[0-9]+$"))
    short = pc.replace_substring_regex(f, "^0+([0-9])", r"\1")
    _all(pc.less_equal(pc.utf8_length(short), 19))
    try:
        return pc.cast(short, pa.int64())
    except pa.ArrowInvalid as e:
        raise BadBlock from e


def _names(f: pa.Array, known: list[str], spelled: list[str]) -> pa.Array:
    at = pc.index_in(pc.utf8_lower(f), pa.array(known, pa.string()))
    if at.null_count:
        raise BadBlock
    return pa.array(spelled, pa.string()).take(at)


def parse_block(lines: pa.Array, kind: str, rules: Rules) -> dict[str, pa.Array]:
    """Columns of a block whose lines are all valid; BadBlock otherwise."""
    lines = pc.replace_substring_regex(lines, "\r$", "") if pc.any(pc.ends_with(lines, "\r")).as_py() else lines
    if kind == "node":
        ids, names, vecs = _fields(lines, 3)
        number = pa.array([], pa.string())
        empty = pc.equal(vecs, "")
        number = pc.split_pattern(pc.if_else(empty, pa.scalar(None, pa.string()), vecs), ":")
        _all(pc.equal(pc.fill_null(pc.list_value_length(number), rules.n_dims), rules.n_dims))
        flat = pc.list_flatten(number)
        if len(flat):
            _all(pc.match_substring_regex(flat, f"^{_NUMBER}$"))
        try:
            values = pc.cast(pc.utf8_ltrim(flat, "+"), pa.float64())
        except pa.ArrowInvalid as e:
            raise BadBlock from e
        if len(values):
            _all(pc.is_finite(values))
        sizes = pc.if_else(empty, 0, rules.n_dims)
        ends = pc.cumulative_sum(sizes)
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.cast(ends, pa.int32())])
        return {
            "node_id": _ids(ids),
            "node_type": _names(names, list(rules.node_types), list(rules.node_types.values())),
            "node_embeds": pa.ListArray.from_arrays(offsets, values),
        }
    if kind == "edge":
        src, dst, stype, dtype, etype = _fields(lines, 5)
        if any(pc.any(pc.match_substring(f, "\x00")).as_py() for f in (stype, dtype, etype)):
            raise BadBlock
        key = pc.binary_join_element_wise(stype, etype, dtype, "\x00")
        known = ["\x00".join(k) for k in rules.edge_types]
        at = pc.index_in(pc.utf8_lower(key), pa.array(known, pa.string()))
        if at.null_count:
            raise BadBlock
        spelled = list(rules.edge_types.values())
        part = lambda i: pa.array([s[i] for s in spelled], pa.string()).take(at)
        return {"source_id": _ids(src), "dest_id": _ids(dst), "source_type": part(0), "edge_type": part(1), "dest_type": part(2)}
    raise BadBlock


LEAF = 8  # lines that are diagnosed rather than bisected further: a block costs as much as some lines
SMALLEST, LARGEST = 64, 8192  # blocks start smaller where many fail, larger where they pass


def _walk(lines: pa.Array, kind: str | None, rules: Rules) -> tuple[list[int], dict[str, pa.Array], list[tuple[int, str]]]:
    """(positions of valid lines, their columns, (position, reason) of bad lines)."""
    runs: list[tuple[np.ndarray, dict[str, pa.Array]]] = []
    singles: list[tuple[int, dict]] = []
    bad: list[tuple[int, str]] = []

    def settle(at: int, part: pa.Array) -> bool:
        """Parse a block, bisecting it as far as need be; whether it passed as a whole."""
        passed, stack = True, [(at, part)]
        while stack:
            at, part = stack.pop()
            try:
                if part.null_count:
                    raise BadBlock
                runs.append((np.arange(at, at + len(part)), parse_block(part, kind, rules)))
                continue
            except BadBlock:
                passed = False
            if len(part) > LEAF:
                half = len(part) // 2
                stack += [(at + half, part.slice(half)), (at, part.slice(0, half))]
                continue
            for i, line in enumerate(part.to_pylist()):
                reason, record = diagnose(line, kind, rules)
                if reason is None:
                    singles.append((at + i, record))
                else:
                    bad.append((at + i, reason))
        return passed

    at, size = 0, 512
    while at < len(lines):
        n = min(size, len(lines) - at)
        size = min(size * 2, LARGEST) if settle(at, lines.slice(at, n)) else max(size // 2, SMALLEST)
        at += n
    if singles:
        names = singles[0][1]
        columns = {k: pa.array([r[k] for _, r in singles], _ARROW.field(k).type) for k in names}
        runs.append((np.array([at for at, _ in singles]), columns))
    if not runs:
        return [], {}, bad
    where = np.concatenate([r for r, _ in runs])
    return where, {k: pa.concat_arrays([c[k] for _, c in runs]) for k in runs[0][1]}, bad


def _rows(part: pa.Table, kind: str | None, reasons: pa.Array | None, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n, arrays = part.num_rows, []
    for f in _ARROW:
        if f.name in ("file_name", "line_no"):
            arrays.append(pa.concat_arrays(part[f.name].cast(f.type).chunks))
        elif f.name == "kind":
            arrays.append(pa.array([kind] * n, pa.string()))
        elif f.name == "reason" and reasons is not None:
            arrays.append(reasons)
        else:
            arrays.append(columns.get(f.name, pa.nulls(n, f.type)))
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _parser(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            names = pc.fill_null(table["file_name"], "")
            is_node, is_edge = pc.ends_with(names, "_nodes.csv"), pc.ends_with(names, "_edges.csv")
            other = pc.invert(pc.or_(is_node, is_edge))
            for kind, mask in (("node", is_node), ("edge", is_edge), (None, other)):
                part = table.filter(mask).combine_chunks()
                if not part.num_rows:
                    continue
                where, columns, bad = _walk(pa.concat_arrays(part["line"].chunks), kind, rules)
                if len(where):
                    yield _rows(part.take(pa.array(where)), kind, None, columns)
                if bad:
                    yield _rows(part.take(pa.array([at for at, _ in bad])), kind, pa.array([r for _, r in bad]), {})

    return run


def rules_from(node_types: DataFrame, edge_types: DataFrame, n_dims: int = 64, limit: int = 10_000) -> Rules:
    """Rules of the (fixed, small) type tables; their size is checked against `limit`."""
    nodes = collect_bounded(node_types.select("node_type").filter("node_type is not null"), limit, "node_types")
    edges = collect_bounded(
        edge_types.select("source_type", "edge_type", "dest_type").na.drop(), limit, "edge_types"
    )
    return Rules(
        {r[0].lower(): r[0] for r in nodes},
        {(r[0].lower(), r[1].lower(), r[2].lower()): (r[0], r[1], r[2]) for r in edges},
        n_dims,
    )


def parse_records(lines: DataFrame, rules: Rules) -> DataFrame:
    """Every line of `lines` (file_name, line_no, line) once: typed columns, or `reason`.

    `kind` is `node` for files `*_nodes.csv`, `edge` for `*_edges.csv`, else null.  A valid
    line has a null reason and the columns of its kind (an empty embedding is an empty
    array); a bad one has reason `quoting`, `columns` or `value`, the first that holds, and
    null columns.  A null line counts as an empty one (`columns`); a line of a file of
    neither kind has broken `quoting` or wrong `columns`.  Types come out as spelled in the
    rules.  Other columns of `lines` are ignored; empty input gives no rows.
    """
    return lines.select(
        F.col("file_name").cast("string"), F.col("line_no").cast("bigint"), F.col("line").cast("string")
    ).mapInArrow(_parser(rules), SCHEMA)


def rejects(parsed: DataFrame) -> DataFrame:
    """(file_name, line_no, reason) of the lines that are no valid record."""
    return parsed.filter("reason is not null").select("file_name", "line_no", "reason")


def node_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is null and kind = 'node'").select("file_name", "line_no", "node_id", "node_type", "node_embeds")


def edge_records(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is null and kind = 'edge'").select(
        "file_name", "line_no", "source_id", "dest_id", "source_type", "dest_type", "edge_type"
    )
