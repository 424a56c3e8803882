"""Tables and metadata that change: tabular diff, JSON diff, lifecycle."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

#: Lifecycle: state and operation to the next state; anything else is refused.
TRANSITIONS = {("WORKING", "publish"): "PUBLISHED", ("PUBLISHED", "withdraw"): "WITHDRAWN", ("PUBLISHED", "end"): "ENDED", ("WITHDRAWN", "reopen"): "WORKING"}


def json_changes(base, target, path: str = "") -> list[tuple[str, str | None, str | None]]:
    """(pointer, base, target): objects by the union of their keys, anything else as a whole."""
    if isinstance(base, dict) and isinstance(target, dict):
        out = []
        for key in sorted(base.keys() | target.keys()):
            step = f"{path}/{key.replace('~', '~0').replace('/', '~1')}"
            if key in base and key in target:
                out += json_changes(base[key], target[key], step)
            else:
                out.append((step, _dump(base[key]) if key in base else None, _dump(target[key]) if key in target else None))
        return out
    return [] if base == target and type(base) is type(target) else [(path, _dump(base), _dump(target))]


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def parse_unique(text: str):
    """JSON without repeated keys; ValueError for repeated keys and broken text."""
    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    return json.loads(text, object_pairs_hook=once)


def json_diff(pairs: DataFrame) -> DataFrame:
    """id, pointer, base, target of every difference in ``pairs`` (id, base, target as JSON text)."""
    def run(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            out = [(i, *c) for i, b, t in zip(*(c.to_pylist() for c in batch.columns)) for c in json_changes(json.loads(b or "null"), json.loads(t or "null"))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.string()))], ["id", "pointer", "base", "target"])

    return pairs.select(F.col("id").cast("long"), "base", "target").mapInArrow(run, "id long, pointer string, base string, target string")


def canonical_json(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` (id, and JSON text) as id, canonical, valid: sorted keys, no spaces; repeated keys are invalid."""
    def run(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            out = []
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out.append((i, _dump(parse_unique(text or "")), True))
                except ValueError:
                    out.append((i, None, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.bool_()))], ["id", "canonical", "valid"])

    return rows.select(F.col("id").cast("long"), column).mapInArrow(run, "id long, canonical string, valid boolean")


def unique_delimiter(text: str) -> str | None:
    """The only one of comma, semicolon, tab and bar that parses every row to the same two or more columns."""
    import csv
    import io

    found = []
    for mark in ",;\t|":
        widths = {len(r) for r in csv.reader(io.StringIO(text), delimiter=mark)}
        if len(widths) == 1 and widths.pop() >= 2:
            found.append(mark)
    return found[0] if len(found) == 1 else None


def compare_rows(base: list[list[str]], target: list[list[str]]) -> list[tuple[str, int, int, str | None, str | None]]:
    """(kind, row, column, base, target) of two tables; kind "Ambiguous" stands alone."""
    if base == target:
        return []
    if len(base) == len(target) and any(len({tuple(r) for r in rows}) < len(rows) for rows in (base, target)):
        return [("Ambiguous", -1, -1, None, None)]
    if sorted(base) == sorted(target):
        return [("Reordered", i, target.index(r), None, None) for i, r in enumerate(base) if target.index(r) != i]
    if len(base) == len(target) and base and target and (columns := _columns(base, target)):
        return columns
    head = 0
    while head < min(len(base), len(target)) and base[head] == target[head]:
        head += 1
    tail = 0
    while tail < min(len(base), len(target)) - head and base[-1 - tail] == target[-1 - tail]:
        tail += 1
    left, right = base[head : len(base) - tail], target[head : len(target) - tail]
    if len(left) == len(right) == 1 and len(left[0]) == len(right[0]):
        return [("Modified", head, c, x, y) for c, (x, y) in enumerate(zip(left[0], right[0])) if x != y]
    if not left or not right:
        kind = "Removed" if left else "Added"
        return [(kind, head + i, -1, ",".join(r) if left else None, None if left else ",".join(r)) for i, r in enumerate(left or right)]
    return [("Ambiguous", -1, -1, None, None)]


def _columns(base: list[list[str]], target: list[list[str]]) -> list[tuple[str, int, int, str | None, str | None]]:
    """One column added or removed in all rows, told by its place; else none."""
    wide, narrow, kind = (target, base, "ColumnAdded") if len(target[0]) > len(base[0]) else (base, target, "ColumnRemoved")
    if len(wide[0]) != len(narrow[0]) + 1:
        return []
    places = [c for c in range(len(wide[0])) if all(w[:c] + w[c + 1 :] == n for w, n in zip(wide, narrow))]
    return [(kind, -1, places[0], None, None)] if len(places) == 1 else []


def table_diff(pairs: DataFrame) -> DataFrame:
    """id, kind, row, col, base, target of ``pairs`` (id, base, target as delimited text)."""
    def run(batches: Iterable):
        import csv
        import io

        import pyarrow as pa

        names, types = ["id", "kind", "row", "col", "base", "target"], (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        for batch in batches:
            out = []
            for i, b, t in zip(*(c.to_pylist() for c in batch.columns)):
                mark = unique_delimiter(b or "")
                if not mark or unique_delimiter(t or "") != mark:
                    out.append((i, "UnsupportedDialect", -1, -1, None, None))
                    continue
                left, right = (list(csv.reader(io.StringIO(x), delimiter=mark)) for x in (b, t))
                out += [(i, *c) for c in compare_rows(left, right)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return pairs.select(F.col("id").cast("long"), "base", "target").mapInArrow(run, "id long, kind string, row int, col int, base string, target string")


def lifecycle(operations: DataFrame) -> DataFrame:
    """document, state, refused: operations (document, seq, operation) folded in order from WORKING."""
    folded = operations.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("seq", "operation"))).alias("ops"))
    start = F.struct(F.lit("WORKING").alias("state"), F.lit(0).cast("long").alias("refused"))

    def step(s, o):
        state = F.lit(None).cast("string")
        for (before, name), after in TRANSITIONS.items():
            state = F.when((s["state"] == before) & (o["operation"] == name), after).otherwise(state)
        return F.struct(F.coalesce(state, s["state"]).alias("state"), (s["refused"] + F.when(state.isNull(), 1).otherwise(0)).alias("refused"))

    return folded.select("document", F.aggregate("ops", start, step).alias("r")).select("document", "r.state", "r.refused")
