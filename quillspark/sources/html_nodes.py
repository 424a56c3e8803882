"""Semantic nodes of HTML: projections for fingerprints, and their diff."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from quillspark.sources.readers import VOID, normalize

SKIPPED = frozenset(("script", "style", "noscript"))
Node = tuple[str, str, str, str, str]  # tag, own text, href, src, alt


class _Nodes(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list[str]] = []
        self.stack: list[tuple[str, int]] = []
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skipping += 1
            return
        if self.skipping:
            return
        names = dict(attrs)
        self.nodes.append([tag, "", *(names.get(k) or "" for k in ("href", "src", "alt"))])
        if tag not in VOID:
            self.stack.append((tag, len(self.nodes) - 1))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.stack and not self.skipping:
            node = self.nodes[self.stack[-1][1]]
            node[1] = " ".join((node[1] + " " + normalize(data)).split())


def semantic_nodes(html: str) -> list[Node]:
    parser = _Nodes()
    parser.feed(html)
    parser.close()
    return [tuple(n) for n in parser.nodes]


def fingerprint(nodes: list[Node]) -> str:
    return hashlib.sha256(json.dumps(nodes, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def compare_nodes(base: list[Node], target: list[Node]) -> list[tuple[str, int]]:
    """(kind, node): texts, links and images of equal tag sequences, else what is left between equal ends."""
    if [n[0] for n in base] == [n[0] for n in target]:
        kinds = (("Text", 1), ("Link", 2), ("Image", 3), ("ImageText", 4))
        return [(kind, i) for i, (b, t) in enumerate(zip(base, target)) for kind, k in kinds if b[k] != t[k]]
    head = 0
    while head < min(len(base), len(target)) and base[head] == target[head]:
        head += 1
    tail = 0
    while tail < min(len(base), len(target)) - head and base[-1 - tail] == target[-1 - tail]:
        tail += 1
    left, right = len(base) - head - tail, len(target) - head - tail
    if left == right == 1:
        return [("Modified", head)]
    if not left or not right:
        return [("Removed" if left else "Added", head + i) for i in range(left or right)]
    return [("Ambiguous", -1)]


def html_fingerprints(pages: DataFrame) -> DataFrame:
    """id, nodes, fingerprint of ``pages`` (id, html)."""
    def run(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            found = [semantic_nodes(h or "") for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int32()), pa.array(map(fingerprint, found), pa.string())], ["id", "nodes", "fingerprint"])

    return pages.select(F.col("id").cast("long"), "html").mapInArrow(run, "id long, nodes int, fingerprint string")


def html_diff(pairs: DataFrame) -> DataFrame:
    """id, kind, node of ``pairs`` (id, base, target)."""
    def run(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            out = [(i, *c) for i, b, t in zip(*(c.to_pylist() for c in batch.columns)) for c in compare_nodes(semantic_nodes(b or ""), semantic_nodes(t or ""))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32()))], ["id", "kind", "node"])

    return pairs.select(F.col("id").cast("long"), "base", "target").mapInArrow(run, "id long, kind string, node int")
