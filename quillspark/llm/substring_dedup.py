"""Substring dedup: bytes covered by strings of fixed width that start earlier in the corpus.

The corpus order that tells which strings repeat is computed by prefix-free
parsing (``parsing``), in shards.  A string of ``width`` bytes belongs to the
shard of its minimizer, the least rolling hash of the grams inside it, so all
its occurrences meet; consecutive strings with one minimizer travel together as
one segment.

1. Later copies of a whole text are covered as a whole and go no further.
2. Occurrences of minimizers are counted.  A string whose minimizer occurs once
   cannot repeat: only segments of repeated minimizers go on.
3. Their bytes are cut out of the texts and dealt by minimizer; each shard
   orders its segments and marks the strings that start earlier elsewhere.
4. A minimizer of more segments than a task should hold is split: equal segments
   are merged by a combined aggregation, and the others are cut again by a
   deeper minimizer, the least hash of another order, until parts are small.
   Their parts are ordered like all others.  Strings that share their minimizers
   in all orders are all but equal, and combined aggregation finds the first of each.
5. Marks go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.exact_dedup import sha256_digest
from quillspark.llm.parsing import END, TRIGGER, eight, repeated
from quillspark.llm.shingles import _ODD, mix
from quillspark.operators.skew import hot_cold_join
from quillspark.scratch import discard, materialize, release

WIDTH, GRAM = 100, 24
#: Segments of one minimizer that a shard orders in memory, and bytes that it orders at a time.
HOT, TOGETHER = 200_000, 1_000_000
#: Orders of deeper minimizers.
LEVELS = 6
LAST = 2**63 - 1


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes (a multiple of 8) from each position."""
    x = eight(data)
    n = max(0, len(data) - gram + 1)
    out = x[:n] * _ODD[0]
    for k in range(8, gram, 8):
        out += x[k : k + n] * _ODD[k // 8]
    return mix(out)


def string_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (8 at least) from each position, from hashes of powers of two."""
    n = len(data) - width + 1
    spans = {8: eight(data)}
    while 2 * max(spans) <= width:
        k = max(spans)
        spans[2 * k] = spans[k][:-k] * _ODD[k % 7] + spans[k][k:]
    out, at = np.zeros(n, np.uint64), 0
    for k in sorted(spans, reverse=True):
        while width - at >= k:
            out = out * _ODD[3] + spans[k][at : at + n]
            at += k
    return mix(out * _ODD[5] + spans[8][width - 8 : width - 8 + n])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def segments(texts: list[bytes], width: int = WIDTH, gram: int = GRAM, level: int = 0):
    """(text number, start, strings, minimizer, times) of each run of strings with one minimizer.

    ``times`` is how often the minimizing gram occurs in the run: in periodic
    text strings of one run repeat.  Each ``level`` has an order of hashes of its
    own.  Texts are joined for speed.
    """
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hashes, grams = gram_hashes(data, gram), width - gram + 1
    if level:
        hashes = mix(hashes ^ _ODD[level % len(_ODD)] ^ np.uint64(level))
    least = _least(hashes, grams)
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    at = np.arange(len(least)) - begin[owner]
    inside = at <= lengths[owner] - width
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
    heads = np.flatnonzero(new & inside)
    # A run ends before the next head or where strings would leave the text.
    edge = np.minimum(np.append(heads[1:], len(least)), begin[owner[heads]] + lengths[owner[heads]] - width + 1)
    if not len(heads):
        return heads, heads, heads, least[:0], heads
    span = edge - heads + grams - 1
    first = np.cumsum(span) - span
    inner = np.arange(int(span.sum())) + np.repeat(heads - first, span)
    times = np.add.reduceat(hashes[inner] == np.repeat(least[heads], span), first)
    return owner[heads], at[heads], edge - heads, least[heads], times


def _emit_segments(width: int, gram: int):
    def run(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            uids = batch.column(1)
            data, some, size = [], [], 0
            for i, text in enumerate(batch.column(2)):
                data.append((text.as_py() or "").encode())
                some.append(i)
                size += len(data[-1])
                if size >= 1_000_000 or i == batch.num_rows - 1:
                    owner, start, count, least, times = segments(data, width, gram)
                    rows = pa.array(np.array(some)[owner])
                    yield pa.RecordBatch.from_arrays([uids.take(rows), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(least.view(np.int64)), pa.array(times, pa.int64())], ["uid", "start", "strings", "least", "times"])
                    data, some, size = [], [], 0

    return run


def _cut(width: int):
    def run(batches: Iterable):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
        names = ["doc_id", "uid", "start", "least", "within", "bytes"]
        for batch in batches:
            out, size = [], 0
            for r, (doc_id, uid) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = (batch.column(2)[r].as_py() or "").encode()
                parts = batch.column(3)[r].values
                for start, strings, least, times in zip(*(parts.field(k).to_pylist() for k in range(4))):
                    out.append((doc_id, uid, start, least, times > 1, text[start : start + strings + width - 1]))
                    size += strings + width
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _spans(keys: list, owner: np.ndarray, start: np.ndarray, width: int) -> list[tuple]:
    """(doc_id, uid, from, to) of runs of marked strings; one row a run."""
    heads = np.flatnonzero(np.append(True, (np.diff(start) != 1) | (np.diff(owner) != 0)))
    tails = np.append(heads[1:], len(start)) - 1
    return [(*keys[owner[h]], int(start[h]), int(start[t]) + width) for h, t in zip(heads.tolist(), tails.tolist())]


def mark_segments(keys: list[tuple], starts: list[int], data: list[bytes], width: int = WIDTH) -> list[tuple]:
    """Spans of strings that start earlier in another of these segments (or earlier in the same document).

    Strings whose hash is alone here cannot repeat and are left out before the
    order is computed; which of the others repeat, the order tells by content.
    """
    lengths = np.array([len(d) for d in data])
    hashes, at = [], 0
    while at < len(data):
        end = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), 1_000_000)))
        joined = string_hashes(np.frombuffer(b"".join(data[at:end]), np.uint8), width)
        begin = np.cumsum(lengths[at:end]) - lengths[at:end]
        hashes += [joined[b : b + n - width + 1] for b, n in zip(begin.tolist(), lengths[at:end].tolist())]
        at = end
    count = lengths - width + 1
    owner = np.repeat(np.arange(len(data)), count)
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    _, which, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    if not len(again):
        return []
    owner, inner = owner[again], inner[again]
    # Segments are trimmed to the strings that are left.
    used = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    low, high = inner[used], inner[np.append(used[1:], len(inner)) - 1] + width
    parts = [data[o][a:b] for o, a, b in zip(owner[used].tolist(), low.tolist(), high.tolist())]
    text = np.frombuffer((bytes([END]) * TRIGGER).join(parts) + bytes([END]) * TRIGGER, np.uint8)
    sizes = high - low
    begin = np.cumsum(sizes + TRIGGER) - sizes - TRIGGER
    part = np.cumsum(np.append(True, owner[1:] != owner[:-1])) - 1
    position = np.array(starts, np.int64)[owner] + inner
    doc = np.unique(np.array([LAST if k[0] is None else k[0] for k in keys], np.int64), return_inverse=True)[1]
    order = (doc[owner].astype(np.int64) << 32) | position
    marked = repeated(text, begin + sizes, begin[part] + inner - low[part], order, width)
    return _spans(keys, owner[marked], position[marked], width) if marked.any() else []


def _shard(width: int):
    """Rows come in order of minimizer, document and start.

    Equal segments of one minimizer are merged: the first stands for all, and
    the later ones are covered whole.  What is left alone in its group and has
    no repetition of its own cannot repeat; all else is ordered by parsing.
    """
    def run(batches: Iterable):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        held, size, out = [], 0, []
        group: dict[bytes, tuple] = {}
        minimizer = within = None

        def leave() -> int:
            if len(group) > 1 or within:
                held.extend(group.values())
                return sum(map(len, group))
            return 0

        def close() -> None:
            out.extend(mark_segments([r[:2] for r in held], [r[2] for r in held], [r[5] for r in held], width))
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[3] != minimizer:
                    size += leave()
                    group, minimizer, within = {}, row[3], False
                    if size >= TOGETHER:
                        close()
                        size = 0
                within = within or row[4]
                first = group.setdefault(row[5], row)
                if first is not row:
                    if (first[0], first[2]) != (row[0], row[2]):
                        out.append((row[0], row[1], row[2], row[2] + len(row[5])))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "uid", "from", "to"])
                out = []
        leave()
        if held:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "uid", "from", "to"])

    return run


def _deeper(width: int, gram: int, level: int):
    """Segments of one minimizer, cut again where the minimizer of the next order changes."""
    def run(batches: Iterable):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            doc_id, uid, start, least, _, data = (c.to_pylist() for c in batch.columns)
            owner, at, strings, deeper, times = segments(data, width, gram, level)
            keys = mix(np.array(least, np.int64).view(np.uint64)[owner] ^ mix(deeper)).view(np.int64)
            rows = [(doc_id[o], uid[o], start[o] + a, k, t > 1, data[o][a : a + n + width - 1], t) for o, a, n, k, t in zip(*(x.tolist() for x in (owner, at, strings, keys, times)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "uid", "start", "least", "within", "bytes", "times"])

    return run


def _strings(width: int):
    def run(batches: Iterable):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            for doc_id, uid, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(data) - width + 1
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(data[i : i + width]) for i in range(n)], pa.binary()), pa.array([doc_id] * n, pa.int64()), pa.array([uid] * n, pa.int64()), pa.array(range(start, start + n), pa.int32())], ["hash", "doc_id", "uid", "start"])

    return run


def _keep(batches: Iterable):
    import pyarrow as pa

    for batch in batches:
        out = []
        for doc_id, text, copy, spans in zip(*(c.to_pylist() for c in batch.columns)):
            data = (text or "").encode()
            spans = [{"from": 0, "to": len(data)}] if copy else spans or []
            kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
            for s in sorted(spans, key=lambda s: (s["from"], s["to"])):
                low, high = max(s["from"], at), s["to"]
                if high > at:
                    if s["from"] > at or not runs:
                        kept.update(data[at:low])
                        runs += 1
                    removed += high - low
                    at = high
            kept.update(data[at:])
            out.append((doc_id, len(data), removed, runs, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, uid, from, to of strings of ``docs`` (doc_id, uid, text) that start earlier; spans may overlap."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "uid", "text")
    found = materialize(docs.mapInArrow(_emit_segments(width, gram), "uid long, start int, strings int, least long, times long"), "found")
    counts = materialize(found.groupBy("least").agg(F.sum("times").alias("n")).where("n > 1"), "minimizers")
    release(spark)
    going = hot_cold_join(found, counts, ["least"], "n", F.struct("uid", "start")).where("n is not null")
    going = materialize(going.select("uid", F.struct("start", "strings", "least", "times").alias("s"), (F.col("n") > hot).alias("hot")), "segments")
    discard(found)
    release(spark)

    def cut(some: DataFrame) -> DataFrame:
        # A document's segments are a list no longer than the document.
        lists = some.groupBy("uid").agg(F.collect_list("s").alias("parts")).hint("merge")
        rows = docs.join(lists, "uid").select("doc_id", "uid", "text", "parts")
        return rows.mapInArrow(_cut(width), "doc_id long, uid long, start int, least long, within boolean, bytes binary")

    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.col("start").alias("s"))
    parts, spans = [cut(going.where("not hot"))], []
    if counts.where(F.col("n") > hot).limit(1).count():
        rows = materialize(cut(going.where("hot")), "hot-segments")
        # Of equal segments the first stands for all, and the later ones are covered whole.
        first = materialize(rows.groupBy("least", "bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hot-copies")
        rows = materialize(hot_cold_join(rows, first, ["least", "bytes"], "n", F.struct("uid", "start")).withColumn("late", F.coalesce(F.col("first") < place, F.lit(False))).drop("first", "n"), "hot-segments")
        spans.append(rows.where("late").select("doc_id", "uid", F.col("start").alias("from"), (F.col("start") + F.octet_length("bytes")).cast("int").alias("to")))
        rows = rows.where("not late").drop("late")
        release(spark)
        for level in range(1, LEVELS + 1):
            split = materialize(rows.mapInArrow(_deeper(width, gram, level), "doc_id long, uid long, start int, least long, within boolean, bytes binary, times long"), "deeper")
            counts = materialize(split.groupBy("least").agg(F.sum("times").alias("n")).where("n > 1"), "deeper-minimizers")
            kept = materialize(hot_cold_join(split, counts, ["least"], "n", F.struct("uid", "start")).where("n is not null"), "deeper-segments").drop("times")
            parts.append(kept.where(F.col("n") <= hot).drop("n"))
            rows = kept.where(F.col("n") > hot).drop("n")
            release(spark)
            if not counts.where(F.col("n") > hot).limit(1).count():
                break
        else:
            strings = materialize(rows.select("doc_id", "uid", "start", "bytes").mapInArrow(_strings(width), "hash binary, doc_id long, uid long, start int"), "strings")
            first = materialize(strings.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first-strings")
            late = hot_cold_join(strings, first, ["hash"], "n", F.struct("uid", "start")).where(F.col("first") < place)
            spans.append(late.select("doc_id", "uid", F.col("start").alias("from"), (F.col("start") + width).alias("to")))
    dealt = reduce(DataFrame.union, parts).repartition("least").sortWithinPartitions("least", F.coalesce("doc_id", F.lit(LAST)), "start")
    ordered = materialize(dealt.mapInArrow(_shard(width), "doc_id long, uid long, `from` int, `to` int"), "spans")
    discard(going)
    release(spark)
    return reduce(DataFrame.union, spans, ordered)


def substring_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what is left without bytes covered by earlier strings.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 of the bytes left.  A string is earlier with a smaller doc_id,
    or in the same document with a smaller start; null ids come last, and rows
    that share an id do not count as earlier than each other.  Null texts are
    empty; texts shorter than ``width`` lose nothing.  Empty tables give empty
    results; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"uid": F.xxhash64("doc_id", "text"), "digest": sha256_digest(F.coalesce("text", F.lit("")))})
    long_enough = F.octet_length(F.coalesce("text", F.lit(""))) >= width
    order = F.coalesce("doc_id", F.lit(LAST))
    groups = rows.where(long_enough).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups, "copies")
    marks = hot_cold_join(rows.select("doc_id", "uid", "digest"), groups, ["digest"], "n", F.col("uid"))
    marks = materialize(marks.where(F.col("first") < order).select("uid").distinct().withColumn("copy", F.lit(True)), "marks")
    discard(groups)
    release(spark)
    originals = rows.select("doc_id", "uid", "text").where(long_enough).join(marks, "uid", "left_anti")
    spans = repeated_spans(originals, width, gram, hot)
    # Overlapping spans of one document: no more than it has bytes.
    lists = materialize(spans.groupBy("uid").agg(F.collect_set(F.struct("from", "to")).alias("spans")), "document-spans")
    release(spark)
    out = rows.select("doc_id", "uid", "text").join(marks.join(lists, "uid", "full"), "uid", "left")
    return out.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans").mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
