"""Audit chains: digests, folding, verification, reconciliation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Domain tags; the first one's SHA-256 is the link before the first.
GENESIS = "kp-audit-chain-genesis-v1"
STEP = "kp-audit-chain-v1"
EXPIRED_SET = "kp-audit-expired-set-v1"


def uuid_bytes(value: Column) -> Column:
    """The 16 bytes of a UUID in hex, with or without hyphens."""
    return F.unhex(F.replace(value, F.lit("-"), F.lit("")))


def _eight_bytes(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def expired_set_digest(seqs: Column) -> Column:
    """Digest of an array of sequence numbers, in ascending order."""
    return F.sha2(F.aggregate(F.array_sort(seqs), F.lit(EXPIRED_SET).cast("binary"), lambda s, x: F.concat(s, _eight_bytes(x))), 256)


def envelope_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def chain_step(previous: Column, seq: Column, event: Column, digest: Column) -> Column:
    """Next link, hex, of a hex link, a sequence number, an event's UUID and its envelope's digest."""
    return F.sha2(F.concat(F.lit(STEP).cast("binary"), F.unhex(previous), _eight_bytes(seq), uuid_bytes(event), F.unhex(digest)), 256)


def build_chain(events: DataFrame, log: str = "log") -> DataFrame:
    """(log, seq, event, digest, chain) of events (log, seq, event, envelope): links in order of seq, event and digest.

    A link depends on the one before it, so a log is one unit of work; logs are
    what the chain is parallel over.  Rows of a log pass by in batches and only
    its last link is held, so a long log needs no more memory than a short one.
    A row with a null or an event that is no UUID has no link, nor has any after it.
    """
    digest = envelope_digest(F.col("envelope"))
    body = F.concat(_eight_bytes(F.col("seq")), uuid_bytes(F.col("event")), F.unhex(digest))
    rows = events.select(F.col(log), F.col("seq").cast("long").alias("seq"), "event", digest.alias("digest"), body.alias("body"))
    ordered = rows.repartition(log).sortWithinPartitions(log, "seq", "event", "digest")
    out = StructType([*rows.drop("body").schema.fields, StructField("chain", StringType())])
    return ordered.mapInArrow(_links, out)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the chain to rows (log, seq, event, digest, body) that come log by log, in order."""
    tag, start = STEP.encode(), hashlib.sha256(GENESIS.encode()).digest()
    at, last, begun = None, None, False
    for batch in batches:
        found = []
        for log, body in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
            if not begun or log != at:
                at, last, begun = log, start, True
            last = None if body is None or last is None else hashlib.sha256(tag + last + body).digest()
            found.append(None if last is None else last.hex())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.string())], names=[*batch.schema.names[:4], "chain"])


def verify_chain(rows: DataFrame, log: str = "log") -> DataFrame:
    """log, rows, first_bad of rows (log, seq, event, envelope, prev_chain, chain).

    Every row is checked against the row before it, in parallel: the sequence
    goes on by one, its link continues the previous link, and the link and
    digest recompute.  ``first_bad`` is the first offending seq, or null.
    """
    w = Window.partitionBy(log).orderBy("seq")
    before = F.lag("chain").over(w)
    again = chain_step(F.col("prev_chain"), F.col("seq"), F.col("event"), envelope_digest(F.col("envelope")))
    first = F.row_number().over(w) == 1
    linked = F.when(first, F.col("prev_chain") == F.sha2(F.lit(GENESIS), 256)).otherwise((F.col("prev_chain") == before) & (F.col("seq") == F.lag("seq").over(w) + 1))
    checked = rows.withColumn("ok", linked & (F.col("chain") == again))
    return checked.groupBy(log).agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(~F.col("ok"), F.col("seq"))).alias("first_bad"))


def reconcile(deliveries: DataFrame, receipts: DataFrame) -> DataFrame:
    """event, class of deliveries (event, state, digest) against receipts (event, digest), both directions."""
    d, r = deliveries.select("event", F.col("state"), F.col("digest").alias("d_digest")), receipts.select("event", F.col("digest").alias("r_digest"), F.lit(True).alias("received"))
    both = d.join(r, "event", "full_outer")
    got = F.coalesce("received", F.lit(False))
    known = F.when(F.col("state").isNull(), "store_only").when(got & (F.col("d_digest") != F.col("r_digest")), "digest_mismatch")
    known = known.when((F.col("state") == "delivered") & ~got, "delivered_missing").when((F.col("state") == "delivered"), "confirmed")
    return both.select("event", known.when((F.col("state") == "quarantined") & got, "quarantined_present").when(F.col("state") == "quarantined", "quarantined").when(got, "pending_present").otherwise("pending").alias("class"))
