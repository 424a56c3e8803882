"""Best-fit packing of documents into sequences of equal size.

1. Each document is encoded once; documents longer than a sequence are cut.
2. The number of pieces of each length (at most ``size`` numbers, whatever the
   corpus) goes to islands that start from random best-fit packings, tasks that each evolve a population by the grouping
   genetic algorithm; their elites move on to the next island between epochs.
3. The best genome's bins become intervals of ranks: the r-th piece of a length
   takes the place that the r-th use of this length has.  Ranks are counted in
   groups of bounded size, so a length that many pieces share is no hot key.
"""

from __future__ import annotations

import json
import logging
import random
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from quillspark.llm import grouping_ga as ga
from quillspark.llm.tokens import encoder, handing_back
from quillspark.scratch import materialize

_log = logging.getLogger(__name__)
SIZE, ISLANDS, EPOCHS, GENERATIONS, MEMBERS = 2048, 4, 5, 16, 6


def encode_pieces(docs: DataFrame, tokenizer: str, kind: str, size: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; null text is empty."""
    def pieces(batches: Iterable):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        encode_all, end = encoder(tokenizer, kind).encode_all, array("I", [end_id]).tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"])
    return rows.mapInArrow(handing_back(pieces), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _dump(genome: ga.Genome) -> str:
    return json.dumps([[list(p), c] for p, c in genome.items()])


def _load(text: str) -> ga.Genome:
    return {tuple(p): c for p, c in json.loads(text)}


def evolve_islands(spark, counts: dict[int, int], size: int, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, members: int = MEMBERS, seed: int = 7) -> tuple[ga.Genome, list[int]]:
    """The best genome of all islands, and the bins of its island's best one after each epoch.

    Every epoch is one task an island.  It gives back the island's population
    and, for the next island on the ring, its elite.  Islands start from random
    best-fit packings.  Seeds follow from island and epoch, so a task that is
    run again gives the same.
    """
    def epoch(number: int):
        def run(pdf):
            import pandas as pd

            island = int(pdf["island"].iloc[0])
            rng = random.Random(seed * 1_000_003 + number * 1009 + island)
            own = [_load(g) for g in sorted(g for g in pdf["genome"] if g)]
            population = ga.evolve(own, counts, size, generations, members, rng)
            before = max(pdf["history"].loc[pdf["own"]], default="")
            history = f"{before} {sum(population[0].values())}".strip()
            rows = [(island, True, _dump(g), *ga.fitness(g, size), history) for g in population]
            rows.append(((island + 1) % islands, False, *rows[0][2:]))
            return pd.DataFrame(rows, columns=["island", "own", "genome", "bins", "filled", "history"])

        return run

    schema = "island int, own boolean, genome string, bins long, filled double, history string"
    state = spark.range(islands).selectExpr("cast(id as int) as island", "true as own", "cast(null as string) as genome", "0L as bins", "0D as filled", "'' as history")
    for number in range(epochs):
        # Dealt to so many tasks, as the few rows would else be put into one.
        state = state.repartition(islands, "island").groupBy("island").applyInPandas(epoch(number), schema)
    best = state.orderBy(F.col("bins").desc(), F.col("filled").desc(), "genome").select("genome", "history").first()
    return _load(best["genome"]), [int(n) for n in best["history"].split()]


def _places(genome: ga.Genome) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of every place."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, copies in sorted(genome.items(), reverse=True):
        offset = 0
        for n in pattern:
            out.append((n, used[n], used[n] + copies, sequence, offset))
            used[n] += copies
            offset += n
        sequence += copies
    return out


def pack(pieces: DataFrame, size: int = SIZE, order: tuple[str, ...] = ("doc_id", "piece"), spread: tuple[str, ...] = (), **islands) -> DataFrame:
    """``pieces`` (a written table with ``length``, 1 to ``size``) with ``sequence_id`` and ``offset``.

    Every sequence is gapless from offset 0.  Pieces of one length are dealt in
    ``order`` within groups; ties and repeated rows each get a place of their
    own.  Groups are told by ``order`` and ``spread``, so that pieces of one length with null or repeated ids
    are not one group.  An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    genome, history = evolve_islands(spark, counts, size, **islands)
    _log.info("bins after each epoch: %s; lower bound %d", history, ga.lower_bound(counts, size))
    places = _places(genome)
    # Groups hold about this many pieces: some for each shuffle partition.
    even = max(256, sum(counts.values()) // (8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = spark.createDataFrame([(n, -(-c // even)) for n, c in counts.items()], "length long, pk_salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("pk_salt", F.pmod(F.xxhash64(*order, *spread), F.col("pk_salts"))).drop("pk_salts")
    ranked = salted.withColumn("pk_in", F.row_number().over(Window.partitionBy("length", "pk_salt").orderBy(*order)))
    # At most one row for each length and salt: size + 8 x partitions.
    sizes = salted.groupBy("length", "pk_salt").agg(F.count(F.lit(1)).alias("pk_n"))
    before = sizes.select("length", "pk_salt", (F.sum("pk_n").over(Window.partitionBy("length").orderBy("pk_salt")) - F.col("pk_n")).alias("pk_before"))
    ranked = ranked.join(F.broadcast(before), ["length", "pk_salt"]).withColumn("pk_rank", F.col("pk_before") + F.col("pk_in") - 1)
    # A genome has a few places for each length, so this table is bounded too.
    slots = spark.createDataFrame(places, "pk_length long, pk_from long, pk_to long, pk_sequence long, pk_offset long")
    fits = (F.col("length") == F.col("pk_length")) & (F.col("pk_rank") >= F.col("pk_from")) & (F.col("pk_rank") < F.col("pk_to"))
    placed = ranked.join(F.broadcast(slots), fits)
    return placed.select(*pieces.columns, (F.col("pk_sequence") + F.col("pk_rank") - F.col("pk_from")).alias("sequence_id"), F.col("pk_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, kind: str = "word", size: int = SIZE, **islands) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text): see :func:`encode_pieces` and :func:`pack`.

    Null and empty texts are one piece of the end id.  Null ids are kept.  Rows
    repeated with one id are packed each.  Columns other than doc_id and text are ignored.
    """
    return pack(materialize(encode_pieces(docs, tokenizer, kind, size), "pieces"), size, spread=("ids_crc32",), **islands)
