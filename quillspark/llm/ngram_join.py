"""N-gram Jaccard self-join by MinHash banding.

1. Every text becomes its set of word n-grams; equal sets are one *class of
   copies* from here on, found by a map-side combined aggregation.
2. MinHash bands, enough of them for the target recall, deal classes to buckets.
   A pair of classes is looked at in the first band they share, nowhere else.
   A first pass over signatures alone finds which classes have such a pair in a
   bucket, so n-gram sets are moved for those only.
3. In buckets of more than ``BLOCK`` classes, each class is first compared with
   one leader.  Jaccard distance is a metric: two classes within half the allowed
   distance of one leader are linked, without being compared.  So a dense group
   of near copies takes one comparison a class, and its links are counted.
4. All other pairs are verified on the full sets inside the tasks.  What is left
   of buckets of more than ``BLOCK`` classes is cut into blocks, and each pair of
   blocks is a unit of its own; the largest leader's classes meet only others.
   A unit gives back counts of links and a spanning forest of them, never the
   pairs, so output stays linear where a group is dense.
5. The forests' components are the join's classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.components import connected_components
from quillspark.llm.shingles import mix, shingle_set
from quillspark.llm.tokens import forget, handing_back
from quillspark.operators.skew import column_of, hot_cold_join, numbered, possible, renamed
from quillspark.scratch import discard, materialize, release

THRESHOLD, WIDTH, RECALL, MAX_HASHES = 0.8, 5, 0.9999, 128
BLOCK = 500
#: Rows taken out of a batch, and n-grams compared, at a time.
SLICE, COLUMNS = 256, 1 << 13


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands find a pair at ``threshold`` with probability ``recall``."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(2, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _hash_family(bands: int, rows: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, bands * rows, np.uint64), rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)


def band_hashes(shingles: np.ndarray, bands: int, rows: int, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One 64-bit hash a band; whole sets, however long, in slices."""
    flip, odd = family
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at : at + 2048, None] ^ flip) * odd).min(0))
    weights = np.arange(1, 2 * rows, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix((mix(least).reshape(bands, rows) * weights).sum(1, dtype=np.uint64))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _groups(batches: Iterable, keys: int) -> Iterator[list[list]]:
    """Columns of each run of rows that agree in the first ``keys`` columns."""
    held: list[list] | None = None
    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        columns = [c.to_pylist() for c in batch.columns]
        marks = list(zip(*columns[:keys]))
        cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
        for a, b in zip(cuts, cuts[1:]):
            part = [c[a:b] for c in columns]
            if held is not None and tuple(c[0] for c in held[:keys]) == marks[a]:
                for h, p in zip(held, part):
                    h += p
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held


def _first_shared(signatures: np.ndarray, band: int, leaders: list) -> np.ndarray:
    """Matrix: do two classes share no band before ``band``, and no leader?"""
    fresh = np.ones((len(signatures), len(signatures)), bool)
    for k in range(band):
        fresh &= signatures[:, k, None] != signatures[None, :, k]
    names = {name: i for i, name in enumerate(dict.fromkeys(leaders))}
    own = np.array([names[x] if x is not None else -1 - i for i, x in enumerate(leaders)])
    return fresh & (own[:, None] != own[None])


def _prune(batches: Iterable):
    """Of each bucket the classes that meet some other class here for the first time."""
    import pyarrow as pa

    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    for band, bucket, size, key, leader, bands in _groups(batches, 2):
        if len(key) < 2:
            continue
        fresh = _first_shared(np.array(bands, np.int64), band[0], leader)
        np.fill_diagonal(fresh, False)
        keep = np.flatnonzero(fresh.any(1)).tolist()
        if keep:
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], t) for c, t in zip((band, bucket, size, key), types)], ["band", "bucket", "size", "key"])


def _near_leader(threshold: float):
    """Rows come by bucket and salt, the leader first; the keys within half the allowed distance of it, and the leader."""
    def run(batches: Iterable):
        import pyarrow as pa

        now, leader, grams = None, None, None
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            out = []
            for *unit, member, key, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(data, np.uint64)
                if not member:
                    now, leader, grams = unit, key, own
                elif unit == now:
                    both = np.intersect1d(own, grams, assume_unique=True).size
                    # Both distances together then are no more than 1 - threshold.
                    if 2 * both >= (1 + threshold) * (len(own) + len(grams) - both) + 1e-6:
                        out.append((key, leader))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary()) for k in range(2)], ["key", "leader"])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes, by bit sets over the n-grams that two or more of ``sets`` have."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    sizes = np.array([len(s) for s in sets])
    grams, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at, minlength=len(grams)) > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(n), sizes)
    take = shared[at]
    at, owner = column[at[take]], owner[take]
    out = np.zeros((n, n), np.int32)
    for low in range(0, int(shared.sum()), COLUMNS):
        here = (at >= low) & (at < low + COLUMNS)
        width = min(COLUMNS, int(shared.sum()) - low)
        bits = np.zeros((n, -(-width // 64) * 64), np.uint8)
        bits[owner[here], at[here] - low] = 1
        words = np.packbits(bits, 1, bitorder="little").view(np.uint64)
        for i in range(n):
            out[i, i:] += np.bitwise_count(words[i] & words[i:]).sum(1, dtype=np.int32)
    out = np.triu(out) + np.triu(out, 1).T
    np.fill_diagonal(out, sizes)
    return out


def _verify(threshold: float):
    def run(batches: Iterable):
        import pyarrow as pa

        forget()
        out: list[list] = [[], [], []]
        for low, high, band, bucket, block, key, leader, bands, data in _groups(batches, 4):
            n = len(key)
            if n > 1:
                sets = [np.frombuffer(d, np.uint64) for d in data]
                both, size = intersections(sets), np.array([len(s) for s in sets])
                # Integers alone decide: both / union >= threshold, on whole sets.
                union = size[:, None] + size[None] - both
                linked = (both >= np.ceil(threshold * union - 1e-9)) & _first_shared(np.array(bands, np.int64), band[0], leader)
                np.fill_diagonal(linked, False)
                if low[0] != high[0]:
                    blocks = np.array(block)
                    linked &= blocks[:, None] != blocks[None]
                root = np.arange(n)
                for i in range(n):  # a spanning forest: each pass takes the least root around
                    js = np.flatnonzero(linked[i])
                    if len(js):
                        least = root[[i, *js]]
                        root[np.isin(root, least)] = least.min()
                for i, count in enumerate(linked.sum(1).tolist()):
                    if count:
                        for column, value in zip(out, (key[i], count, key[root[i]])):
                            column.append(value)
            if len(out[0]) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.binary()))], ["key", "links", "root"])
                out = [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.binary()))], ["key", "links", "root"])

    return run


def _sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterable):
        import pyarrow as pa

        forget()
        family = _hash_family(bands, rows)
        for batch in batches:
            keys, hashes = [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py() or "", width)
                keys.append(set_key(s) if len(s) else None)
                hashes.append(band_hashes(s, bands, rows, family).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "id", "key", "bands"])

    return docs.mapInArrow(handing_back(run), "doc_id long, id long, key binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(text.as_py() or "", width) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "grams"])

    return docs.mapInArrow(handing_back(run), "key binary, grams binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(key, grams) of the classes in ``wanted`` (key, id), a written table, from the text of one document each."""
    # Texts that cannot be wanted stay where they are.  Both sides grow with the corpus, so the others are always dealt by id, never met by a broadcast.
    texts = possible(docs, wanted, ["id"]).join(wanted.select("id").distinct().hint("merge"), "id", "left_semi").select("text")
    return _sets(texts, width).join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def _dense_units(dense: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks of large buckets (band, bucket, size, key, leader): the largest leader's classes meet the others, and these each other."""
    led = dense.where("leader is not null").groupBy("band", "bucket", "leader").agg(F.count(F.lit(1)).alias("n"))
    # A leader of less than a block is not worth blocks of its own.
    most = led.where(F.col("n") >= block).groupBy("band", "bucket").agg(F.max(F.struct("n", "leader")).alias("m")).select("band", "bucket", F.col("m.n").alias("n_main"), F.col("m.leader").alias("main"))
    # The largest buckets are few: a bucket has more than ``block`` classes.
    sizes = dense.groupBy("band", "bucket").agg(F.max("size").alias("size")).join(most, ["band", "bucket"], "left")
    sizes = materialize(sizes.select("band", "bucket", "main", F.coalesce("n_main", F.lit(0)).alias("n_main"), "size"), "dense")
    rows = hot_cold_join(dense.drop("size"), sizes, ["band", "bucket"], "size", F.col("key"))
    others, mains = F.ceil((F.col("size") - F.col("n_main")) / block).cast("int"), F.ceil(F.col("n_main") / block).cast("int")
    is_main = F.coalesce(F.col("leader") == F.col("main"), F.lit(False))
    # Blocks of the main leader have negative numbers.
    rows = rows.withColumn("block", F.when(is_main, -1 - F.pmod(F.xxhash64("key"), F.greatest(mains, F.lit(1)))).otherwise(F.pmod(F.xxhash64("key"), F.greatest(others, F.lit(1)))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    with_others = upto(others)
    with_mains = F.transform(upto(mains), lambda i: -1 - i)
    rows = rows.withColumn("other", F.explode(F.when(F.col("block") < 0, with_others).otherwise(F.concat(with_others, with_mains))))
    return rows.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "band", "bucket", "block", "key")


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL, max_hashes: int = MAX_HASHES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its class, and links at Jaccard ``threshold`` or more.

    Columns: doc_id, class_id (least id of all documents joined directly or
    through others), n_links (other n-gram sets that the document's set is
    linked with), n_copies (documents with the same set, itself included),
    row_id (doc_id, or a hash of the text where it is null) and stays_id (the
    row_id that stands for the class: class_id, or the least of null ids).
    Texts of fewer than ``width`` words are one n-gram of all words.  Null,
    empty and blank texts have no n-grams, link with nothing, and are classes of
    their own.  Rows with null ids take part; a class of such rows alone has a
    null class_id.  Repeated rows are copies.  Empty tables give empty results;
    other columns are ignored.
    """
    spark, (bands, rows) = docs.sparkSession, choose_bands(threshold, recall, max_hashes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"), "text")
    sketches = materialize(_sketch(docs, width, bands, rows), "sketches")
    copies = materialize(sketches.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("least"), F.min("id").alias("id"), F.first("bands").alias("bands")), "copies")
    release(spark)
    buckets = copies.select("key", F.posexplode("bands").alias("band", "bucket"))
    sizes = materialize(buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    release(spark)
    # Signatures follow only the few rows that share a bucket; most others are left out before they are dealt.
    met = hot_cold_join(possible(buckets, sizes, ["band", "bucket"]), sizes, ["band", "bucket"], "size", F.col("key")).where("size is not null").select("band", "bucket", "size", "key")
    met = materialize(met, "met")
    discard(sizes)
    release(spark)
    dense = met.where(F.col("size") > block)
    if dense.limit(1).count():
        # A class asks the leader of the first large bucket it is in; the leader goes to all tasks that have some of the bucket.
        salts = F.ceil(F.col("size") / block).cast("int")
        first = dense.groupBy("key").agg(F.min(F.struct("band", "bucket", "size")).alias("b")).select("b.*", "key")
        heads = dense.groupBy("band", "bucket", "size").agg(F.min("key").alias("key"))
        asked = first.select("band", "bucket", F.pmod(F.xxhash64("key"), salts).cast("int").alias("salt"), F.lit(1).alias("member"), "key")
        asked = asked.union(heads.select("band", "bucket", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("member"), "key"))
        wanted = materialize(dense.select("key").distinct().join(copies.select("key", "id"), "key"), "wanted")
        asked = asked.join(_sets_of(docs, wanted, width), "key").select("band", "bucket", "salt", "member", "key", "grams")
        asked = asked.repartition("band", "bucket", "salt").sortWithinPartitions("band", "bucket", "salt", "member")
        led = materialize(asked.mapInArrow(handing_back(_near_leader(threshold)), "key binary, leader binary"), "led")
        groups = led.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
        groups = materialize(groups, "leaders")
        sure = hot_cold_join(led, groups, ["leader"], "n", F.col("key")).select("key", (F.col("n") - 1).alias("links"), F.col("leader").alias("root"))
        plain, copies = copies, materialize(copies.join(led, "key", "left"), "copies")
        discard(plain, wanted)
    else:
        led, sure = None, None
        copies = copies.withColumn("leader", F.lit(None).cast("binary"))
    release(spark)
    signed = met.where(F.col("size") <= block).join(copies.select("key", "leader", "bands"), "key").select("band", "bucket", "size", "key", "leader", "bands")
    need = signed.repartition("band", "bucket").sortWithinPartitions("band", "bucket").mapInArrow(handing_back(_prune), "band int, bucket long, size long, key binary")
    need = need.select(F.lit(0).alias("low"), F.lit(0).alias("high"), "band", "bucket", F.lit(0).alias("block"), "key")
    if led is not None:
        need = need.union(_dense_units(dense.join(led, "key", "left"), block))
    need = materialize(need, "candidates")
    discard(met)
    release(spark)
    wanted = materialize(need.select("key").distinct().join(copies.select("key", "id"), "key"), "wanted")
    signatures = possible(copies.select("key", "leader", "bands"), wanted, ["key"])
    units = need.join(signatures, "key").join(_sets_of(docs, wanted, width), "key").select("low", "high", "band", "bucket", "block", "key", "leader", "bands", "grams")
    units = units.repartition("band", "bucket", "low", "high").sortWithinPartitions("low", "high", "band", "bucket")
    links = units.mapInArrow(handing_back(_verify(threshold)), "key binary, links long, root binary")
    links = materialize(links.union(sure) if sure is not None else links, "links")
    discard(need, wanted)
    release(spark)
    roots = connected_components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    classes = copies.select("key", "n_copies", "least", "id").join(counts, "key", "left").join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = materialize(classes, "rooted")
    least = materialize(classes.groupBy("root").agg(F.min("least").alias("class_id"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("size")), "components")
    rooted = classes
    classes = hot_cold_join(rooted, least, ["root"], "size", F.col("key"))
    classes = materialize(classes.select("key", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "class_id", F.coalesce("class_id", "least_id").alias("stays_id")), "classes")
    discard(links, rooted, least, *([copies] if led is not None else []))
    out = hot_cold_join(sketches.select("doc_id", "id", "key"), classes, ["key"], "n_copies", F.col("id"))
    alone = F.col("key").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), F.col("id").alias("row_id"), F.when(alone, F.col("id")).otherwise(F.col("stays_id")).alias("stays_id"))


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, with all their columns, that stand for their class; rows that share an id share its fate."""
    rows, names = numbered(docs)
    doc_id, text = column_of(names, "doc_id").cast("long"), column_of(names, "text")
    stay = ngram_join(rows.select(doc_id.alias("doc_id"), text.alias("text")), **options).where("row_id = stays_id").select(F.col("row_id").alias("row")).distinct()
    rows = rows.withColumn("row", F.coalesce(doc_id, F.xxhash64(text)))
    return rows.join(stay, "row", "left_semi").select(*renamed(names))
