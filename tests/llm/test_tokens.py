import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import grouping_ga as ga
from quillspark.llm.packing import pack_documents
from quillspark.llm.sstable import Reader, key_of, token_table, unpack_ids
from quillspark.llm.tokens import Encoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def ids_of(path, text):
    tokenizer = Tokenizer.from_file(path)
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path, kind", [(WORD, "word"), (BYTE, "byte")])
def test_pieces_are_the_library(path, kind):
    rng = random.Random(2)
    alphabet = "aB é\n\t'sdre09.,!?-½²ßİ漢😀\x85\xa0  <|endoftext|> ŉǅ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)] + ["", "it's WE'RE", "<|endoftext|>", "<|endoftext|> hello", "a<|startoftext|>b", "<|ENDOFTEXT|>", "x" * 3000]
    tokenizer = Tokenizer.from_file(path)
    assert list(Encoder(path, kind).encode_all(texts)) == [array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]


def test_packing_round_trip(make_docs, corpus):
    corpus = [(i if i is not None else -k, t) for k, (i, t) in enumerate(corpus)]
    rows = pack_documents(make_docs(corpus), WORD, size=256, islands=2, epochs=2, generations=4).collect()
    want = Counter()
    for i, t in corpus:
        ids = ids_of(WORD, t) + [0]
        for p, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[i, p, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    counts = Counter(r.length for r in rows)
    assert len(sequences) <= 1.02 * ga.lower_bound(counts, 256) + 1


def test_packing_empty_and_null(make_docs):
    assert pack_documents(make_docs([]), WORD).count() == 0
    rows = pack_documents(make_docs([(1, None), (2, ""), (None, None)]), WORD, islands=2, epochs=1).collect()
    assert len(rows) == 3 and {r.sequence_id for r in rows} == {0} and {r.offset for r in rows} == {0, 1, 2}


def check_genome(genome, counts, size):
    used = Counter()
    for pattern, copies in genome.items():
        assert sum(pattern) <= size and copies > 0
        for n in pattern:
            used[n] += copies
    assert used == Counter(counts)


@pytest.mark.parametrize("copies", [1, 1000])
def test_genetic_algorithm_improves_what_it_starts_from(copies):
    rng = random.Random(1)
    counts = Counter()
    for _ in range(150):  # triples that fill a bin exactly
        a, b = rng.randrange(260, 380), rng.randrange(260, 380)
        for n in (a, b, 1000 - a - b):
            counts[n] += copies
    population, history = [], []
    for _ in range(4):
        population = ga.evolve(population, counts, 1000, 40 if population else 0, 6, random.Random(3))
        history.append(sum(population[0].values()))
    check_genome(population[0], counts, 1000)
    assert history[0] > history[1] >= history[2] >= history[3] >= ga.lower_bound(counts, 1000) >= 150 * copies
    assert history[3] <= 1.06 * 150 * copies < history[0]


def test_islands_reach_the_bound_of_real_lengths(spark, small):
    from quillspark.llm.packing import evolve_islands

    rng = random.Random(2)
    counts = Counter(min(2048, 1 + int(rng.expovariate(1 / 700))) for _ in range(3000))
    genome, history = evolve_islands(spark, counts, 2048)
    check_genome(genome, counts, 2048)
    least = ga.lower_bound(counts, 2048)
    assert sum(genome.values()) == history[-1] <= 1.002 * least and history == sorted(history, reverse=True)


def test_crossover_keeps_every_document():
    rng = random.Random(5)
    counts = Counter(rng.randrange(1, 101) for _ in range(500))
    genomes = []
    for _ in range(2):
        g: ga.Genome = {}
        ga.fill(Counter(counts), 100, rng, g)
        genomes.append(g)
    child = ga.crossover(*genomes, counts, 100, rng)
    check_genome(child, counts, 100)
    check_genome(ga.mutate(child, 100, rng), counts, 100)
    check_genome(ga.random_best_fit(counts, 100, rng), counts, 100)


def test_token_table_round_trip(spark, make_docs, corpus):
    import pyarrow.fs as pafs

    back, shards = token_table(make_docs(corpus), BYTE)
    rows = back.collect()
    want = sorted(((-1 if i is None else 1, i or 0, t or "") for i, t in corpus))
    start = 0
    got = [(r.doc_id, r.start, list(array("I", bytes(r.ids)))) for r in sorted(rows, key=lambda r: r.start)]
    assert len(got) == len(want)
    for (kind, i, t), (doc, at, ids) in zip(want, got):
        assert doc == (None if kind < 0 else i) and at == start and ids == ids_of(BYTE, t) + [0]
        start += len(ids)
    found = 0
    for shard in shards:
        fs, path = pafs.FileSystem.from_uri(shard["path"])
        with fs.open_input_file(path) as file:
            reader = Reader(file)
            assert reader.get(key_of(10**12)) is None
            value = reader.get(key_of(20))
            if value is not None:
                found += list(array("I", unpack_ids(value))) == ids_of(BYTE, dict(corpus)[20]) + [0]
    assert found == 1


def test_token_table_empty(make_docs):
    back, shards = token_table(make_docs([]), BYTE)
    assert back.count() == 0 and shards == []
