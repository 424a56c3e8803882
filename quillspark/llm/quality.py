"""Quality rules by distribution divergence.

Each document gets two histograms: of character classes and of common words.
Both are compared with its language's reference by Jensen-Shannon distance.  The
reference is the mean histogram of that language's documents that pass the base
rules and are nearer than the mean to a first such mean.  A
document is rejected if a distance is over its limit; the limits widen for short
texts, whose histograms scatter, and below a minimum length there is no verdict.
The word limit is what as many words drawn from the reference itself would reach,
and lies below the distance of a text without common words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillspark.scratch import materialize

#: Common words of each language, and classes of characters.
COMMON_WORDS = {
    "en": "the of and to in is for that on with as are was it by an be this or from at not have has you".split(),
    "fr": "de la le et les des en un une du que est pour dans qui sur au pas par plus ne se".split(),
    "de": "der die das und in zu den mit von ist im für auf nicht ein eine als auch es sich des dem".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es lo".split(),
}
CLASSES = ["space", "lower", "upper", "digit", "symbol", "period", "comma", "shout", "other", "accented", "accented upper", "foreign"]
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MIN_DOCS = 30, 5
CLASS_LIMIT, CLASS_SLACK = 0.15, 1.8
#: Deviations over the expected word distance, and the most of the distance of a text without common words.
WORD_DEVIATIONS, WORD_SHARE = 3.0, 0.98


def _class_table() -> np.ndarray:
    """Class of each code point of the basic plane; the last entry stands for all above."""
    out = np.full(65536, CLASSES.index("foreign"), np.uint8)
    put = lambda chars, name: out.__setitem__([ord(c) for c in chars], CLASSES.index(name))
    put([chr(c) for c in range(128)], "other")
    put([chr(c) for c in range(0xC0, 0x250)], "accented")
    put([chr(c) for c in range(0xC0, 0x250) if chr(c).isupper()], "accented upper")
    put("abcdefghijklmnopqrstuvwxyz", "lower")
    put("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "upper")
    put("0123456789", "digit")
    put(SYMBOLS, "symbol")
    put(".;:", "period")
    put(",", "comma")
    put("!?", "shout")
    put(" \t\n\x0b\x0c\r", "space")
    return out


def _vocabulary(common: dict[str, list[str]]) -> tuple[list[str], dict[bytes, int]]:
    words = sorted({w for ws in common.values() for w in ws})
    return words, {(form + end).encode(): i for i, w in enumerate(words) for form in (w, w.capitalize()) for end in ("", ",", ".")}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words within windows of ``width`` words that occur twice or more, the first occurrence included."""
    grams = list(zip(*(words[i:] for i in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    seen, covered, end = Counter(grams), 0, 0
    for at, gram in enumerate(grams):
        if seen[gram] > 1:
            covered += at + width - max(end, at)
            end = at + width
    return covered


def document_features(docs: DataFrame, common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """doc_id, lang, the base counts, and the two histograms (the last common-word bin is all other words)."""
    words_of, forms = _vocabulary(common)
    n_bins = len(words_of) + 1

    def run(batches: Iterable):
        import pyarrow as pa

        table, symbol = _class_table(), CLASSES.index("symbol")
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("classes", pa.list_(pa.int32())), ("common", pa.list_(pa.int32()))])
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py() or ""
                data = text.encode()
                words = data.split()  # bytes split at 0x20 and 0x09 to 0x0D exactly
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                classes = np.bincount(table[np.minimum(codes, 65535)], minlength=len(CLASSES))
                lines = [x for x in data.split(b"\n") if x.strip()]
                found = Counter(map(forms.get, words))
                histogram = [0] * n_bins
                for i, n in found.items():
                    histogram[n_bins - 1 if i is None else i] += n
                out.append((doc_id, lang, len(words), len(codes) - int(classes[0]), int(classes[symbol]), len(lines) - len(set(lines)), repeated_words(words), classes[1:].tolist(), histogram))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long"), docs["lang"].cast("string"), docs["text"])
    counted = rows.mapInArrow(run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, common array<int>")
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def language_references(features: DataFrame, min_docs: int = MIN_DOCS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean class and common-word histogram of each language with ``min_docs`` documents that pass the base rules.

    Every partition sums its documents up, so a few rows a partition and language are left to add.
    """
    def partial(batches: Iterable):
        import pyarrow as pa

        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, classes, common in zip(*(c.to_pylist() for c in batch.columns)):
                one = [np.ones(1), *(np.array(x, float) / max(1, sum(x)) for x in (classes, common))]
                sums[lang] = [a + b for a, b in zip(sums[lang], one)] if lang in sums else one
        rows = [(lang, np.concatenate(x).tolist()) for lang, x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["lang", "sums"])

    clean = features.where(~F.col("base_failed") & F.col("lang").isNotNull()).select("lang", "classes", "common")
    added = clean.mapInArrow(partial, "lang string, sums array<double>").select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    means = added.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("s")).select("lang", F.col("s.s").alias("s")).where(F.col("s")[0] >= min_docs)
    out, n = {}, len(CLASSES) - 1
    for r in means.collect():  # one row a language
        s = np.array(r["s"])
        out[r["lang"]] = (s[1 : n + 1] / s[0], s[n + 1 :] / s[0])
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, row by row."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(d / 2, 0))


def word_limits(reference: np.ndarray, deviations: float = WORD_DEVIATIONS, share: float = WORD_SHARE, draws: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of text lengths, and the limit of the word distance at each.

    The distance of ``draws`` texts drawn from the reference, its mean and so many deviations.  Longer texts
    than the last length have its limit.
    """
    rng, lengths = np.random.default_rng(2), np.unique(np.geomspace(10, 30_000, 25).astype(int))
    none = js_distance(np.eye(len(reference))[-1], reference)
    drawn = [js_distance(rng.multinomial(n, reference / reference.sum(), draws) / n, reference[None]) for n in lengths]
    return np.log(lengths), np.array([min(d.mean() + deviations * d.std(), share * none) for d in drawn])


def _distances(pdf, references: dict[str, tuple[np.ndarray, np.ndarray]]):
    """Per row: language compared with, class distance, word distance, characters and words compared."""
    n = len(pdf)
    classes, words = (np.array(pdf[c].tolist(), float).reshape(n, -1) for c in ("classes", "common"))
    chars, count = classes.sum(1), words.sum(1)
    classes, words = classes / np.maximum(chars, 1)[:, None], words / np.maximum(count, 1)[:, None]
    lang, best = pdf["lang"].to_numpy(object), np.full(n, np.inf)
    known = np.array([x in references for x in lang], bool)
    reference, class_js, word_js = np.full(n, None, object), np.full(n, np.nan), np.full(n, np.nan)
    for name in sorted(references):
        take = np.flatnonzero((lang == name) | ~known)
        c, w = js_distance(classes[take], references[name][0][None]), js_distance(words[take], references[name][1][None])
        nearer = c + w < best[take]
        take, c, w = take[nearer], c[nearer], w[nearer]
        best[take], reference[take], class_js[take], word_js[take] = c + w, name, c, w
    return reference, class_js, word_js, chars, count


def trimmed_references(features: DataFrame, min_docs: int = MIN_DOCS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """References of the documents nearer than the mean to a first reference, so that junk does not shape them."""
    first = language_references(features, min_docs)

    def measure(frames: Iterable):
        for pdf in frames:
            _, pdf["class_js"], pdf["word_js"], _, _ = _distances(pdf, first)
            yield pdf

    clean = features.where(~F.col("base_failed") & F.col("lang").isin(*first)).select("lang", "base_failed", "classes", "common")
    measured = clean.mapInPandas(measure, "lang string, base_failed boolean, classes array<int>, common array<int>, class_js double, word_js double")
    means = {r["lang"]: (r["c"], r["w"]) for r in measured.groupBy("lang").agg(F.avg("class_js").alias("c"), F.avg("word_js").alias("w")).collect()}
    near = F.lit(False)
    for lang, (c, w) in means.items():
        near = near | ((F.col("lang") == lang) & (F.col("class_js") <= c) & (F.col("word_js") <= w))
    return first | language_references(measured.where(near), min_docs)


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, class_limit: float = CLASS_LIMIT, class_slack: float = CLASS_SLACK, word_deviations: float = WORD_DEVIATIONS, word_share: float = WORD_SHARE, common: dict[str, list[str]] = COMMON_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, lang, text): base counts, distances and verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, reference (language compared with), class_js,
    word_js, kept.  The class limit grows by its slack / sqrt(characters
    compared); for the word limit see ``word_limits``.  A document whose language is null or has no
    reference is compared with all, and the nearest counts; with no reference at
    all the distances are null and the base rules decide alone.  Null texts have
    no words and fail.  Repeated rows are judged alike; empty tables give empty
    results; other columns are ignored.
    """
    features = materialize(document_features(docs, common), "quality-features")
    references = trimmed_references(features)
    limits = {lang: word_limits(words, word_deviations, word_share) for lang, (_, words) in references.items()}

    def judge(frames: Iterable):
        for pdf in frames:
            reference, class_js, word_js, chars, count = _distances(pdf, references)
            word_limit = np.full(len(pdf), np.nan)
            for name, (at, limit) in limits.items():
                take = reference == name
                word_limit[take] = np.interp(np.log(np.maximum(count[take], 1)), at, limit)
            far = (class_js > class_limit + class_slack / np.sqrt(np.maximum(chars, 1))) | (word_js > word_limit)
            pdf = pdf.drop(columns=["lang", "classes", "common"])
            pdf["reference"], pdf["class_js"], pdf["word_js"] = reference, class_js, word_js
            pdf["kept"] = ~pdf["base_failed"].to_numpy(bool) & ~(far & (pdf["n_words"].to_numpy() >= min_words))
            yield pdf

    out = features.mapInPandas(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, reference string, class_js double, word_js double, kept boolean")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("class_js", "word_js")})
