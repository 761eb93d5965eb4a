"""Quality rules: repetition and symbol counts, and bands of n-gram perplexity per language.

The language model is a modified Kneser-Ney model of order 4 over UTF-16 units, with words joined
by one space. Four units fill one 64-bit number, so a gram is its own exact key, and its context
and its lower orders are shifts and masks of it. Spark counts, over the whole corpus, in how many texts each
gram stands (once per text, so no text teaches its own repetitions), and derives the probabilities of
all grams by joins. A gram's own text is taken out of its count before it is scored.

For scoring, the grams that hold at least one part in 2^20 of all counts, at most 2^20, travel to every task
as sorted arrays of hashes; each other gram is in few texts, and is looked up by a join on its
key. Costs are whole numbers, so sums don't depend on their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_by_key, small_batches, stored

ORDER = 4
#: Cost of a gram: bits times this, as a whole number.
COST_UNIT = 1 << 16
#: A gram with at least one part in so many of all counts is broadcast.
HEAVY = 1 << 20
#: Units that are worked on at once, and grams that a task holds before it passes them on.
CHUNK, HELD = 1 << 18, 1 << 22
#: How far beyond the quartiles, in quartile distances (LEAST_SPREAD bits at least), a band reaches.
REACH, LEAST_SPREAD = 3.0, 0.2
BINS = 1000

# White space, symbols and limits of the base rules.
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

_SPACE = np.zeros(1 << 16, bool)
_SPACE[[ord(c) for c in BLANKS]] = True
_SYMBOL = np.zeros(1 << 16, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LOW = np.zeros(1 << 16, bool)
_LOW[0xDC00:0xE000] = True
_RANDOM = np.random.default_rng(20240317)
_CODES = _RANDOM.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_RANDOM.integers(0, 1 << 62)) * 4 + 3
_BACK = pow(_STEP, -1, 1 << 64)
_WINDOW_CODES = _RANDOM.integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def language_seed(lang: str | None) -> np.uint64:
    return np.uint64(0 if lang is None else int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_FORTH, _BACKWARD = _powers(_STEP, CHUNK), _powers(_BACK, CHUNK)


def word_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of prefix sums, moved to the same power."""
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    total = np.uint64(0)
    for k in range(0, len(units), CHUNK):
        part = units[k:k + CHUNK]
        forth, back = (np.uint64(pow(b, k, 1 << 64)) for b in (_STEP, _BACK))
        sums = np.cumsum(_CODES[part] * (_FORTH[:len(part)] * forth)) + total
        before = np.concatenate([[total], sums[:-1]])
        s = slice(*np.searchsorted(starts, [k, k + CHUNK]))
        at_start[s] = before[starts[s] - k]
        e = slice(*np.searchsorted(ends, [k, k + CHUNK]))
        at_end[e] = before[ends[e] - k]  # an end is the place behind a word; a space stands there
        total = sums[-1]
        del forth, back
    out = at_end - at_start
    for k in range(0, len(units), CHUNK):
        s = slice(*np.searchsorted(starts, [k, k + CHUNK]))
        out[s] *= _BACKWARD[starts[s] - k] * np.uint64(pow(_BACK, k, 1 << 64))
    return mixed(out)


class Texts:
    """Some texts as one array of UTF-16 units: three spaces before each, one behind."""

    def __init__(self, texts: list[str]):
        raw = [b" \0 \0 \0" + t.encode("utf-16-le") + b" \0" for t in texts]
        self.texts = texts
        self.units = np.frombuffer(b"".join(raw), "<u2")
        self.offsets = np.concatenate([[0], np.cumsum([len(r) // 2 for r in raw])]).astype(np.int64)
        self.space = _SPACE[self.units]
        edge = self.space[1:] != self.space[:-1]
        turns = np.flatnonzero(edge) + 1
        self.starts, self.ends = turns[::2], turns[1::2]  # the first and the last unit are spaces
        self.word_text = np.searchsorted(self.offsets, self.starts, side="right") - 1

    def _per_text(self, mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, self.offsets[:-1], dtype=np.int64)

    def base(self) -> dict[str, np.ndarray]:
        """The columns of the base rules."""
        n_words = np.bincount(self.word_text, minlength=len(self.texts)).astype(np.int64)
        return {"n_words": n_words, "word_chars": self._per_text(~(self.space | _LOW[self.units])),
                "n_symbols": self._per_text(_SYMBOL[self.units]), "n_dup_lines": np.array([dup_lines(t) for t in self.texts], np.int64),
                "n_repeat_words": self._repeat_words()}

    def _repeat_words(self) -> np.ndarray:
        n = len(self.starts) - WINDOW + 1
        if n < 2:
            return np.zeros(len(self.texts), np.int64)
        words = word_hashes(self.units, self.starts, self.ends)
        windows = sum(words[k:n + k] * _WINDOW_CODES[k] for k in range(WINDOW))
        inside = np.flatnonzero(self.word_text[:n] == self.word_text[WINDOW - 1:])
        keys = mixed(windows[inside]) ^ mixed(self.word_text[inside].astype(np.uint64))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        found = np.zeros(len(keys), bool)
        found[order[1:][same]] = found[order[:-1][same]] = True
        edges = np.zeros(len(words) + 1, np.int32)
        at = inside[found]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + WINDOW, -1)
        covered = np.cumsum(edges[:-1]) > 0
        return np.bincount(self.word_text[covered], minlength=len(self.texts)).astype(np.int64)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """All grams of the texts in order, and where each text's begin (and the last end)."""
        behind = self.space.copy()
        behind[1:] &= ~self.space[:-1]
        behind[0] = False
        keep = ~self.space | behind
        for k in range(ORDER - 1):
            keep[self.offsets[:-1] + k] = True
        before = np.concatenate([[0], np.cumsum(keep)])[self.offsets]
        seq = np.where(self.space[keep], 32, self.units[keep]).astype(np.uint64)
        out = np.zeros(len(seq), np.uint64)
        for k in range(ORDER):
            out[ORDER - 1:] |= seq[k:len(seq) - ORDER + 1 + k] << np.uint64(16 * (ORDER - 1 - k))
        own = np.ones(len(seq), bool)
        for k in range(ORDER - 1):
            own[before[:-1] + k] = False
        return out[own], before - np.arange(len(before)) * (ORDER - 1)


def dup_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def portions(texts: list[str | None], most: int = 4 * CHUNK) -> Iterator[tuple[slice, Texts]]:
    """Consecutive texts with about ``most`` characters; null counts as empty."""
    at = total = 0
    texts = [t or "" for t in texts]
    for k, t in enumerate(texts):
        if k > at and total + len(t) > most:
            yield slice(at, k), Texts(texts[at:k])
            at, total = k, 0
        total += len(t)
    if at < len(texts):
        yield slice(at, len(texts)), Texts(texts[at:])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``g`` and ``n``, the number of texts that hold the gram, of all rows (``lang``, ``text``)."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("g", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: dict[str | None, list[np.ndarray]] = {}
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        waiting = 0

        def settle():
            for lang, parts in fresh.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in held:
                    both = np.concatenate([held[lang][0], g])
                    counts = np.concatenate([held[lang][1], n])
                    order = np.argsort(both, kind="stable")
                    both, counts = both[order], counts[order]
                    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                    g, n = both[first], np.add.reduceat(counts, first)
                held[lang] = g, n
            fresh.clear()

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (g, n) in held.items():
                for k in range(0, len(g), CHUNK):
                    part = g[k:k + CHUNK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), _signed(part), pa.array(n[k:k + CHUNK].astype(np.int64))], names=schema.names)
            held.clear()

        for b in batches:
            langs = b.column(0).to_pylist()
            for own, texts in portions(b.column(1).to_pylist()):
                grams, at = texts.grams()
                for lang, s, e in zip(langs[own], at[:-1], at[1:]):
                    if e > s:
                        g = np.unique(grams[s:e])
                        fresh.setdefault(lang, []).append(g)
                        waiting += len(g)
                if waiting > HELD:
                    settle()
                    waiting = 0
                    if sum(len(g) for g, _ in held.values()) > HELD:
                        yield from told()
        settle()
        yield from told()

    return docs.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "g").agg(F.sum("n").alias("n"))


def _mask(k: int) -> int:
    return (1 << 16 * k) - 1


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What modified Kneser-Ney takes from counts of 1, 2 and more, by the counts of counts."""
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).first()
    n = {k: row[f"n{k}"] for k in range(1, 5)}
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return tuple(float(min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k / 2, 0.1), k - 0.1)) for k in (1, 2, 3))


def gram_costs(counts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``lang``, ``g``, ``n`` and ``cost`` (whole COST_UNITs of bits) of grams by modified Kneser-Ney.

    ``counts``: ``gram_counts`` of the corpus. ``wanted``: the same of other texts to score; without it the
    corpus is scored itself, and every gram's count is less by one for the text that holds it.
    ``n`` is the count among the texts to score. Unseen grams and contexts leave their probability to
    the lower order, unseen units to a uniform share. Discounts are shared by the languages.
    """
    own = wanted is None
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the different units before a gram
        tables[k] = stored(tables[k + 1].groupBy("lang", F.col("g").bitwiseAND(_mask(k)).alias("g")).agg(
            F.count(F.lit(1)).alias("n")), f"grams-{k}")
    need = {ORDER: counts if own else wanted}
    for k in range(ORDER - 1, 0, -1):
        need[k] = tables[k] if own else need[k + 1].select("lang", F.col("g").bitwiseAND(_mask(k)).alias("g")).distinct()
    lower = None
    for k in range(1, ORDER + 1):
        cut = discounts(tables[k])
        n = F.col("seen")
        less = F.when(n <= 0, 0.0).when(n == 1, cut[0]).when(n == 2, cut[1]).otherwise(cut[2])
        context = (lambda g: F.lit(0).cast("long")) if k == 1 else (lambda g: F.shiftrightunsigned(g, 16))
        own_n = F.col("n")
        contexts = tables[k].groupBy(F.col("lang").alias("of"), context(F.col("g")).alias("h")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"),
            (F.count_if(own_n == 1) * cut[0] + F.count_if(own_n == 2) * cut[1] + F.count_if(own_n > 2) * cut[2]).alias("freed"))
        seen = (lambda c: c - 1) if own and k == ORDER else (lambda c: c)
        asked = need[k].select("lang", "g", F.col("n").alias("weight") if k == ORDER else F.lit(1).alias("weight"),
                               *([seen(F.col("n")).alias("seen")] if own else []))
        if not own:
            mine = tables[k].select(F.col("lang").alias("of"), F.col("g").alias("key"), F.col("n").alias("seen"))
            asked = asked.join(mine, F.col("lang").eqNullSafe(F.col("of")) & (F.col("g") == F.col("key")), "left").select(
                "lang", "g", "weight", F.coalesce("seen", F.lit(0)).alias("seen"))
        asked = asked.join(contexts, F.col("lang").eqNullSafe(F.col("of")) & (context(F.col("g")) == F.col("h")), "left").drop("of", "h")
        if lower is None:
            below = F.lit(1.0) / (F.coalesce("kinds", F.lit(0)) + 1)
        else:
            asked = asked.join(lower, F.col("lang").eqNullSafe(F.col("of")) & (F.col("g").bitwiseAND(_mask(k - 1)) == F.col("key"))).drop("of", "key")
            below = F.col("p_lower")
        p = F.when(F.col("total").isNull(), below).otherwise(
            (F.greatest(n - less, F.lit(0.0)) + F.col("freed") * below) / F.col("total"))
        asked = asked.select("lang", "g", F.col("weight").alias("n"), p.alias("p"))
        lower = asked.select(F.col("lang").alias("of"), F.col("g").alias("key"), F.col("p").alias("p_lower"))
    return asked.select("lang", "g", "n", F.round(-F.log2("p") * COST_UNIT).cast("long").alias("cost"))


@dataclass
class HashArrays:
    """Sorted 64-bit hashes with a cost each; the leading bits of a hash tell where to look."""

    keys: np.ndarray
    costs: np.ndarray

    def __post_init__(self):
        self.bits = max(1, len(self.keys).bit_length())
        cells = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(self.keys, cells)
        self.padded = np.concatenate([self.keys, [np.uint64(0xFFFFFFFFFFFFFFFF)]])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        at = self.first[h >> np.uint64(64 - self.bits)]
        todo = np.flatnonzero(self.padded[at] < h)
        while len(todo):
            at[todo] += 1
            todo = todo[self.padded[at[todo]] < h[todo]]
        return np.where((at < len(self.keys)) & (self.padded[at] == h), at, -1)


def _heavy_arrays(costs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and costs of at most ``HEAVY`` grams."""
    found = costs.toArrow()
    keys = found["g"].to_numpy().view(np.uint64)
    langs = found["lang"].combine_chunks().dictionary_encode()
    seeds = np.array([*map(language_seed, langs.dictionary.to_pylist()), language_seed(None)], np.uint64)
    keys = mixed(keys ^ seeds[langs.indices.fill_null(len(seeds) - 1).to_numpy(zero_copy_only=False).astype(np.int64)])
    order = np.argsort(keys)
    return keys[order], found["cost"].to_numpy()[order].astype(np.int64)


def _scored(docs: DataFrame, id_type: T.DataType, heavy) -> DataFrame:
    """Base columns of every row, the cost of its heavy grams, and its other grams with their numbers."""
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "units", "cost")
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("lang", T.StringType()),
                           *(T.StructField(c, T.LongType()) for c in numbers),
                           T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = HashArrays(*heavy.value)
        for b in batches:
            langs, at_row = b.column(1).to_pylist(), 0
            for own, texts in portions(b.column(2).to_pylist()):
                base, (grams, at) = texts.base(), texts.grams()
                n = len(texts.texts)
                cost, rare, times = np.zeros(n, np.int64), [], []
                seeds = np.repeat(np.array([language_seed(x) for x in langs[own]], np.uint64), np.diff(at))
                place = np.empty(len(grams), np.int64)
                for k in range(0, len(grams), CHUNK):
                    part = slice(k, k + CHUNK)
                    place[part] = arrays.find(mixed(grams[part] ^ seeds[part]))
                each = np.where(place >= 0, arrays.costs[place] if len(arrays.costs) else 0, 0)
                total = np.concatenate([[0], np.cumsum(each)])
                cost = total[at[1:]] - total[at[:-1]]
                missing = np.flatnonzero(place < 0)
                cuts = np.searchsorted(missing, at)
                for s, e in zip(cuts[:-1], cuts[1:]):
                    g, t = np.unique(grams[missing[s:e]], return_counts=True)
                    rare.append(g.view(np.int64))
                    times.append(t)
                ends = np.concatenate([[0], np.cumsum([len(g) for g in rare])]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(np.int64))) for x in (rare, times)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at_row, n), pa.array(langs[own], pa.string()), *(pa.array(base[c]) for c in numbers[:5]),
                     pa.array(np.diff(at)), pa.array(cost), *lists], names=schema.names)
                at_row += n

    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)


def perplexities(docs: DataFrame, costs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, the base columns and ``bits``, the mean cost of a unit (log2 of the perplexity).

    ``docs``: ``doc_id``, ``lang``, ``text``; ``costs``: a stored table by ``gram_costs`` that holds all their grams.
    """
    spark = docs.sparkSession
    total = costs.agg(F.sum("n")).first()[0] or 0
    heavy = spark.sparkContext.broadcast(_heavy_arrays(costs.where(F.col("n") * HEAVY >= total)))
    small_batches(spark)
    rows = stored(_scored(docs, docs.schema["doc_id"].dataType, heavy).withColumn("row", F.monotonically_increasing_id()), "quality-rows")
    rare = rows.where(F.size("grams") > 0).select(
        "row", F.col("lang").alias("of"), F.explode(F.arrays_zip("grams", "times")).alias("x")).select(
        "row", "of", F.col("x.grams").alias("key"), F.col("x.times").alias("times"))
    light = costs.where(F.col("n") * HEAVY < total).select("lang", "g", F.col("cost").alias("each"))
    more = rare.join(light, F.col("lang").eqNullSafe(F.col("of")) & (F.col("g") == F.col("key"))).groupBy("row").agg(
        F.sum(F.col("times") * F.col("each")).alias("more"))
    whole = F.col("cost") + F.coalesce("more", F.lit(0))
    return rows.drop("grams", "times").join(more, "row", "left").withColumn(
        "bits", F.try_divide(whole, F.col("units") * COST_UNIT)).drop("row", "cost", "more", "units")


def perplexity_bands(rows: DataFrame, fit: Column, reach: float = REACH) -> DataFrame:
    """Per language: ``low`` and ``high`` bits, ``reach`` quartile distances beyond the quartiles of the rows that are ``fit``.

    Quartiles come from counts per language and thousandth of a bit, so no language's rows are gathered.
    ``rows`` says how many rows the language has. A language without fit rows has null bands.
    """
    one = rows.groupBy("lang", F.when(fit, F.floor(F.col("bits") * BINS)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("lang", F.col("bin").isNull()).orderBy("bin")
    all_of = Window.partitionBy("lang", F.col("bin").isNull())
    ranked = one.withColumn("up_to", F.sum("n").over(so_far)).withColumn("of", F.sum("n").over(all_of))
    quartile = lambda q: F.min(F.when(F.col("up_to") >= F.col("of") * q, F.col("bin")))
    q1, q3 = quartile(0.25) / BINS, (quartile(0.75) + 1) / BINS
    spread = F.greatest(q3 - q1, F.lit(LEAST_SPREAD)) * reach
    return ranked.groupBy("lang").agg((q1 - spread).alias("low"), (q3 + spread).alias("high"), F.sum("n").alias("rows"))


def judge_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    reach: float = REACH, corpus: DataFrame | None = None) -> DataFrame:
    """Base rules and perplexity bands of every whole text.

    One row per input row: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``bits`` (log2 of the perplexity per unit; null without words), ``low`` and ``high``
    (its language's band) and ``kept`` (neither failed nor outside the band). Without ``corpus`` the documents themselves
    are the corpus, and no text counts for its own grams.

    Null texts count as empty; a text without words fails the base rules; null languages are one
    language; null ids stay null; repeated rows are texts of their own; an empty table gives an empty result;
    other columns are not read. Words and windows are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def named(df):
        return df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    docs = named(docs)
    counts = stored(gram_counts(docs), "gram-counts")
    costs = gram_costs(counts) if corpus is None else gram_costs(stored(gram_counts(named(corpus)), "gram-counts"), counts)
    rows = stored(perplexities(docs, stored(costs, "gram-costs")).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))), "quality-bits")
    bands = stored(perplexity_bands(rows, ~F.col("base_failed"), reach), "quality-bands")
    return join_by_key(rows, bands, "lang", "rows").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False)))
