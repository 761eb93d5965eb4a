"""Language identification with spans for mixed text.

A word is a chunk between white space, cut where its script changes and, in scripts
without spaces, into short runs. A word's script leaves the languages that use it as candidates; character n-grams
score the word under each. Viterbi over a text's words, with a penalty for switching
the language, labels spans; the language with most letters is the text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

BUCKETS, ORDERS = 1 << 16, (1, 2, 3, 4)
#: Documents per language that a model learns from (a documented bound, see ``train``).
SAMPLE_DOCS = 1000
MOST_LANGUAGES = 1000
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.002
SWITCH, BARRED = 12.0, -40.0
CHUNKS_KEPT, WORDS_AT_ONCE = 200_000, 1_500_000
LETTERS = re.compile(r"[^\W\d_]+")

# First code points of script ranges (Unicode blocks), with the script's name.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"),
    (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_START = np.array([s for s, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])


#: Scripts written without spaces between words, and the letters of one run of them.
UNSPACED = frozenset(SCRIPTS.index(x) for x in ("Han", "Kana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
RUN_LETTERS = 4


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_START, points, side="right") - 1]


class Pieces(dict):
    """chunk between white space -> its words; marks and digits stay with the letter before."""

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        out = (chunk,)
        if not chunk.isascii() and max(chunk) >= "\u0370":
            cuts, last, n = [0], None, 0
            scripts = scripts_of(np.frombuffer(chunk.encode("utf-32-le"), "<u4").astype(np.int64)).tolist()
            for k, (letter, script) in enumerate(zip(chunk, scripts)):
                if letter.isalpha() and SCRIPTS[script] != "Other":
                    if last is not None and (script != last or (n == RUN_LETTERS and script in UNSPACED)):
                        cuts.append(k)
                        n = 0
                    last, n = script, n + 1
            out = tuple(chunk[a:b] for a, b in zip(cuts, [*cuts[1:], None]))
        if len(chunk) <= 64:
            if len(self) >= CHUNKS_KEPT:
                self.clear()
            self[chunk] = out
        return out

    def of(self, text: str) -> list[str]:
        return text.split() if text.isascii() else [p for c in text.split() for p in self[c]]

    def places(self, text: str) -> list[tuple[int, int]]:
        out = []
        for m in re.finditer(r"\S+", text):
            at = m.start()
            for p in self[m[0]]:
                out.append((at, at + len(p)))
                at += len(p)
        return out


def ngrams(chunks: list[str]):
    """Of chunks' words, lower-cased and set between spaces: (chunk, bucket) of every n-gram,
    the number of letters of each chunk, and (chunk, script) of every letter."""
    spaced = [f" {' '.join(LETTERS.findall(c))} ".lower() for c in chunks]
    points = np.frombuffer("".join(spaced).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(chunks)), [len(s) for s in spaced])
    letter = points != 32
    owners, buckets = [], []
    for n in ORDERS:
        if len(points) < n:
            break
        code = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            code = (code ^ points[k:len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        last = len(points) - n + 1
        inside = (owner[:last] == owner[n - 1:]) & (letter[:last] if n == 1 else letter[:last] | letter[n - 1:])
        owners.append(owner[:last][inside])
        buckets.append((code[inside] >> np.uint64(48)).astype(np.int64) % BUCKETS)
    none = np.empty(0, np.int64)
    return (np.concatenate(owners) if owners else none, np.concatenate(buckets) if buckets else none,
            np.bincount(owner[letter], minlength=len(chunks)), owner[letter],
            scripts_of(points[letter].astype(np.int64)))


@dataclass
class Model:
    """``langs``; log probability of each bucket per language; which languages use each script."""

    langs: list[str]
    logp: np.ndarray  # buckets x languages
    uses: np.ndarray  # scripts x languages


def chunk_scores(model: Model, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Score per language and number of letters of each chunk."""
    k = len(model.langs)
    owner, bucket, letters, at, script = ngrams(chunks)
    if not k:
        return np.zeros((len(chunks), 0)), letters
    sums = np.stack([np.bincount(owner, model.logp[bucket, c], len(chunks)) for c in range(k)], axis=1)
    n = np.bincount(owner, minlength=len(chunks))
    # the mean n-gram, for each letter: long words say more than short ones, but not four times over
    scores = sums / np.maximum(n, 1)[:, None] * letters[:, None]
    if not model.uses.all():
        share = np.zeros((len(chunks), len(SCRIPTS)))
        np.add.at(share, (at, script), 1)
        uses = np.where(model.uses.any(axis=1, keepdims=True), model.uses, True)  # a script nobody uses bars nobody
        scores += BARRED * (share @ (~uses).astype(float))
    return scores - scores.max(axis=1, keepdims=True), letters


class Chunks(dict):
    """chunk between white space -> its row in the growing tables of scores and letters."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        self.scores, self.letters = np.zeros((0, len(model.langs))), np.zeros(0, np.int64)

    def __missing__(self, chunk: str):
        self.new.append(chunk)
        out = self[chunk] = len(self)
        return out

    def settle(self):
        if self.new:
            scores, letters = chunk_scores(self.model, self.new)
            self.scores = np.concatenate([self.scores, scores])
            self.letters = np.concatenate([self.letters, letters])
            self.new = []

    def trim(self):
        if len(self) > CHUNKS_KEPT:
            self.clear()
            self.scores, self.letters = self.scores[:0], self.letters[:0]


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best path of languages for each run of rows, all runs side by side, step by step."""
    order = np.argsort(-sizes, kind="stable")
    starts, ordered = (np.cumsum(sizes) - sizes)[order], sizes[order]
    longest = int(ordered[0]) if len(ordered) else 0
    active = np.searchsorted(-ordered, -np.arange(longest), side="left")  # runs longer than t
    from_ = np.full(scores.shape, -1, np.int16)
    v = np.zeros((len(sizes), scores.shape[1]))
    for t in range(longest):
        a = active[t]
        at, now = starts[:a] + t, v[:a]
        best = now.argmax(axis=1)
        jump = now[np.arange(a), best][:, None] - switch
        moved = now < jump
        if t and moved.any():
            from_[at] = np.where(moved, best[:, None], -1)
        v[:a] = np.maximum(now, jump) + scores[at] if t else scores[at]
    path = np.zeros(len(scores), np.int16)
    state = np.zeros(len(sizes), np.int64)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        ends = slice(active[t + 1] if t + 1 < longest else 0, a)
        state[ends] = v[ends].argmax(axis=1)
        at = starts[:a] + t
        path[at] = state[:a]
        back = from_[at, state[:a]]
        state[:a] = np.where(back < 0, state[:a], back)
    return path


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          learn_from: Column | None = None, sample_docs: int = SAMPLE_DOCS, smoothing: float = 0.1) -> Model:
    """Learn from at most ``sample_docs`` ids of each language, chosen by a hash of the id.

    Spark counts n-gram buckets and letters per script over the whole texts of the sample; the
    model is one number per bucket and language. Rows without id, text or language
    are not learnt from; rows of one id and language count once, with the least of their texts. Only about half as many ids again as wanted are ranked, so a
    language with most of the rows costs no more than another.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.lit(True) if learn_from is None else learn_from)
    labelled = rows.where(usable & F.col("text").isNotNull()).select("doc_id", "lang").distinct()
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # the lowest hashes: a share of the ids that holds half as many again as wanted, ranked to the exact number
    share = F.coalesce(F.lit(None).cast("double"), *[F.when(
        F.col("lang") == r["lang"], F.lit(1.5 * sample_docs / r["n"])) for r in sizes])
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    chosen = labelled.withColumn("order", order).where(order < share * F.lit(float(1 << 31))).withColumn("rank", rank).where(
        F.col("rank") <= sample_docs)
    # ids of the sample only: sample_docs for each language, one text of each
    sample = rows.where(usable & F.col("text").isNotNull()).join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"]).groupBy(
        "lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")
    out = T.StructType([T.StructField("lang", T.StringType()), T.StructField("what", T.IntegerType()),
                        T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = tallies.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                _, bucket, _, _, script = ngrams([text])
                n += np.bincount(np.concatenate([bucket, BUCKETS + script]), minlength=len(n))
        for lang, n in tallies.items():
            has = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(has), pa.string()), pa.array(has.astype(np.int32)),
                                              pa.array(n[has])], names=out.names)

    found = sample.mapInArrow(count, out).groupBy("lang", "what").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(found["lang"]))
    n = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    n[found["what"].to_numpy(dtype=np.int64), [langs.index(x) for x in found["lang"]]] = found["n"]
    grams, letters = n[:BUCKETS], n[BUCKETS:]
    logp = np.log(grams + smoothing) - np.log(grams.sum(axis=0) + smoothing * BUCKETS)
    return Model(langs, logp, letters >= SCRIPT_SHARE * np.maximum(letters.sum(axis=0), 1))


def _spans(text: str, path: np.ndarray, lang: list[str], pieces: Pieces) -> list[dict]:
    """Runs of equal language as character spans, from the first to the last mark of the run."""
    cuts = np.flatnonzero(np.diff(path)) + 1
    if not len(cuts):
        return [{"start": len(text) - len(text.lstrip()), "end": len(text.rstrip()), "lang": lang[path[0]]}]
    places = pieces.places(text)
    first, last = [0, *cuts.tolist()], [*cuts.tolist(), len(path)]
    return [{"start": places[a][0], "end": places[b - 1][1], "lang": lang[path[a]]} for a, b in zip(first, last)]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("lang", T.StringType())]))


def label_languages(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text",
                    switch: float = SWITCH) -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``spans`` of every row's whole text.

    ``score`` is the share of the text's letters in spans of ``lang_pred`` (ties go to
    the first language by name); ``spans`` lists (start, end, lang) in characters. Null
    texts, texts without letters, and every text under a model without languages, get
    ``und``, score 0 and no span. Null ids stay null; repeated rows get equal results;
    an empty table gives an empty result; other columns are not read. One map over the
    rows; the broadcast model has ``BUCKETS`` numbers for each language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        langs, chunks, pieces = model.langs, Chunks(model), Pieces()
        held: list[tuple[pa.RecordBatch, list[str], list[np.ndarray]]] = []

        def flush():
            chunks.settle()
            words = [x for _, _, found in held for x in found]
            sizes = np.array([len(x) for x in words], dtype=np.int64)
            rows = np.concatenate(words) if words else np.empty(0, np.int64)
            letters = chunks.letters[rows]
            path = viterbi(chunks.scores[rows], sizes, switch) if langs else np.zeros(len(rows), np.int16)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            k = max(len(langs), 1)
            share = np.bincount(doc * k + path, letters, len(sizes) * k).reshape(-1, k)
            best, total = share.argmax(axis=1), share.sum(axis=1)
            known = (total > 0) & bool(langs)
            ends, d = np.cumsum(sizes), 0
            for b, texts, found in held:
                n = len(found)
                spans = [_spans(t, path[ends[d + i] - sizes[d + i]:ends[d + i]], langs, pieces) if known[d + i] else []
                         for i, t in enumerate(texts)]
                pred = [langs[best[x]] if known[x] else "und" for x in range(d, d + n)]
                score = [float(share[x, best[x]] / total[x]) if known[x] else 0.0 for x in range(d, d + n)]
                d += n
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                                  pa.array(spans, spans_type)], names=schema.names)
            held.clear()
            chunks.trim()

        n = 0
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [np.fromiter(map(chunks.__getitem__, s), dtype=np.int64, count=len(s)) for s in map(pieces.of, texts)]
            held.append((b, texts, found))
            n += sum(map(len, found))
            if n >= WORDS_AT_ONCE:
                yield from flush()
                n = 0
        if held:
            yield from flush()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
