"""Token counts by the whole-token shortcut.

``whole_tokens`` proves on the driver, once per vocabulary, which strings encode
alone as exactly one token. A worker then cuts a text into pre-tokens, counts
those strings as one token each and runs the merges only for the rest. The
pre-tokenizer drops white space and no pattern of it spans white space, so a
text's tokens are the tokens of its white-space separated chunks one after the
other; chunks and pre-tokens already seen are looked up in bounded tables.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

# The split pattern of the word-level vocabulary file, as the file states it, and
# the same pattern for the standard library on text that SAFE admits.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = re.compile(r"[^\W\d_]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+")
#: Characters whose case, category and composition are the same in every Unicode version:
#: visible ASCII, Latin-1 letters, and the usual typographic marks.
SAFE = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ–—‘’“”…«»¿¡]*")
#: Separators that Python splits at but the vocabulary's pattern doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")

CHUNKS_KEPT = 600_000
PIECES_KEPT = 1_000_000
#: Pre-tokens of one call of the library.
AT_ONCE = 20_000


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def splits_at_space(path: str) -> bool:
    """Whether the file states the split pattern above, which drops white space."""
    with open(path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    return any(s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed"
               and s.get("pattern", {}).get("Regex") == SPLIT_PATTERN for s in steps)


def whole_tokens(path: str) -> dict[str, int]:
    """Vocabulary strings that are one pre-token and encode alone as one token, with its id.

    A candidate is what a vocabulary entry spells; it counts as proven only when the
    library itself returns exactly one id for it and the split leaves it whole.
    """
    tok = load_tokenizer(path)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    names = sorted(k for k in tok.get_vocab() if k not in special)
    plain = {c: b for b, c in _byte_alphabet().items()}
    words = set()
    for name in names:
        raw = name.removesuffix("</w>")
        try:
            word = bytes(plain[c] for c in raw).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if word and SAFE.fullmatch(word) and PIECES.findall(word.lower()) == [word]:
            words.add(word)
    words = sorted(words)
    found = tok.encode_batch(words, add_special_tokens=False)
    return {w: e.ids[0] for w, e in zip(words, found) if len(e.ids) == 1}


def _byte_alphabet() -> dict[int, str]:
    """The visible character that a byte-level vocabulary writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Pieces(dict):
    """pre-token -> what it costs, asked from the library for pre-tokens not yet seen."""

    def __init__(self, known: dict, ask):
        super().__init__(known)
        self.known, self.ask = known, ask

    def __missing__(self, piece):
        if len(self) >= PIECES_KEPT + len(self.known):
            self.clear()
            self.update(self.known)
        out = self[piece] = self.ask(piece)
        return out


class Chunks(dict):
    """chunk between white space -> what it costs, put together from its pre-tokens."""

    def __init__(self, pieces: Pieces, join, ask):
        super().__init__()
        self.pieces, self.join, self.ask = pieces, join, ask

    def __missing__(self, chunk):
        if len(self) >= CHUNKS_KEPT:
            self.clear()
        if SAFE.fullmatch(chunk) and "<|" not in chunk:
            out = self.join(map(self.pieces.__getitem__, PIECES.findall(chunk.lower())))
        else:
            out = self.ask(chunk)
        if len(chunk) <= 64:  # longer ones hardly come again; the result is the same either way
            self[chunk] = out
        return out


class TextCoder:
    """Counts or encodes whole texts, equal to one call of the library over each."""

    def __init__(self, path: str, whole: dict[str, int], count: bool):
        tok, self.simple = load_tokenizer(path), splits_at_space(path)
        self.dtype = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
        ids = lambda s: tok.encode(s, add_special_tokens=False).ids
        if count:
            self.ask, self.join = (lambda s: len(ids(s))), sum
            known = dict.fromkeys(whole, 1)
        else:
            self.ask, self.join = (lambda s: np.array(ids(s), dtype=self.dtype).tobytes()), b"".join
            known = {w: np.array([i], dtype=self.dtype).tobytes() for w, i in whole.items()}
        vocab = tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a pre-token
        self.last[[i for name, i in vocab.items() if name.endswith("</w>")]] = True
        self.tok, self.count = tok, count
        self.chunks = Chunks(Pieces(known, self.ask), self.join, self.ask)

    def meet(self, found: list[str]) -> None:
        """Learn all new pre-tokens of some chunks in few calls of the library, which cost less than one call each."""
        chunks, known = self.chunks, self.chunks.pieces
        found = [c for c in found if len(c) <= 64 and c not in chunks]
        if len(chunks) + len(found) > CHUNKS_KEPT:
            chunks.clear()
        words = {c: c.lower() for c in found if c.isascii() and c.isalpha()}  # one pre-token each
        others = {c: PIECES.findall(c.lower()) for c in found if c not in words and SAFE.fullmatch(c) and "<|" not in c}
        new = set(words.values()).union(*others.values())
        new.difference_update(known)
        if len(known) + len(new) > PIECES_KEPT + len(known.known):
            known.clear()
            known.update(known.known)
        names = list(new)
        for k in range(0, len(names), AT_ONCE):
            known.update(self._ask_all(names[k:k + AT_ONCE]))
        get = known.__getitem__
        chunks.update(zip(words, map(get, words.values())))
        chunks.update((chunk, self.join(map(get, pieces))) for chunk, pieces in others.items())

    def _ask_all(self, pieces: list[str]) -> dict:
        """What each of some pre-tokens costs, from one text of them all: an id with the word-end mark ends each."""
        ids = np.array(self.tok.encode(" ".join(pieces), add_special_tokens=False).ids, dtype=np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces) or (len(ids) and ends[-1] != len(ids)):
            return {p: self.ask(p) for p in pieces}
        starts = np.concatenate([[0], ends[:-1]])
        if self.count:
            return dict(zip(pieces, (ends - starts).tolist()))
        raw, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        return {p: raw[s * width:e * width] for p, s, e in zip(pieces, starts.tolist(), ends.tolist())}

    def _costs(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """What each different chunk of the texts costs, the chunks in order, and how many each text has.

        A text that can't be cut at white space is one chunk.
        """
        texts = pc.fill_null(texts, "")
        if self.simple and not pc.any(pc.match_substring_regex(texts, ODD_SPACE.pattern)).as_py():
            cut = pc.utf8_split_whitespace(texts)
        else:
            cut = pa.array([t.split() if self.simple and not ODD_SPACE.search(t) else [t] for t in texts.to_pylist()],
                           pa.list_(pa.string()))
        coded = cut.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        if self.simple:
            self.meet(names)
            costs = list(map(self.chunks.__getitem__, names))
        else:
            costs = list(map(self.ask, names))
        return costs, coded.indices.to_numpy(), pc.list_value_length(cut).to_numpy().astype(np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        costs, order, n = self._costs(texts)
        total = np.concatenate([[0], np.cumsum(np.array(costs, dtype=np.int64)[order])])
        ends = np.cumsum(n)
        return total[ends] - total[ends - n]

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``end_id`` behind each text's, and how many each text has with it."""
        costs, order, n = self._costs(texts)
        flat = np.frombuffer(b"".join(costs), self.dtype)
        size = np.array(list(map(len, costs)), dtype=np.int64) // self.dtype.itemsize
        start, each = (np.cumsum(size) - size)[order], size[order]
        upto = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(start - upto[:-1], each) + np.arange(upto[-1])]
        ends = upto[np.cumsum(n)]
        return np.insert(out, ends, end_id), np.diff(ends, prepend=0) + 1


_coders: dict = {}


def coder(path: str, whole: dict[str, int], count: bool) -> TextCoder:
    """One coder per worker process: its tables last over the worker's tasks."""
    key = (path, count)
    if key not in _coders:
        _coders[key] = TextCoder(path, whole, count)
    return _coders[key]


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048) -> DataFrame:
    """Tokens of every whole text by the vocabulary file ``tokenizer``.

    Returns one row per input row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens). Null texts count as empty (0 tokens);
    a null id stays null; repeated rows give repeated results; other columns are not
    read; an empty table gives an empty result. Special strings inside a text are handled as the
    library does by default. The work is one map over the rows, with no shuffle; what
    is broadcast is the list of proven strings, bounded by the vocabulary.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = spark.sparkContext.broadcast(whole_tokens(tokenizer) if splits_at_space(tokenizer) else {})
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    fields = ["n_bytes", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = coder(tokenizer, whole.value, True)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(count.counts(b.column(1)))],
                                             names=[id_col, *fields])

    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
