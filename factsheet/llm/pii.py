"""Personal data: fixed patterns, and contextual extraction bootstrapped from them.

The fixed patterns find the seed entities. Words around the seeds become lexical
patterns, from exact words down to the class of a word with the instance's shape; Spark
scores the graph of patterns and identifier-like instances that they surround, round by
round: a pattern is trusted for a kind when most of the instances in it that are known
at all are of that kind, and an instance becomes known when trusted patterns hold it,
until no round finds another. Every place of a newly known instance is then a span.

Secrets are a kind beside the fixed ones. Long keys (``KEY``) are their seeds, but only
count as found in a labelled context that the graph trusts.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect
from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored, with_row

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
# The patterns of the contract. Possessive runs and the look-behind keep them
# linear on long runs and match the same places: what follows a run is never part of it.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Identifier-like: a chunk between white space, without outer marks, that has enough letters or digits and a
#: digit or an inner mark; neighbouring chunks of digits; and addresses that are spelled out.
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
OUTER = "\"'`.,;:!?()[]{}<>|*"
LEAST_CHARS = 5
#: Longer instances, words and shapes stand in the graph by their digest.
KEY_CHARS = 64
#: Seeds of secrets: long keys of letters and digits.
KEY = re.compile(r"(?=[a-z]*[0-9])(?=[0-9]*[a-z])[0-9a-z]{32,}={0,2}")
LETTERS = re.compile(r"[^\W\d_]+")
MARKED = re.compile(r"[^\W_][@._+~=#%&/\\()\[\]{}<>|]+[^\W_]")
LIKE = re.compile(rf"[0-9]|{MARKED.pattern}")
#: Short groups of digits: so many chunks at most, with so many digits in all.
GROUP = re.compile(r"[(+#]*[0-9][0-9().+/-]*")
MOST_GROUPS, LEAST_DIGITS, MOST_DIGITS = 6, 7, 19
#: Words for the marks of a spelled-out address.
AT, DOT = frozenset("at arroba arobase".split()), frozenset("dot punkt point punto ponto".split())
SPELLED = re.compile(rf"\b(?:{'|'.join(sorted(AT))})\b", re.I)
#: Known non-identifiers by their shape: dates, times, amounts and addresses of the web.
PLAIN = re.compile(
    r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?:t[0-9:.z+-]*)?|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{4}|[0-9]{2})|[0-9]{1,2}(?::[0-9]{2}){1,2}"
    r"|[$€£¥][0-9.,]+|[0-9][0-9.,]*[$€£¥%]|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|(?:(?:https?|ftp)://|www\.).*", re.S)
UNKNOWN, NEVER = -1, -2
#: A pattern is trusted from this share of its known instances on, and from so many different ones.
TRUST, SUPPORT = 0.8, 3
#: The votes of a seed: more than any discovery has.
CERTAIN = 1 << 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def address(quad: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in quad.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each "@": the local part is the run before it, so long runs cost one look."""
    out, used, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            used = m.end()
            out.append((start, used))
        else:
            used = max(used, at + 1)
        at = text.find("@", max(at + 1, used))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping in each kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if address(m[0]):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _key(text: str) -> str:
    return text if len(text) <= KEY_CHARS else "#" + md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _word(chunk: str) -> str:
    return _key(DIGIT.sub("0", chunk.strip(OUTER).lower()))


def shape(instance: str) -> str:
    """Runs of letters become "a" and digits "0"; marks and spaces stay."""
    return _key(DIGIT.sub("0", LETTERS.sub("a", instance)))


def refuted(instance: str) -> bool:
    """Matched by a fixed pattern and dropped by its rule, so no identifier by its shape."""
    if IP.fullmatch(instance):
        return not address(instance)
    if CARD.fullmatch(instance):
        digits = instance.replace(" ", "").replace("-", "")
        return 12 <= len(digits) <= 19 and not luhn(digits)
    return False


class Chunks:
    """The runs between white space of one text, by number: two integers a chunk."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, array("q"), array("q")
        for m in CHUNK.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, c: int) -> str:
        return self.text[self.starts[c]:self.ends[c]]

    def like(self) -> Iterator[int]:
        return (c for c in range(len(self)) if LIKE.search(self.text, self.starts[c], self.ends[c]))

    def groups(self) -> Iterator[tuple[int, int]]:
        """First and last chunk of every run of two or more groups of digits that has a fitting number of digits.

        A mark of the sentence ends a run; within a longer run all shorter ones count, as any may be the identifier.
        """
        counts: list[int] = []  # digits of the open run's groups
        before = -2
        for c in self.like():
            own = self[c]
            inner = own.rstrip(OUTER.replace(")", ""))
            if c != before + 1:
                counts = []
            before = c
            if not GROUP.fullmatch(inner.lstrip(OUTER.replace("(", ""))):
                counts = []
                continue
            if inner.lstrip(OUTER.replace("(", "")) != inner.lstrip():
                counts = []
            counts = [*counts[1 - MOST_GROUPS:], sum("0" <= x <= "9" for x in inner)]
            total = counts[-1]
            for k in range(1, len(counts)):
                total += counts[-1 - k]
                if total > MOST_DIGITS:
                    break
                if total >= LEAST_DIGITS:
                    yield c - k, c
            if inner != own:
                counts = []

    def spelled(self) -> Iterator[tuple[int, int]]:
        """First and last chunk of every address like "john dot smith at example dot com"."""
        bare = lambda c: self[c].strip(OUTER).lower()
        for c in range(1, len(self) - 3):
            if bare(c) not in AT or bare(c + 2) not in DOT:
                continue
            first, last = c - 1, c + 3
            while first >= 2 and bare(first - 1) in DOT:
                first -= 2
            while last + 2 < len(self) and bare(last + 1) in DOT:
                last += 2
            if all(bare(x) for x in range(first, last + 1)):
                yield first, last

    def side(self, c: int) -> str:
        """The class of a neighbour: the text's edge, letters, digits inside, or only marks."""
        if not 0 <= c < len(self):
            return "^" if c < 0 else "$"
        own = self[c]
        return "0" if DIGIT.search(own) else "a" if LETTERS.search(own) else "."

    def around(self, first: int, last: int, instance: str) -> tuple[list[str], list[str]]:
        """The patterns of a place by words alone, and those with the shape of the instance.

        Its two words before; one word on either side; the only word before or none, from the text's
        start; the word before at the text's end; a label before ("phone:"). With the shape: the word
        before, and the class of either neighbour. Keys have no pattern by shape, which
        is all that makes them seeds, and only labelled ones.
        """
        key = bool(KEY.fullmatch(instance))
        label = first > 0 and self.text[self.ends[first - 1] - 1] in ":=#"
        if key and not label:
            return [], []
        before = [_word(self[c]) for c in range(max(0, first - 2), first)]
        after = [_word(self[c]) for c in range(last + 1, min(last + 2, len(self)))]
        found = []
        if len(before) == 2 and all(before):
            found.append(f"{before[0]} {before[1]} _")
        if before and before[-1]:
            if after and after[0]:
                found.append(f"{before[-1]} _ {after[0]}")
            if len(before) == 1:
                found.append(f"^ {before[0]} _")
            if not after:
                found.append(f"{before[-1]} _ $")
            if label:
                found.append(f"{before[-1]}: _")
        if not before and after and after[0]:
            found.append(f"^ _ {after[0]}")
        if key:
            return found, []
        own = shape(instance)
        shaped = [f"{self.side(first - 1)} _ | {own}", f"_ {self.side(last + 1)} | {own}"]
        if before and before[-1]:
            shaped.append(f"{before[-1]} _ | {own}")
        return found, shaped


def instances(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind, instance, patterns) of seeds and of identifier-like runs of chunks beside them.

    The kind of a run is ``SECRET`` for long keys, ``NEVER`` where its shape shows that it is no identifier, or ``UNKNOWN``.
    A refuted run counts against the patterns of its shape under a name of its own, but words alone may still
    reveal it (a mistyped number).
    """
    spelled = bool(SPELLED.search(text))
    if not base and not spelled and not LIKE.search(text):
        return
    seeds = sorted((s, e, k) for s, k, e in base)
    reach, furthest = array("q"), 0  # the furthest end of the seeds up to each
    chunks = Chunks(text)
    c = 0
    for s, e, k in seeds:
        furthest = max(furthest, e)
        reach.append(furthest)
        while c < len(chunks) and chunks.ends[c] <= s:
            c += 1
        last = c
        while last + 1 < len(chunks) and chunks.starts[last + 1] < e:
            last += 1
        own = text[s:e].lower()
        words, shaped = chunks.around(c, last, own)
        yield s, e, k, _key(own), words + shaped
    for first, last in chain(((c, c) for c in chunks.like()), chunks.groups(), chunks.spelled() if spelled else ()):
        left, right = chunks[first], chunks[last]
        marks = OUTER if first == last or left[0] != "(" or ")" not in left else OUTER.replace("(", "")
        s = chunks.starts[first] + len(left) - len(left.lstrip(marks))
        e = chunks.ends[last] - (len(right) - len(right.rstrip(OUTER)))
        own = text[s:e]
        if e - s < LEAST_CHARS or sum(map(str.isalnum, own)) < LEAST_CHARS:
            continue
        if first == last and not LIKE.search(own):
            continue
        at = bisect(seeds, (e,))  # seeds that start before the run's end
        if at and reach[at - 1] > s:
            continue
        own = SPACES.sub(" ", own.lower())
        kind = NEVER if PLAIN.fullmatch(own) else SECRET if KEY.fullmatch(own) else UNKNOWN
        words, shaped = chunks.around(first, last, own)
        if refuted(own):
            yield s, e, NEVER, "!" + _key(own), shaped
            shaped = []
        yield s, e, kind, _key(own), words + shaped


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()),
                                 T.StructField("end", T.IntegerType())]))
PLACE = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.IntegerType()),
         T.StructField("instance", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))]
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
#: So many places leave a task at once, however many a text has.
BATCH = 4096


def scan_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text (``doc_id``, ``_row``, ``base``: its spans) and one for each of its places
    (``_row``, ``start``, ``end``, ``kind``, ``instance``, ``patterns``; no base)."""
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("_row", T.LongType()),
                           T.StructField("base", SPAN), *PLACE])
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]

    def places(b: pa.RecordBatch, base: list[list]) -> Iterator[tuple]:
        for row, text, own in zip(b.column(1).to_pylist(), b.column(2), base):
            for place in instances(text.as_py() or "", own):
                yield row, *place

    def batch(rows: list[tuple], of_id: pa.DataType) -> pa.RecordBatch:
        row, *rest = (pa.array(x, t) for x, t in zip(zip(*rows), types))
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), of_id), row, pa.nulls(len(rows), SPANS), *rest], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = [base_spans(text.as_py() or "") for text in b.column(2)]
            spans = pa.array([[dict(zip(("start", "kind", "end"), x)) for x in own] for own in base], SPANS)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), spans, *(pa.nulls(b.num_rows, t) for t in types[1:])],
                                             names=schema.names)
            rows = []
            for place in places(b, base):
                rows.append(place)
                if len(rows) == BATCH:
                    yield batch(rows, b.column(0).type)
                    rows = []
            if rows:
                yield batch(rows, b.column(0).type)

    rows = with_row(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", "_row", "text").mapInArrow(run, schema)


def discover(scanned: DataFrame, *, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """``instance``, ``kind`` and ``votes`` of identifiers that trusted patterns reveal.

    Edges (pattern, instance) are distinct, so copies of a passage give no weight. In
    each round a pattern's kind is the commonest kind of its known instances; it is trusted
    if at least ``support`` instances and the share ``trust`` of the known ones, those
    known to be no identifiers among them, are of it; unknown ones count neither way.
    Unknown instances in trusted patterns become known for the next round; the kind with most
    trusted patterns (``votes``) wins, the first kind of a tie. A known instance keeps its
    kind, so the known set only grows; the rounds end when one adds nothing. Seeds are
    returned too, as a fixed pattern may have dropped them at another place; those of
    secrets only if a pattern trusted for secrets holds them.
    """
    places = scanned.where(F.col("instance").isNotNull()).select("instance", "kind", F.explode("patterns").alias("pattern"))
    edges = stored(places.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pii-edges")
    known = edges.where(F.col("kind") != UNKNOWN).groupBy("instance").agg(
        F.coalesce(F.min(F.when(F.col("kind") >= 0, F.col("kind"))), F.lit(NEVER)).alias("known"))
    kinds = [f"k{k}" for k in range(len(ALL_KINDS))]
    most = F.greatest(*kinds)
    kind = F.coalesce(*(F.when(F.col(f"k{k}") == most, k) for k in range(len(ALL_KINDS))))
    found = None
    while True:
        all_known = known if found is None else known.unionByName(found.select("instance", F.col("kind").alias("known")))
        counts = edges.select("pattern", "instance").join(all_known, "instance").groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("known") == k, 1)).alias(f"k{k}") for k in range(len(ALL_KINDS))))
        trusted = counts.where((most >= support) & (most >= F.col("n") * trust)).select("pattern", kind.alias("of"))
        votes = edges.where(F.col("kind") == UNKNOWN).join(trusted, "pattern").groupBy("instance").agg(
            *(F.count(F.when(F.col("of") == k, 1)).alias(f"k{k}") for k in range(len(ALL_KINDS))))
        new = stored(votes.join(all_known.select("instance"), "instance", "left_anti").select(
            "instance", kind.alias("kind"), most.alias("votes")), "pii-known")
        more = new.limit(1).count()
        found = new if found is None else found.unionByName(new) if more else found
        if not more:
            secrets = edges.where(F.col("kind") == SECRET).join(trusted.where(F.col("of") == SECRET), "pattern")
            seeds = known.where(F.col("known").between(0, SECRET - 1)).select("instance", F.col("known").alias("kind"), F.lit(CERTAIN).alias("votes"))
            return found.unionByName(seeds).unionByName(
                secrets.groupBy("instance").agg(F.lit(SECRET).alias("kind"), F.count(F.lit(1)).alias("votes")))


def _clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of added spans that overlap, the one with most trusted patterns stays, then the longest, then the first."""
    for b in batches:
        out = []
        for spans, votes in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            starts, kept = [], []
            for _, _, s, e, x in sorted((-v, x["start"] - x["end"], x["start"], x["end"], k) for k, (x, v) in enumerate(zip(spans, votes))):
                at = bisect(starts, s)
                if (not at or kept[at - 1]["end"] <= s) and (at == len(starts) or starts[at] >= e):
                    starts.insert(at, s)
                    kept.insert(at, spans[x])
            out.append(kept)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, SPANS)], names=["_row", "added"])


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **scoring) -> DataFrame:
    """Spans of personal data in every whole text, in code points, end exclusive.

    One row per input row: ``doc_id``, ``base`` (spans of the fixed patterns: start,
    kind, end), ``added`` (spans of discovered identifiers and of secrets in trusted contexts,
    which overlap no base span) and ``_row``; ``kind`` counts through ``ALL_KINDS``.

    Null and empty texts have no spans; null ids stay null; repeated rows get equal
    results and count once in the graph; an empty table gives an empty result; other
    columns are not read. Texts without digit and mark inside a chunk leave no places, so the graph
    is small against the text; it grows with the input and stays distributed. Places are rows of
    their own, so a very long text full of them costs its task no more than its chunks' positions.
    """
    scanned = stored(scan_documents(docs, id_col=id_col, text_col=text_col), "pii-places")
    new = discover(scanned, **scoring)
    places = scanned.where(F.col("kind").isin(UNKNOWN, SECRET)).select("_row", "instance", "start", "end")
    added = places.join(new, "instance").groupBy("_row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("added"), F.collect_list("votes").alias("votes"))
    added = added.mapInArrow(_clear, T.StructType([T.StructField("_row", T.LongType()), T.StructField("added", SPAN)]))
    return scanned.where(F.col("base").isNotNull()).join(added, "_row", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"), "_row")


def spans_text(spans):
    """kind:start:end of spans in their order, joined by commas."""
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
