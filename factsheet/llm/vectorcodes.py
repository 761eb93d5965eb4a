"""Vector codes by product quantization, with norm-of-sum bounds before exact rescans.

Vectors become integers, are cut into equal parts, and every part position has a small
codebook that a fixed number of rounds improves. The codebooks of all rounds are kept.
A part remembers an upper bound of the distance to its entry and a lower bound of the
distance to any other entry, each with the round in which it was exact. Later an entry can
have come nearer or gone farther by no more than its true net displacement since that
round: the norm of the summed moves, not the sum of their norms. Where the upper bound
stays below the lower one the entry is certain; else the distance to it is made exact,
and only where that is not enough the part is compared with all entries again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, join_by_key, small_batches, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that one block of state holds at most.
BLOCK_ROWS = 1024
#: What rounding to 32-bit floats and in square roots can take from a bound.
SLACK = 1e-6


def most_component(dim: int) -> int:
    """Integer components saturate here, so that squared distances stay below 2^62."""
    return 1 << (60 - max(dim - 1, 1).bit_length()) // 2


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(4096 x) of finite vectors (rows), saturated, filled with zeros to a multiple of the parts."""
    most = most_component(x.shape[1])
    out = np.clip(np.floor(np.clip(x.astype(np.float64), -most, most) * SCALE), -most, most).astype(np.int64)
    return np.pad(out, ((0, 0), (0, -x.shape[1] % PARTS)))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of parts (rows) to a codebook's entries."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * reach * reach * max(x.shape[1], 1) < 1 << 53:  # sums of products are exact as doubles
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in book], axis=1)


class Block:
    """The state of some vectors of one length: components, entries, bounds and their rounds."""

    FIELDS = ("entry", "upper", "lower", "upper_round", "lower_round")
    TYPES = (np.uint8, np.float32, np.float32, np.uint8, np.uint8)

    def __init__(self, x: np.ndarray, state: dict[str, np.ndarray] | None = None):
        self.x = x
        self.n = len(x)
        self.state = state or {f: np.zeros((self.n, PARTS), t) for f, t in zip(self.FIELDS, self.TYPES)}
        self.rescans = 0

    def part(self, p: int) -> np.ndarray:
        d = self.x.shape[1] // PARTS
        return self.x[:, p * d:(p + 1) * d].astype(np.int64)

    def assign(self, history: list[np.ndarray]) -> None:
        """Give every part its nearest entry of the last codebooks; ties go to the lower index."""
        now = len(history) - 1
        for p in range(PARTS):
            books = [h[p] for h in history]
            own = {f: v[:, p] for f, v in self.state.items()}
            doubt = np.arange(self.n) if now == 0 else self._doubtful(books, own, now, p)
            self.rescans += len(doubt)
            if len(doubt):
                d2 = distances(self.part(p)[doubt], books[now])
                best = d2.argmin(axis=1)
                rows = np.arange(len(doubt))
                near = np.sqrt(d2[rows, best].astype(np.float64))
                d2[rows, best] = np.iinfo(np.int64).max
                far = np.sqrt(d2.min(axis=1).astype(np.float64))
                own["entry"][doubt] = best
                own["upper"][doubt], own["lower"][doubt] = near * (1 + SLACK), far * (1 - SLACK)
                own["upper_round"][doubt] = own["lower_round"][doubt] = now

    def _doubtful(self, books: list[np.ndarray], own: dict[str, np.ndarray], now: int, p: int) -> np.ndarray:
        moved = np.stack([np.sqrt(((books[now] - b).astype(np.float64) ** 2).sum(axis=1)) for b in books]) * (1 + SLACK)
        k = moved.shape[1]
        others = np.where(np.eye(k, dtype=bool), 0.0, moved[:, None, :]).max(axis=2)  # of all entries but one
        entry = own["entry"]
        lower = own["lower"] - others[own["lower_round"], entry]
        upper = own["upper"] + moved[own["upper_round"], entry]
        doubt = np.flatnonzero(~(upper * (1 + SLACK) < lower))
        if len(doubt):
            exact = np.sqrt(((self.part(p)[doubt] - books[now][entry[doubt]]) ** 2).sum(axis=1).astype(np.float64))
            own["upper"][doubt], own["upper_round"][doubt] = exact * (1 + SLACK), now
            doubt = doubt[~(exact * (1 + SLACK) < lower[doubt])]
        return doubt

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry: the sum of its parts' components, and their number."""
        total, number = [], []
        for p in range(PARTS):
            chosen = self.state["entry"][:, p][:, None] == np.arange(k)
            # sums of a block are exact as doubles: 1024 times at most 2^30
            total.append((chosen.T.astype(np.float64) @ self.part(p)).astype(np.int64))
            number.append(chosen.sum(axis=0))
        return np.stack(total), np.stack(number)

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances to the entries, summed over parts."""
        return sum(((self.part(p) - books[p][self.state["entry"][:, p]]) ** 2).sum(axis=1) for p in range(PARTS))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    reach = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if reach < 1 << 15 else "<i4" if reach < 1 << 31 else "<i8")


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("width", T.IntegerType()),
        T.StructField("x", T.BinaryType()), *(T.StructField(f, T.BinaryType()) for f in Block.FIELDS),
        T.StructField("sums", T.BinaryType()), T.StructField("numbers", T.BinaryType()), T.StructField("rescans", T.LongType())])


def _usable(v):
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def _pack(block: Block, dim: int, ids: pa.Array, labels: pa.Array, k: int, schema: T.StructType) -> pa.RecordBatch:
    total, number = block.sums(k)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    x = _narrow(block.x)
    raw = [x, *(block.state[f] for f in Block.FIELDS), total.astype("<i8"), number.astype("<i8")]
    return pa.RecordBatch.from_arrays(
        [pa.array([dim], pa.int32()), one(ids), one(labels), pa.array([x.dtype.itemsize], pa.int32()),
         *(pa.array([a.tobytes()], pa.binary()) for a in raw), pa.array([block.rescans], pa.int64())], names=schema.names)


def _unpack(row: dict) -> Block:
    width = row["width"]
    n = len(row["entry"]) // PARTS
    x = np.frombuffer(row["x"], f"<i{width}").reshape(n, -1)
    state = {f: np.frombuffer(row[f], t).reshape(n, PARTS).copy() for f, t in zip(Block.FIELDS, Block.TYPES)}
    return Block(x, state)


def _first_blocks(rows: DataFrame, books: dict[int, list[np.ndarray]], schema: T.StructType) -> DataFrame:
    """Blocks of the vectors of a batch, assigned in round 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                own = pa.array(np.flatnonzero(sizes == dim))
                block = Block(whole_numbers(flat[np.repeat(sizes == dim, sizes)].reshape(-1, dim) if dim
                                            else np.zeros((len(own), 0))))
                block.assign(books[dim])
                yield _pack(block, dim, b.column(0).take(own), b.column(1).take(own), books[dim][0].shape[1], schema)

    return rows.mapInArrow(run, schema)


def _next_blocks(blocks: DataFrame, books: dict[int, list[np.ndarray]], schema: T.StructType) -> DataFrame:
    """The blocks assigned anew to the last codebooks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {f: b.column(f)[i].as_py() for f in ("dim", "width", "x", *Block.FIELDS)}
                block = _unpack(row)
                block.assign(books[row["dim"]])
                yield _pack(block, row["dim"], b.column("ids")[i].values, b.column("labels")[i].values,
                            books[row["dim"]][0].shape[1], schema)

    return blocks.mapInArrow(run, schema)


def _moved_books(blocks: DataFrame, books: dict[int, list[np.ndarray]]) -> None:
    """Append to each history the codebook whose entries are their parts' floored means; unused entries stay.

    Sums are added up in Spark; the driver gets one number per component of a codebook.
    """
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("slot", T.IntegerType()),
                           T.StructField("value", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                both = np.concatenate([np.frombuffer(n, "<i8"), np.frombuffer(s, "<i8")])
                total[dim] = total[dim] + both if dim in total else both
        for dim, both in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(both), dim, np.int32)), pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)],
                names=schema.names)

    found = blocks.select("dim", "sums", "numbers").mapInArrow(add, schema).groupBy("dim", "slot").agg(
        F.sum("value").alias("value")).toArrow()
    dims, slots, values = (found[c].to_numpy() for c in ("dim", "slot", "value"))
    for dim, history in books.items():
        last = history[-1]
        flat = np.zeros(PARTS * last.shape[1] + last.size, np.int64)
        own = dims == dim
        flat[slots[own]] = values[own]
        numbers = flat[:PARTS * last.shape[1]].reshape(PARTS, -1, 1)
        sums = flat[PARTS * last.shape[1]:].reshape(last.shape)
        history.append(np.where(numbers > 0, sums // np.maximum(numbers, 1), last))


def _first_books(rows: DataFrame) -> dict[int, list[np.ndarray]]:
    """Per vector length, the parts of the smallest ids' vectors; at most 16 vectors of a length reach the driver."""
    w = Window.partitionBy(F.size("vector")).orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    least = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= ENTRIES).select("place", "vector").collect()
    found: dict[int, list] = {}
    for r in sorted(least, key=lambda r: r["place"]):
        found.setdefault(len(r["vector"]), []).append(r["vector"])
    return {dim: [whole_numbers(np.array(v, dtype=np.float64).reshape(len(v), dim)).reshape(len(v), PARTS, -1).swapaxes(0, 1)]
            for dim, v in found.items()}


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 rounds: int = ROUNDS) -> DataFrame:
    """Codes of all usable vectors after ``rounds`` rounds of codebook learning over all of them.

    One row per kept row: ``vec_id``, ``label`` (as text), ``code`` (index per part, two hex digits
    each), ``error`` (squared distances of integer components, summed over parts),
    ``label_error`` (summed over equal labels, nulls together) and ``codebooks_sha256``.

    Vectors that are null or hold null or non-finite components are dropped. Every length has
    codebooks of its own, from its 16 smallest ids (null ids last, ties by vector; fewer
    vectors make fewer entries); a length that 8 doesn't divide is filled up with zeros, and empty
    vectors get index 0 and error 0. Components beyond ``most_component`` saturate. Repeated rows
    are vectors of their own; null ids stay null; an empty table gives an empty result; columns
    beyond the three named are not read.

    State lives in blocks of at most 1,024 vectors, written once a round, with the sums of a block
    in columns of their own; the driver holds the codebooks of all rounds, bounded by the lengths.
    """
    spark = vectors.sparkSession
    small_batches(spark, BLOCK_ROWS)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).alias("vector")).where(_usable(F.col("vector")))
    books = _first_books(rows)
    schema = _schema(rows.schema["vec_id"].dataType)
    blocks = stored(_first_blocks(rows, books, schema), "vector-blocks")
    small_batches(spark, 2)  # a row is a whole block from here on
    for _ in range(rounds):
        _moved_books(blocks, books)
        before, blocks = blocks, stored(_next_blocks(blocks, books, schema), "vector-blocks")
        drop_stored(before)
    last = {dim: h[-1] for dim, h in books.items()}
    digests = {dim: books_sha256(b) for dim, b in last.items()}
    out = T.StructType([T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("label", T.StringType()),
                        T.StructField("code", T.StringType()), T.StructField("error", T.LongType()),
                        T.StructField("codebooks_sha256", T.StringType())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {f: b.column(f)[i].as_py() for f in ("dim", "width", "x", *Block.FIELDS)}
                block = _unpack(row)
                text = block.state["entry"].tobytes().hex()
                codes = [text[k:k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("ids")[i].values, b.column("labels")[i].values, pa.array(codes, pa.string()),
                     pa.array(np.asarray(block.errors(last[row["dim"]]), dtype=np.int64)),
                     pa.array([digests[row["dim"]]] * block.n, pa.string())], names=out.names)

    coded = stored(blocks.mapInArrow(tell, out), "vector-codes")
    drop_stored(blocks)
    totals = stored(coded.groupBy("label").agg(F.sum("error").cast("long").alias("label_error"),
                                               F.count(F.lit(1)).alias("rows")), "vector-labels")
    return join_by_key(coded, totals, "label", "rows").select(
        "vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
