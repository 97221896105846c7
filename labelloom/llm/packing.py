"""Filling fixed-capacity containers with texts (problem 6).

Method: exact-complement hashing. Item sizes are token counts, so a histogram over
1..capacity describes any number of items. The planner works on it alone: it opens a
container with the largest size left, and looks the gap up among the sums of one, two and three
available sizes; a combination that fills the gap exactly is consumed as often as the
availability counts allow, in one step. While the gap is beyond such sums, the largest fitting
size goes in first; where no sum fits exactly, best fit takes over. Every step uses up at
least one size, so a plan has a number of patterns bounded by the capacity, whatever the data.

Scale: tokens are counted in one pass over the texts; only (doc_id, count) is kept. Items of one
size are ranked inside salted groups, offsets come from the (size, salt) histogram, and a
rank finds its container in the plan by binary search. The driver holds the histogram
(capacity x salts counts) and the plan, both bounded by parameters.

Defined results: a document with more tokens than the capacity is split into full pieces and
a rest; null or empty texts have no tokens and come out with container null; repeated rows of
one doc_id are one item (the longest), rows without one none; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.session import cut, table

CAPACITY = 2048
#: Salts that split the ranking of one size: at least the first figure, at most the second, else one for so many items;
#: at most CAPACITY x salts counts reach the driver.
SALTS, MOST_SALTS, ITEMS_A_SALT = 16, 512, 1 << 22
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of this byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        made = tiktoken.__dict__.setdefault("_made_here", {})  # one per worker process
        key = hash(vocabulary.value)
        if key not in made:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.value.splitlines() if line)}
            made[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = made[key].encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) with a public tokenizer; the vocabulary file is read by the driver."""
    data = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a fixed file of about 1 MB
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_counter(data), "doc_id long, n_tokens long")


def _pair(count: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two available sizes with the given sum, the larger one as large as possible."""
    if gap < 2:
        return None
    a = np.arange(gap - 1, (gap - 1) // 2, -1)
    a = a[a < len(count)]
    b = gap - a
    ok = (count[a] > (a == b)) & (count[b] > 0)
    k = int(np.argmax(ok)) if len(ok) else 0
    return (int(a[k]), int(b[k])) if len(ok) and ok[k] else None


def exact_fill(count: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available sizes that sum to the gap exactly."""
    if gap < len(count) and count[gap] > 0:
        return [gap]
    if two := _pair(count, gap):
        return list(two)
    sizes = np.flatnonzero(count[: gap - 1])[::-1] if gap > 2 else ()
    for c in sizes:
        if 3 * c < gap:
            break  # the largest of three is at least a third
        count[c] -= 1
        two = _pair(count, gap - int(c))
        count[c] += 1
        if two:
            return [int(c), *two]
    return None


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns ({size: how many in a container}, how many containers) that use all items."""
    count = count.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    while True:
        sizes = np.flatnonzero(count)
        if not len(sizes):
            return out
        largest = int(sizes[-1])
        used, gap = [largest], capacity - largest
        count[largest] -= 1
        while gap > 0:
            left = np.flatnonzero(count)
            fill = exact_fill(count, gap) if len(left) and gap <= 3 * int(left[-1]) else None
            if fill:
                for x in fill:
                    count[x] -= 1
                used, gap = used + fill, 0
                break
            fitting = np.flatnonzero(count[: gap + 1])
            if not len(fitting):
                break
            x = int(fitting[-1])  # best fit of one more item
            count[x] -= 1
            used, gap = used + [x], gap - x
        pattern = {x: used.count(x) for x in sorted(set(used), reverse=True)}
        for x, k in pattern.items():
            count[x] += k
        times = min(int(count[x]) // k for x, k in pattern.items())
        for x, k in pattern.items():
            count[x] -= k * times
        out.append((pattern, times))


def _place(slots: dict[str, np.ndarray], offsets: dict[tuple[int, int], int]):
    key = slots["size"].astype(np.int64) << 40 | slots["from"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, salt, row = (b.column(c).to_numpy().astype(np.int64) for c in ("size", "salt", "rn"))
            rank = row - 1 + np.array([offsets[k] for k in zip(size.tolist(), salt.tolist())], dtype=np.int64)
            at = np.searchsorted(key, size << 40 | rank, "right") - 1
            container = slots["base"][at] + (rank - slots["from"][at]) // slots["each"][at]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("size"), pa.array(container)], names=["doc_id", "piece", "n_tokens", "container"])

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, container) for items (doc_id, n_tokens)."""
    spark = sizes.sparkSession
    items = cut(sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("n")))
    n_full, rest = F.floor(F.col("n") / capacity).cast("long"), F.col("n") % capacity
    if salts is None:
        total = items.agg(F.sum(F.ceil(F.col("n") / capacity)).alias("k")).first()["k"] or 0
        salts = int(min(MOST_SALTS, max(SALTS, total // ITEMS_A_SALT)))
    last = items.where((rest > 0)).select("doc_id", n_full.cast("int").alias("piece"), rest.cast("int").alias("size"))
    full = items.where(n_full > 0).select("doc_id", F.explode(F.sequence(F.lit(0), n_full.cast("int") - 1)).alias("piece"), F.lit(capacity).alias("size"))
    # by piece, so that the pieces of one long text are spread as well
    last = last.unionByName(full).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = last.groupBy("size", "salt").count().collect()  # at most capacity x salts rows
    hist = np.zeros(capacity + 1, dtype=np.int64)
    offsets: dict[tuple[int, int], int] = {}
    for size, salt, n in sorted((r[0], r[1], r[2]) for r in counts):
        offsets[size, salt] = int(hist[size])
        hist[size] += n
    slots: dict[str, list[int]] = {"size": [], "from": [], "base": [], "each": []}
    taken, base = np.zeros(capacity + 1, dtype=np.int64), 0
    for pattern, times in plan(hist, capacity):
        for x, k in pattern.items():
            for name, v in (("size", x), ("from", int(taken[x])), ("base", base), ("each", k)):
                slots[name].append(v)
            taken[x] += k * times
        base += times
    order = np.lexsort((np.array(slots["from"], dtype=np.int64), np.array(slots["size"], dtype=np.int64)))
    arrays = {k: np.array(v, dtype=np.int64)[order] for k, v in slots.items()}
    ranked = last.withColumn("rn", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")))
    placed = ranked.mapInArrow(_place(arrays, offsets), "doc_id long, piece int, n_tokens int, container long")
    none = items.where("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("container"))
    return placed.unionByName(none)


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n_items, n_containers, n_full, n_tokens, fill) of the whole packing."""
    each = p6_pack(spark, sf_dir).where("container is not null").groupBy("container").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    return each.agg(
        F.sum("k").alias("n_items"), F.count("*").alias("n_containers"), F.count_if(F.col("t") == CAPACITY).alias("n_full"), F.sum("t").alias("n_tokens"), (F.sum("t") / (F.count("*") * CAPACITY)).alias("fill")
    )


QUERIES = {"p6_pack": p6_pack, "p6_fill": p6_fill}
