"""Long exact spans shared between documents (problem 8).

Method: compact windows. The tokens of a text are its character q-grams; a min-hash over every
stretch of ``span`` characters has one minimal token, and the node of the Cartesian tree over
the token hashes that holds this minimum names all stretches it is minimal for: the compact
window (left, centre, right). Nodes narrower than a stretch are never made, so a text of n
characters gives about 2n/(span-q+2) windows. Two texts with an equal stretch hold windows
with the same min-hash whose intervals, laid over each other at the centres, both contain the
stretch: the join on the min-hash is an interval join as well, on the intervals' overlap.
For verbatim stretches every hash function agrees, so one function is enough for full
recall; candidates are then verified character by character around the centres. Passages that are
only nearly equal are not looked for (README gives the recall this leaves on them).

Scale: windows of exact copies are collapsed by a partial aggregate before they meet; groups
of up to ``pair_limit`` windows with one min-hash are verified pair by pair, larger groups
(standing paragraphs shorter than ``span`` in very many texts) are split exactly, by the
64-bit hashes of the full-length stretches inside their windows (equal hashes of 400 characters
count as equal characters), so the work follows the result and no pair of unrelated texts is made. Texts are never shuffled for the window stage; for
verification only texts with a shared window are (a bitmap of fixed size drops the others
before the join, and stays exact when it is full).

Defined results: null and short texts share nothing; a passage repeated inside one text is no
pair; rows with the same doc_id and text are one document; copies of a text of at least
``span`` characters are pairs like any others. Positions count code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.session import cut, table

SPAN = 400
Q = 200
#: Characters handled at once; longer texts are cut into segments that overlap by a stretch.
SEGMENT = 1 << 19
#: Groups of at most this many windows are compared pair by pair; larger ones by stretch hashes.
PAIR_LIMIT = 48
#: Least and greatest number of bits of the bitmap of texts (at most 2 MiB); it has BITS_A_TEXT a shared text between.
BITMAP, BITS_A_TEXT = (1 << 20, 1 << 24), 16

_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    return h * np.uint64(0x81DADEF4BC2DD44D)


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            inverse = pow(_BASE, -1, 1 << 64)
            one = np.ones(1, dtype=np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n, _BASE, dtype=np.uint64)]))
            self.down = np.cumprod(np.concatenate([one, np.full(n, inverse, dtype=np.uint64)]))
            self.n = n
        return self.up, self.down


def gram_hashes(codes: np.ndarray, q: int, powers: _Powers) -> np.ndarray:
    """Rolling hashes of all q-grams of a code array."""
    if len(codes) < q:
        return np.empty(0, dtype=np.uint64)
    up, down = powers.upto(len(codes))
    prefix = np.empty(len(codes) + 1, dtype=np.uint64)
    prefix[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=prefix[1:])
    h = prefix[q:] - prefix[:-q]
    h *= down[: len(h)]
    return _mix(h)


def compact_windows(h: np.ndarray, t: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, left, right) of every Cartesian-tree node over ``h`` that covers t tokens.

    ``valid[i]`` says that the stretch of t tokens from i is inside one text. A node covers t
    tokens exactly if it is the minimum of some such stretch, so the nodes are the distinct
    sliding minima, and a run of stretches with one minimum gives the part of the node's
    interval that stretches of t tokens around the centre reach.
    """
    n = len(h)
    if n < t or not valid.any():
        e = np.empty(0, dtype=np.int64)
        return e, e, e
    bits = np.uint64(max(1, int(n).bit_length()))
    key = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    pad = -n % t
    a = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, t)
    ahead = np.minimum.accumulate(a, axis=1).ravel()
    back = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - t + 1], ahead[t - 1 : n])
    at = np.flatnonzero(valid[: n - t + 1])
    centre = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], (centre[1:] != centre[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return centre[first], at[first], at[last] + t - 1


def _segments(lengths: np.ndarray, span: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, from, to) of about SEGMENT characters; stretches are never lost."""
    now: list[tuple[int, int, int]] = []
    size = 0
    for i, n in enumerate(lengths.tolist()):
        if n < span:
            continue
        start = 0
        while True:
            end = min(n, start + SEGMENT)
            now.append((i, start, end))
            size += end - start
            if size >= SEGMENT:
                yield now
                now, size = [], 0
            if end == n:
                break
            start = end - span + 1
    if now:
        yield now


def _windows(span: int, q: int):
    t = span - q + 1
    schema = pa.schema([("v", pa.int64()), ("th", pa.int64()), ("doc_id", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            texts = b.column("text")
            lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            ids, th = b.column("doc_id").to_numpy(), b.column("th").to_numpy()
            for group in _segments(lengths, span):
                parts = [texts[i].as_py() if s == 0 and e == lengths[i] else texts[i].as_py()[s:e] for i, s, e in group]
                codes = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)
                sizes = np.array([e - s for _, s, e in group])
                starts = np.cumsum(sizes) - sizes
                h = gram_hashes(codes, q, powers)
                valid = np.zeros(len(codes) + 1, dtype=np.int8)
                np.add.at(valid, starts, 1)
                np.add.at(valid, starts + sizes - span + 1, -1)
                c, left, right = compact_windows(h, t, np.cumsum(valid[:-1]) > 0)
                of = np.searchsorted(starts, c, "right") - 1
                row = np.array([i for i, _, _ in group])[of]
                shift = np.array([s for _, s, _ in group])[of] - starts[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[c].view(np.int64)), pa.array(th[row]), pa.array(ids[row]), *(pa.array((x + shift).astype(np.int32)) for x in (c, left, right))], schema=schema
                )

    return run


def _contexts(span: int, q: int):
    """Per document: for each shared window the text around its centre, cut at the text's ends."""
    reach = span - q
    schema = pa.schema([("v", pa.int64()), ("th", pa.int64()), ("c", pa.int32()), ("l", pa.int32()), ("r", pa.int32()), ("m", pa.int64()), ("before", pa.string()), ("after", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for th, text, windows in zip(b.column("th").to_pylist(), b.column("text").to_pylist(), b.column("w").to_pylist()):
                for w in windows:
                    c = w["c"]
                    row = (w["v"], th, c, w["l"], w["r"], w["m"], text[max(0, c - reach) : c][::-1], text[c : c + span])
                    for column, x in zip(out, row):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    return run


def _matrix(column: pa.Array, width: int, fill: int) -> np.ndarray:
    texts = column.to_pylist()
    joined = "".join(x.ljust(width, chr(fill)) for x in texts)
    return np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).reshape(len(texts), width)


def _verify(span: int, q: int):
    """Extend each candidate from its centres in both directions, comparing characters."""
    reach = span - q
    schema = pa.schema([("th_a", pa.int64()), ("th_b", pa.int64()), ("start_a", pa.int32()), ("start_b", pa.int32()), ("n", pa.int32())])

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.argmin(np.concatenate([a == b, np.zeros((len(a), 1), dtype=bool)], axis=1), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                b = whole.slice(k, 2048)
                # different padding on either side: what lies beyond a text's end never matches
                before = common(_matrix(b.column("before_a"), reach, 0x10FFFE), _matrix(b.column("before_b"), reach, 0x10FFFF))
                after = common(_matrix(b.column("after_a"), span, 0x10FFFE), _matrix(b.column("after_b"), span, 0x10FFFF))
                ok = (before + after >= span) & (after >= q)
                rows = np.flatnonzero(ok)
                c_a, c_b = b.column("c_a").to_numpy()[rows], b.column("c_b").to_numpy()[rows]
                yield pa.RecordBatch.from_arrays(
                    [b.column("th_a").take(pa.array(rows)), b.column("th_b").take(pa.array(rows)), *(pa.array(x.astype(np.int32)) for x in (c_a - before[rows], c_b - before[rows], (before + after)[rows]))], schema=schema
                )

    return run


def _stretches(span: int, q: int):
    """Hashes of all full-length stretches of which a window's centre is the minimum, each with
    the hash of the one before it in the window (0 for the first)."""
    schema = pa.schema([("v", pa.int64()), ("g", pa.int64()), ("before", pa.int64()), ("th", pa.int64()), ("start", pa.int32())])
    reach = span - q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for v, th, c, left, right, before, after in zip(*(b.column(x).to_pylist() for x in ("v", "th", "c", "l", "r", "before", "after"))):
                ctx = before[::-1] + after
                at = c - len(before)
                h = gram_hashes(np.frombuffer(ctx.encode("utf-32-le"), dtype=np.uint32), span, powers)
                lo, hi = max(left, at, c - reach), min(right + q - span, c, at + len(h) - 1)
                if hi < lo:
                    continue
                n = hi - lo + 1
                g = h[lo - at : hi - at + 1].view(np.int64)
                for column, x in zip(cols, (np.full(n, v), g, np.concatenate([[0], g[:-1]]), np.full(n, th), np.arange(lo, hi + 1))):
                    column.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(f.type.to_pandas_dtype())) for x, f in zip(cols, schema)], schema=schema)

    return run


def _bitmap_filter(bitmap: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column("th").to_numpy() % bits
            yield b.filter(pa.array((bitmap[slot >> 3] >> (slot & 7)) & 1 == 1))

    return run


def shared_spans(docs: DataFrame, span: int = SPAN, q: int = Q, pair_limit: int = PAIR_LIMIT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, spans, cover) of documents (doc_id, text).

    members: (doc_id, th, n) - the class of equal texts of each document long enough;
    spans: (th_a, th_b, start_a, start_b, n), th_a < th_b - verbatim stretches, one or more for
    every two classes that share one;
    cover: (th, s, n) - stretches that together cover all that is shared of each class.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= span))
    docs = docs.withColumn("th", F.xxhash64("text"))
    members = docs.select("doc_id", "th", F.length("text").alias("n")).distinct()
    found = docs.mapInArrow(_windows(span, q), "v long, th long, doc_id long, c int, l int, r int")
    # copies of a text give the same rows; min(doc_id) names the one whose text is read again
    windows = cut(found.groupBy("v", "th", "c", "l", "r").agg(F.min("doc_id").alias("doc_id")))
    hot = windows.groupBy("v").agg(F.count("*").alias("m"), F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").select("v", "m")
    shared = cut(windows.join(hot, "v"))
    bits = min(BITMAP[1], max(BITMAP[0], 1 << (BITS_A_TEXT * shared.select("th").distinct().count()).bit_length()))
    slots = shared.select((F.pmod("th", F.lit(bits))).cast("int").alias("s")).distinct().toPandas()["s"].to_numpy()
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    np.bitwise_or.at(bitmap, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    texts = docs.mapInArrow(_bitmap_filter(bitmap, bits), docs.schema)
    lists = shared.groupBy("doc_id", "th").agg(F.collect_list(F.struct("v", "c", "l", "r", "m")).alias("w"))
    ctx = (
        texts.join(lists, ["doc_id", "th"])
        .dropDuplicates(["doc_id", "th"])
        .mapInArrow(_contexts(span, q), "v long, th long, c int, l int, r int, m long, before string, after string")
    )
    ctx = cut(ctx)
    few, many = ctx.where(F.col("m") <= pair_limit), ctx.where(F.col("m") > pair_limit)
    side = lambda x: few.select("v", *(F.col(k).alias(f"{k}_{x}") for k in ("th", "c", "l", "r", "before", "after")))
    # laid over each other at their centres, the two intervals must both hold one stretch of t tokens
    overlap = "least(c_a - l_a, c_b - l_b) + least(r_a - c_a, r_b - c_b) + 1 >= " + str(span - q + 1)
    pairs = side("a").join(side("b"), "v").where("th_a < th_b").where(overlap).drop("v", "l_a", "l_b", "r_a", "r_b")
    schema = "th_a long, th_b long, start_a int, start_b int, n int"
    spans = pairs.mapInArrow(_verify(span, q), schema)
    grams = many.mapInArrow(_stretches(span, q), "v long, g long, before long, th long, start int")
    same = grams.groupBy("v", "g").agg(
        F.min("th").alias("lo"), F.max("th").alias("hi"), F.count("*").alias("k"), F.sum(F.xxhash64("th").cast("decimal(20,0)")).alias("s"), F.min("before").alias("b0"), F.max("before").alias("b1")
    )
    same = cut(same.where("lo < hi"))
    grams = cut(grams.join(same.select("v", "g"), ["v", "g"]))
    # where the stretch before has the same texts, it gives the same pairs: one stretch a run is enough
    ahead = same.select("v", F.col("g").alias("b0"), F.col("k").alias("k0"), F.col("s").alias("s0"))
    first = same.join(ahead, ["v", "b0"], "left").where("not (b0 = b1 and k = k0 and s = s0) or k0 is null").select("v", "g")
    heads = cut(grams.join(first, ["v", "g"]))
    side = lambda x: heads.select("v", "g", *(F.col(k).alias(f"{k}_{x}") for k in ("th", "start")))
    split = side("a").join(side("b"), ["v", "g"]).where("th_a < th_b").select("th_a", "th_b", "start_a", "start_b", F.lit(span).alias("n"))
    cover = spans.select(F.col("th_a").alias("th"), F.col("start_a").alias("s"), "n").unionByName(spans.select("th_b", "start_b", "n").toDF("th", "s", "n"))
    cover = cover.unionByName(grams.select("th", F.col("start").alias("s"), F.lit(span).alias("n")))
    return members, spans.unionByName(split), cover


def shared_pairs(docs: DataFrame, span: int = SPAN, q: int = Q, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(doc_id_a, doc_id_b): documents sharing a stretch of at least ``span`` characters."""
    members, spans, _ = shared_spans(docs, span, q, pair_limit)
    classes = spans.select("th_a", "th_b").distinct()
    a = members.select(F.col("th").alias("th_a"), F.col("doc_id").alias("a"))
    b = members.select(F.col("th").alias("th_b"), F.col("doc_id").alias("b"))
    across = classes.join(a, "th_a").join(b, "th_b").select("a", "b")
    repeated = members.groupBy("th").agg(F.count("*").alias("k")).where("k > 1").select("th")
    copies = members.join(repeated, "th").select("th", "doc_id")
    within = copies.select("th", F.col("doc_id").alias("a")).join(copies.select("th", F.col("doc_id").alias("b")), "th").where("a < b").select("a", "b")
    pairs = across.unionByName(within).where("a <> b")
    return pairs.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()


def shared_fraction(docs: DataFrame, span: int = SPAN, q: int = Q, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(doc_id, n_chars, n_shared, share, n_copies): how much of each sharing document stands elsewhere.

    n_shared counts the characters covered by stretches of at least ``span`` characters that
    also stand in another document; a document with an exact copy is shared in full.
    """
    members, _, cover = shared_spans(docs, span, q, pair_limit)
    ends = cover.select("th", "s", (F.col("s") + F.col("n")).alias("e")).groupBy("th", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy("th").orderBy("s", "e")
    before = F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest("s", before))
    covered = ends.withColumn("x", fresh).groupBy("th").agg(F.sum("x").alias("x"))
    k = members.groupBy("th").agg(F.count("*").alias("k"))
    out = members.join(k, "th").join(covered, "th", "left").where("k > 1 or x is not null")
    shared = F.when(F.col("k") > 1, F.col("n")).otherwise(F.col("x")).cast("long")
    return out.select("doc_id", F.col("n").cast("long").alias("n_chars"), shared.alias("n_shared"), (shared / F.col("n")).alias("share"), (F.col("k") - 1).alias("n_copies"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_pairs(table(spark, sf_dir, "documents"))


def p8_shared_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_fraction(table(spark, sf_dir, "documents"))


QUERIES = {"p8_found": p8_found, "p8_shared_fraction": p8_shared_fraction}
