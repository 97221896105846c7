"""Evaluation texts leaking into training text (problem 7).

Method: latent semantic retrieval. Passages are blocks of ``BLOCK`` words. A first pass over all
documents counts passage frequencies and sketches the Gram matrix of the passage-term matrix
(terms are the words of the test items); from the sketch a randomised SVD gives the latent
directions of the TF-IDF passages. In the second pass every corpus block with at least KNOWN words of
the items is projected, and windows of as many words of the items within a cosine of ``COSINE`` are
its candidates, looked up in the PROBES nearest cells of an inverted file. Candidates are verified:
by the longest common run of words for verbatim passages, and for reworded copies by the longest
common subsequence with the whole item at every place a candidate points to, with a check that
the item's answers (its numbers and codes) stand there too.

Recall: any ``MIN_WORDS`` consecutive words hold a whole aligned block (2*BLOCK <= MIN_WORDS+1); it has
the latent vector of its window and so its nearest cell, and no verbatim passage is missed. For
reworded copies the recall of the candidate search is measured against brute force (README, tests).

Scale: documents are never shuffled; each pass is one scan. What travels is the items (held-out
sets, handled in groups of about ITEMS_AT_ONCE), and a sketch of terms x RANK numbers summed in a
tree over salts and term groups.

Words are runs of letters, digits and marks, lower-cased; an item's word is what stands
between its gaps, so a hyphenated compound counts once. Defined results: null and short
texts hold nothing; an item under BLOCK words is never found, one under MIN_WORDS only as a reworded
copy; repeated rows of a document give one result; a null id gives none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.session import table

MIN_WORDS = 20
BLOCK = 10
#: Least cosine of a candidate for a reworded copy; the same words have a cosine of 1.
COSINE, SAME = 0.75, 0.995
#: Share of an item's blocks that must point to one place before the place is compared.
VOTES = 0.4
#: Words of a block that must be words of the items, and cells looked up for each block.
KNOWN, PROBES = 7, 4
#: A reworded copy has this share of the item's words in order, and all its answers.
IN_ORDER, PRESENT = 0.8, 0.7
RANK, KEEP = 32, 24
SEGMENT = 1 << 19
ITEMS_AT_ONCE = 5000
#: Partial sums of the sketch meet first by salt, then as a whole.
SALTS = 32
_BASE = 0x9E3779B97F4A7C15 | 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and word membership of the code points below 0x10000."""
    kept = np.__dict__.get("_word_tables")  # one per worker process
    if kept is None:
        low, word = np.arange(0x10000, dtype=np.uint32), np.zeros(0x10000, dtype=bool)
        for i in range(0x10000):
            c = chr(i)
            if 0xD800 <= i < 0xE000:
                continue
            if c.isalnum() or unicodedata.category(c)[0] == "M":
                word[i] = True
                if len(x := c.lower()) == 1:
                    low[i] = ord(x)
        kept = np._word_tables = (low, word)
    return kept


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text and the positions where they start."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    low, word = _tables()
    small = np.minimum(codes, 0xFFFF)
    is_word = word[small] | (codes > 0xFFFF)
    edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, dtype=np.uint64), start
    low_codes = np.where(codes > 0xFFFF, codes, low[small]).astype(np.uint64)
    kept = np.__dict__.get("_word_powers")
    if kept is None or len(kept[0]) < len(codes):
        n = max(len(codes), SEGMENT + (1 << 16))
        kept = np._word_powers = tuple(np.cumprod(np.full(n, b, dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up, down = kept
    prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((low_codes + np.uint64(1)) * up[: len(codes)], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * down[start]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x7FB5D329728EA185) ^ (end - start).astype(np.uint64), start


class Items:
    """The test items as term indices, laid out one after another."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        hashes, of, first, last = [], [], [], []
        for k, (_, text) in enumerate(rows):
            h, start = word_hashes(text)
            spaces = np.array([m.start() for m in re.finditer(r"\s+", text)], dtype=np.int64)
            w = np.searchsorted(spaces, start, "right")
            hashes += [h, np.zeros(1, dtype=np.uint64)]
            of += [k] * (len(h) + 1)
            new = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.empty(0, dtype=bool)
            first += [*new.tolist(), False]
            last += [*np.concatenate([new[1:], [True]]).tolist(), False] if len(w) else [False]
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        flat = np.concatenate([np.zeros(1, dtype=np.uint64), *hashes])
        self.of = np.array([-1, *of])
        gap = np.concatenate([[True], np.concatenate([[*([False] * (len(h))), True] if i % 2 == 0 else [] for i, h in enumerate(hashes)])]).astype(bool) if hashes else np.ones(1, dtype=bool)
        self.terms = np.unique(flat[~gap])
        self.term = np.where(gap, -2, np.searchsorted(self.terms, flat)).astype(np.int32)
        # words that begin before a token, words that end up to a token
        self.begun = np.concatenate([[0], np.cumsum([False, *first])[:-1]])
        self.ended = np.cumsum([False, *last])
        ok = np.array([not gap[i : i + BLOCK].any() for i in range(max(0, len(flat) - BLOCK + 1))], dtype=bool)
        self.at = np.flatnonzero(ok)
        # where each item begins, how many terms it has, and how far a reworded copy may be shifted
        self.size = np.array([len(h) for h in hashes[::2]], dtype=np.int64)
        self.begin = 1 + np.cumsum(self.size + 1) - (self.size + 1)
        self.slack = self.size // 4 + BLOCK


def _pieces(text: str, overlap: int) -> Iterator[str]:
    """A very long text in pieces that share ``overlap`` words, so that no passage is lost."""
    start = 0
    while len(text) - start > 2 * SEGMENT:
        end = start + SEGMENT
        words = [m.start() for m in re.finditer(r"\S+", text[max(start + 1, end - (SEGMENT >> 1)) : end])]
        yield text[start:end]
        start = max(start + 1, end - (SEGMENT >> 1)) + words[-overlap] if len(words) >= overlap else end - (SEGMENT >> 1)
    yield text[start:]


def _slices(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word hashes, ids of the texts, first word of each text) of about SEGMENT characters."""
    for b in batches:
        texts, ids, size = [], [], 0
        column = b.column("text")
        for i, doc in enumerate(b.column("doc_id").to_pylist()):
            t = column[i].as_py()
            if t and doc is not None:
                for piece in _pieces(t, overlap) if len(t) > 2 * SEGMENT else (t,):
                    texts.append(piece)
                    ids.append(doc)
                    size += len(piece) + 1
                    if size >= SEGMENT:
                        yield _joined(texts, ids)
                        texts, ids, size = [], [], 0
            if texts and (size >= SEGMENT or i == b.num_rows - 1):
                yield _joined(texts, ids)
                texts, ids, size = [], [], 0
        if texts:
            yield _joined(texts, ids)


def _joined(texts: list[str], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, start = word_hashes("\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.array(ids, dtype=np.int64), np.searchsorted(start, ends - np.array([len(t) + 1 for t in texts]))


def _terms_of(h: np.ndarray, terms: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, at, -1).astype(np.int32)


def _blocks(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of each whole aligned block."""
    sizes = np.diff(np.concatenate([first, [n]])) // BLOCK
    of = np.repeat(np.arange(len(first)), sizes)
    k = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return of, first[of] + BLOCK * k


CHUNK = 64


def _sketch(items: Items, omega: np.ndarray, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(items.terms)
        acc = np.zeros((v, 1 + omega.shape[1]))
        wide = np.concatenate([omega, np.zeros((1, omega.shape[1]), dtype=np.float32)])  # the last row: no term
        n_blocks = 0
        for h, _, first in _slices(batches, overlap):
            term = _terms_of(h, items.terms)
            _, at = _blocks(first, len(h))
            n_blocks += len(at)
            for k in range(0, len(at), 1 << 14):
                t = term[at[k : k + (1 << 14), None] + np.arange(BLOCK)]
                z = wide[t[:, 0]]
                for j in range(1, BLOCK):
                    z = z + wide[t[:, j]]
                flat = t.ravel()
                order = np.argsort(flat.astype(np.int16) if v < 32000 else flat, kind="stable")
                order = order[np.searchsorted(flat[order], 0) :]
                if not len(order):
                    continue
                s = flat[order]
                cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                block = order // BLOCK
                acc[s[cuts], 1:] += np.add.reduceat(z[block], cuts, axis=0)
                once = np.concatenate([[True], (s[1:] != s[:-1]) | (block[1:] != block[:-1])])
                acc[:, 0] += np.bincount(s[once], minlength=v)
        if n_blocks:
            rows = [(c, acc[c * CHUNK : (c + 1) * CHUNK].astype(np.float64).tobytes()) for c in range(-(-v // CHUNK))]
            rows.append((-1, np.array([n_blocks], dtype=np.float64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "data"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for c, d in zip(b.column("chunk").to_pylist(), b.column("data").to_pylist()):
            x = np.frombuffer(d)
            total[c] = total[c] + x if c in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "data"])


def latent_space(docs: DataFrame, items: Items, overlap: int = 256) -> np.ndarray:
    """(terms x KEEP) projection of TF-IDF passages: idf times the right singular vectors.

    Randomised SVD from one pass: with Y = G W for the Gram matrix G of term counts and a random
    W, G is about Y (W'Y)^+ Y'; idf weights scale the rows of Y.
    """
    v = len(items.terms)
    omega = np.random.default_rng(7).standard_normal((v, RANK)).astype(np.float32)
    parts = docs.mapInArrow(_sketch(items, omega, overlap), "chunk int, data binary")
    salted = parts.repartition(SALTS, F.pmod(F.xxhash64(F.spark_partition_id(), "chunk"), F.lit(SALTS))).mapInArrow(_summed, "chunk int, data binary")
    rows = salted.repartition(8, "chunk").mapInArrow(_summed, "chunk int, data binary").collect()  # terms x RANK numbers
    data = {r[0]: np.frombuffer(bytes(r[1])) for r in rows}
    if -1 not in data:
        return np.zeros((v, KEEP), dtype=np.float32)
    acc = np.concatenate([data[c] for c in range(-(-v // CHUNK))]).reshape(v, RANK + 1)
    idf = np.log((1 + data[-1][0]) / (1 + acc[:, 0])) + 1
    y = acc[:, 1:]
    core = omega.T @ y
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > value.max() * 1e-6
    m = (idf[:, None] * y) @ (vector[:, good] / np.sqrt(value[good]))
    u = np.linalg.svd(m, full_matrices=False)[0][:, :KEEP]
    return (idf[:, None] * u).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _project(t: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Latent unit vectors of blocks of terms; -1 is a word no item has (``space`` ends in a row of zeros)."""
    z = space[t[:, 0]]
    for j in range(1, t.shape[1]):
        z = z + space[t[:, j]]
    return _unit(z)


class Cells:
    """An inverted file over unit vectors; a query looks at the members of its nearest cells."""

    def __init__(self, x: np.ndarray, cosine: float, probes: int = PROBES) -> None:
        self.x, self.cosine = x, cosine
        k = max(1, int(np.sqrt(len(x))))
        c = x[np.random.default_rng(3).permutation(len(x))[:k]]
        for _ in range(4):
            near = np.argmax(x @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            c = _unit(np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, c))
        self.c, self.probes = c, min(probes, k)
        near = np.argmax(x @ c.T, axis=1)
        self.members = [np.flatnonzero(near == i) for i in range(k)]

    def search(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of z, row of x, cosine) of pairs with at least the cosine, within the nearest cells."""
        e = np.empty(0, dtype=np.int64)
        if not len(z):
            return e, e, np.empty(0)
        near = np.argpartition(-(z @ self.c.T), self.probes - 1, axis=1)[:, : self.probes]
        order = np.argsort(near.ravel(), kind="stable")
        cell = near.ravel()[order]
        cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        left, right, cosine = [], [], []
        for s, t in zip(cuts, [*cuts[1:], len(cell)]):
            m = self.members[cell[s]]
            if len(m):
                rows = order[s:t] // self.probes
                near_ = z[rows] @ self.x[m].T
                a, b = np.nonzero(near_ >= self.cosine)
                left.append(rows[a])
                right.append(m[b])
                cosine.append(near_[a, b])
        return (np.concatenate(left), np.concatenate(right), np.concatenate(cosine)) if left else (e, e, np.empty(0))


def _runs(term: np.ndarray, items: Items, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far equal words go on to the left of (p, q) and to the right, these included."""
    out = []
    for step in (-1, 1):
        n = np.zeros(len(p), dtype=np.int64)
        live = np.arange(len(p))
        i = p + (step if step < 0 else 0)
        j = q + (step if step < 0 else 0)
        while len(live):
            same = (i >= 0) & (i < len(term))
            same[same] = term[i[same]] == items.term[j[same]]
            live, i, j = live[same], i[same] + step, j[same] + step
            n[live] += 1
        out.append(n)
    return out[0], out[1]


def _places(items: Items, pair: np.ndarray, item: np.ndarray, start: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One candidate of each (text, item, place) that enough blocks of the text point to.

    Candidates whose items would begin within half the slack of each other point to one place.
    """
    key = pair.astype(np.int64) << 24 | np.maximum(start // (items.slack[item] // 2) + 64, 0)
    place, at, of = np.unique(key, return_index=True, return_inverse=True)
    each = np.unique(of.astype(np.int64) << 24 | p)  # a block votes once
    votes = np.bincount(each >> 24, minlength=len(place))
    return at[votes >= np.maximum(2, np.ceil(VOTES * items.size[item[at]] / BLOCK))]


def _search(items: Items, space: np.ndarray, cosine: float, min_words: int, report: bool, overlap: int):
    names = ["doc_id", "item_id", "run_words"] + (["lcs_share", "answers_found"] if report else [])
    types = [pa.int64(), pa.int64(), pa.int32()] + ([pa.float64(), pa.float64()] if report else [])
    space = np.concatenate([space, np.zeros((1, space.shape[1]), dtype=space.dtype)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(_project(items.term[items.at[:, None] + np.arange(BLOCK)], space), cosine)
        for h, ids, first in _slices(batches, overlap):
            term = _terms_of(h, items.terms)
            of, at = _blocks(first, len(h))
            known = np.flatnonzero((term[at[:, None] + np.arange(BLOCK)] >= 0).sum(axis=1) >= KNOWN) if len(at) else np.empty(0, dtype=np.int64)
            of, at = of[known], at[known]
            ends = np.concatenate([first[1:], [len(term)]])
            cols: list[list] = [[] for _ in names]
            for k in range(0, len(at), 1 << 15):
                z = _project(term[at[k : k + (1 << 15), None] + np.arange(BLOCK)], space)
                rows, window, near = cells.search(z)
                if not len(rows):
                    continue
                doc, p, q = of[k + rows], at[k + rows], items.at[window]
                pair = doc * len(items.ids) + items.of[q]
                shares: dict[int, tuple[float, float]] = {}
                if report:
                    item = items.of[q]
                    start = p - (q - items.begin[item])
                    for o in _places(items, pair, item, start - first[doc], p):
                        lo, hi = max(first[doc[o]], start[o] - items.slack[item[o]]), min(ends[doc[o]], start[o] + items.size[item[o]] + items.slack[item[o]])
                        got = _compare(items, item[o], term[lo:hi])
                        if got is not None:
                            shares[int(pair[o])] = max(shares.get(int(pair[o]), (0.0, 0.0)), got)
                same = near >= SAME  # verbatim blocks are among these
                reworded = np.isin(pair, list(shares)) if shares else np.zeros(len(pair), dtype=bool)
                keep = same | reworded
                doc, p, q, pair = doc[keep], p[keep], q[keep], pair[keep]
                item = items.of[q]
                back, ahead = _runs(term, items, p, q)
                back, ahead = np.minimum(back, p - first[doc]), np.minimum(ahead, ends[doc] - p)
                words = np.where(ahead > 0, items.ended[q + np.maximum(ahead, 1) - 1] - items.begun[q - back], 0)
                order = np.lexsort((-words, pair))
                if not report:
                    order = order[words[order] >= min_words]
                best = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])] if len(order) else order
                for o in best:
                    row = [int(ids[doc[o]]), int(items.ids[item[o]]), int(words[o])]
                    if report:
                        share = shares.get(int(pair[o]))
                        if share is None and words[o] < min_words:
                            continue  # neither a passage nor near a reworded copy
                        row += share or (float(words[o]) / items.size[item[o]], 0.0)
                    for c, x in zip(cols, row):
                        c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def _compare(items: Items, item: int, region: np.ndarray) -> tuple[float, float] | None:
    """Share of the item's words in the longest common subsequence, and share of its answers present.

    None where less than PRESENT of the item's words stand there at all, in whatever order.
    """
    own = items.term[items.begin[item] : items.begin[item] + items.size[item]]
    if np.isin(own, region).sum() < PRESENT * len(own):
        return None
    best = np.zeros(len(region) + 1, dtype=np.int32)
    for w in own:
        diagonal = best[:-1] + (region == w)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], diagonal))
    asked = own[items.rare[own]]
    return float(best[-1]) / max(1, len(own)), float(np.isin(asked, region).mean()) if len(asked) else 1.0


_WORD = re.compile(r"\w+")


def _groups(items: DataFrame) -> Iterator[Items]:
    """The items in groups of about ITEMS_AT_ONCE, each collected by itself (a hash of the id decides)."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_id"])
    n = -(-items.count() // ITEMS_AT_ONCE)
    for g in range(n):
        rows = sorted((int(r[0]), r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == g).collect())
        x = Items(rows)
        if len(x.at):
            marked = np.zeros(len(x.terms), dtype=bool)
            for _, text in rows:
                h, start = word_hashes(text)
                digit = np.array([bool(m := _WORD.match(text, s)) and any(c.isdigit() for c in m[0]) for s in start.tolist()], dtype=bool)
                if digit.any():
                    marked[np.searchsorted(x.terms, h[digit])] = True
            x.rare = marked
            yield x


def leaked(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, cosine: float = COSINE, report: bool = False) -> DataFrame:
    """(doc_id, item_id, run_words[, lcs_share, answers_found]) of documents and the items in them.

    With ``report`` the pairs that share PRESENT of the item's words in one place come out as well;
    lcs_share and answers_found are those of the place where most words are in order.
    """
    if 2 * BLOCK > min_words + 1:
        raise ValueError(f"passages of {min_words} words need shorter blocks than {BLOCK}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, run_words int" + (", lcs_share double, answers_found double" if report else "")
    out = docs.sparkSession.createDataFrame([], schema)
    for group in _groups(items):
        overlap = max(256, min_words, 3 * int(group.size.max()))  # in words: no passage and no place is cut
        space = latent_space(docs, group, overlap)
        out = out.unionByName(docs.mapInArrow(_search(group, space, cosine if report else max(cosine, SAME), min_words, report, overlap), schema))
    if not report:
        return out.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"))
    best = out.groupBy("doc_id", "item_id").agg(F.max("run_words").alias("run_words"), F.max(F.struct("lcs_share", "answers_found")).alias("m"))
    return best.select("doc_id", "item_id", "run_words", "m.lcs_share", "m.answers_found")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the longest run, the longest common subsequence and the answer check.

    leaked is true for a verbatim run of MIN_WORDS words, or for a reworded copy: four fifths
    of the item's words in order and all its numbers and codes nearby.
    """
    r = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), report=True)
    reworded = (F.col("lcs_share") >= IN_ORDER) & (F.col("answers_found") >= 0.999)
    return r.withColumn("leaked", (F.col("run_words") >= MIN_WORDS) | reworded)


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
