"""Hard negatives by rotated one-bit codes with exact residual intervals.

Vectors are taken as integers, ``floor(256 * x)``, and scored by their integer inner
product.  An anchor's positives are its best rows of the same label; for each positive
the negatives wanted are the best rows of other labels whose score lies in a window
given by the positive's score.  Anchors are a stated query set, met with all rows.

Each vector is rotated once and coded by ``LEVELS`` one-bit codes: the signs of the
rotated vector, then the signs of what the first code leaves over, and so on.  Stored
with the codes are the alignments (the length of each residual along its unit code
vector) and the length of the last residual.  An anchor is rotated too and rounded to
``PLANES`` bits; the product of a code with it is a sum of popcounts over its bit planes.
These products, weighted by the alignments, estimate the score; what the estimate
leaves out is at most (Cauchy-Schwarz) ``|residual| * |rounded anchor| + |vector| *
|rounding error|``.  So the true score lies in an interval, always, not only likely:
rows whose interval misses the window, or lies under the scores already found, go; the
others are scored in integers.  The codes decide how much is scored, never the result.

Anchors are taken in chunks of about ``CHUNK / 2`` components: a chunk is sent to all
tasks, each task reads its part of the stored codes once, keeps the best few per anchor, and only these are shuffled.  No
vector is shuffled, so a hot label needs no splitting.  Results of a chunk are written
before the next one, so a lost executor repeats part of one chunk.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component take no part; nor do rows whose squared integer length reaches 2^62, since
scores are longs.  Vectors of different lengths do not compare; empty ones score 0.
Rows that are equal in id, label and integers count once; others with the same id are
rows of their own, but never positives or negatives of an anchor with their id; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import small_batches, stage_dir, stored, table

LEVELS = 4
PLANES = 6
POSITIVES = 5
NEGATIVES = 10
#: Shares of a positive's score, in percent, that bound its negatives.
LEAST, MOST = 30, 90
#: Components of the anchors sent to the tasks at once (about half of it, by hash), and
#: how many anchors meet a batch of rows at once.
CHUNK = 1 << 20
TILE = 512
#: Pairs scored at once.
PAIRS = 1 << 15
#: The longest integer vector that takes part, squared.
MAX_SQUARE = 1 << 62
SEED = 11
CODED = "id bigint, label bigint, v array<bigint>, dim int, codes array<bigint>, aligned array<double>, rest double, length double"


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed_bits(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-signs.shape[1] // 64)
    wide = np.zeros((len(signs), words * 64), bool)
    wide[:, :signs.shape[1]] = signs
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def one_bit_codes(v: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, levels, words), alignments (n, levels) and the length of the rest."""
    n, dim = v.shape
    left = v.astype(np.float64) @ rotation(dim)
    codes, aligned = np.zeros((n, levels, -(-dim // 64)), np.uint64), np.zeros((n, levels))
    for k in range(levels):
        up = left >= 0
        codes[:, k] = packed_bits(up)
        aligned[:, k] = np.abs(left).sum(1) / np.sqrt(dim)
        left = left - np.where(up, 1.0, -1.0) * (aligned[:, k:k + 1] / np.sqrt(dim))
    return codes, aligned, np.sqrt((left * left).sum(1))


class Anchors:
    """Anchors of one vector length, rotated and rounded to bit planes."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, planes: int = PLANES):
        self.at, self.ids, self.labels, self.v = at, ids, labels, v
        dim = v.shape[1]
        turned = v.astype(np.float64) @ rotation(dim) if dim else np.zeros((len(v), 1))
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / ((1 << planes) - 1), 1e-300)
        steps = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = np.stack([packed_bits((steps >> b) & 1 == 1) for b in range(planes)])
        rounded = self.low[:, None] + self.step[:, None] * steps
        self.sum = rounded.sum(1)
        self.length = np.sqrt((rounded * rounded).sum(1))
        self.error = np.sqrt(((turned - rounded) ** 2).sum(1))

    def products(self, code: np.ndarray, some: slice) -> np.ndarray:
        """Products of rows' unit code vectors with rounded anchors (rows by anchors):
        for signs s, ``s . q = 2 * (sum of q where s is up) - (sum of q)``."""
        dim = self.v.shape[1]
        inside = np.zeros((len(code), len(self.at[some])), np.int64)
        for b, plane in enumerate(self.planes[:, some]):
            for w in range(code.shape[1]):
                inside += np.bitwise_count(code[:, w, None] & plane[None, :, w]).astype(np.int64) << b
        ups = np.bitwise_count(code).sum(1)
        up_sum = self.low[some] * ups[:, None] + self.step[some] * inside
        return (2 * up_sum - self.sum[some]) / np.sqrt(max(dim, 1))

    def intervals(self, codes: np.ndarray, aligned: np.ndarray, rest: np.ndarray, length: np.ndarray,
                  some: slice) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores (rows by anchors)."""
        middle = np.zeros((len(rest), len(self.at[some])))
        for k in range(codes.shape[1]):
            middle += aligned[:, k:k + 1] * self.products(codes[:, k], some)
        width = rest[:, None] * self.length[some] + length[:, None] * self.error[some]
        # Room for rounding in the rotation and the sums.
        width += 1e-6 + 1e-9 * length[:, None] * (self.length[some] + self.error[some])
        return middle - width, middle + width


class Best:
    """The best ``k`` (score, id) of each of ``n`` places: higher scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.place, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: The k-th best score so far of a place; any score if it has fewer.
        self.bar = np.full(n, -np.inf)

    def add(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        place, score, ids = (np.concatenate(x) for x in ((self.place, place), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        first = np.searchsorted(place, place)
        rank = np.arange(len(place)) - first
        keep = rank < self.k
        full = rank == self.k - 1
        self.bar[place[full]] = score[full]
        self.place, self.score, self.id = place[keep], score[keep], ids[keep]


def _usable(id_col: Column, label: Column, v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x * 256) | (F.abs(x * 256) >= 2.0 ** 31))
    return F.coalesce(id_col.isNotNull() & label.isNotNull() & v.isNotNull() & ~bad, F.lit(False))


def coded(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          relabel: Column | None = None) -> DataFrame:
    """The rows that take part, as integers with their codes (columns ``CODED``)."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    given = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                           doubles.alias("x"))
    # 2^31 and more in a component is over MAX_SQUARE by itself.
    rows = given.where(_usable(F.col("id"), F.col("label"), F.col("x")))
    if relabel is not None:
        rows = rows.withColumn("label", relabel)
    rows = rows.select("id", "label", F.transform("x", lambda x: F.floor(x * 256)).alias("v")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            dims = np.diff(v.offsets.to_numpy())
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(part.column(2), int(dim))
                short = (x.astype(np.float64) ** 2).sum(1) < MAX_SQUARE * (1 - 1e-9)
                part, x = part.filter(pa.array(short)), x[short]
                codes, aligned, rest = one_bit_codes(x) if dim else (
                    np.zeros((len(x), LEVELS, 0), np.uint64), np.zeros((len(x), LEVELS)), np.zeros(len(x)))
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array(np.full(len(x), dim, np.int32)), _lists(codes.view(np.int64)), _lists(aligned),
                    pa.array(rest), pa.array(np.sqrt((x.astype(np.float64) ** 2).sum(1)))],
                    names=["id", "label", "v", "dim", "codes", "aligned", "rest", "length"])

    small_batches(vectors.sparkSession)
    return rows.mapInArrow(run, CODED)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1)
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1)))


class Rows:
    """The rows of a batch whose vectors have ``dim`` components, as arrays."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        at = pa.array(np.flatnonzero(batch.column("dim").to_numpy() == dim))
        self.ids, self.labels, self.rest, self.length = (
            batch.column(c).take(at).to_numpy() for c in ("id", "label", "rest", "length"))
        self.v = _matrix(batch.column("v").take(at), dim)
        words = -(-dim // 64)
        self.codes = _matrix(batch.column("codes").take(at), LEVELS * words).view(np.uint64).reshape(len(at), LEVELS, words)
        self.aligned = _matrix(batch.column("aligned").take(at), LEVELS)


def _meet(rows: Rows, g: Anchors, some: slice, same_label: bool, windows: np.ndarray | None, best: Best) -> None:
    """Rows against a tile of anchors: filter by interval, score the rest, keep the best."""
    ids, labels, anchors = g.ids[some], g.labels[some], g.v[some]
    per = len(best.bar) // len(ids)
    low, high = g.intervals(rows.codes, rows.aligned, rows.rest, rows.length, some)
    fits = ((rows.labels[:, None] == labels) == same_label) & (rows.ids[:, None] != ids)
    alive = []
    for w in range(per):
        into = fits & (high >= best.bar[w::per])
        if windows is not None:
            into &= (high >= windows[:, w, 0]) & (low <= windows[:, w, 1])
        alive.append(into)
    i, j = np.nonzero(np.logical_or.reduce(alive))
    # Only these are scored, in integers, a bounded number at once.
    for at in range(0, len(i), PAIRS):
        r, a = i[at:at + PAIRS], j[at:at + PAIRS]
        score = np.einsum("ij,ij->i", rows.v[r], anchors[a])
        places, chosen = [], []
        for w in range(per):
            into = alive[w][r, a] & (score >= best.bar[a * per + w])
            if windows is not None:
                into &= (score >= windows[a, w, 0]) & (score <= windows[a, w, 1])
            chosen.append(np.flatnonzero(into))
            places.append(a[chosen[-1]] * per + w)
        chosen = np.concatenate(chosen)
        if len(chosen):
            best.add(np.concatenate(places), score[chosen], rows.ids[r[chosen]])


def search(rows: DataFrame, groups: list[Anchors], n: int, same_label: bool, k: int,
           windows: np.ndarray | None = None) -> DataFrame:
    """The best ``k`` rows for each place: ``place``, ``id``, ``score``.

    A place is an anchor or, with ``windows`` (lowest and highest score by anchor
    and window), one window of an anchor: ``anchor * windows + window``.  Rows must be
    of the anchor's label, or of another.  ``n`` is the number of anchors."""
    per = 1 if windows is None else windows.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast((groups, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, windows = sent.value
        tiles = [(g, slice(at, at + TILE)) for g in groups for at in range(0, len(g.at), TILE)]
        bests = [Best(len(g.at[some]) * per, k) for g, some in tiles]
        for batch in batches:
            parts = {g.v.shape[1]: Rows(batch, g.v.shape[1]) for g in groups}
            for (g, some), best in zip(tiles, bests):
                if len(parts[g.v.shape[1]].ids):
                    _meet(parts[g.v.shape[1]], g, some, same_label, None if windows is None else windows[g.at[some]], best)
        for (g, some), best in zip(tiles, bests):
            place = g.at[some][best.place // per] * per + best.place % per
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(best.id), pa.array(best.score)],
                                             names=["place", "id", "score"])

    order = Window.partitionBy("place").orderBy(F.desc("score"), "id")
    tops = rows.mapInArrow(run, "place bigint, id bigint, score bigint")
    return tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), sent


def _chunk_anchors(chunk: DataFrame) -> tuple[list[Anchors], np.ndarray]:
    """The anchors of a chunk by vector length, and the ids of all (by place)."""
    rows = sorted((r.id, r.label, list(r.v)) for r in chunk.select("id", "label", "v").collect())
    ids = np.array([r[0] for r in rows], np.int64)
    dims = np.array([len(r[2]) for r in rows], np.int64)
    groups = []
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        v = np.array([rows[i][2] for i in at], np.int64).reshape(len(at), dim)
        groups.append(Anchors(at, ids[at], np.array([rows[i][1] for i in at], np.int64), v))
    return groups, ids


def _windows(n: int, positives: list, k: int) -> np.ndarray:
    """Lowest and highest negative score for each positive of each anchor, in whole
    numbers; an empty window where there is no positive."""
    out = np.empty((n, k, 2))
    out[:, :, 0], out[:, :, 1] = np.inf, -np.inf
    for r in positives:
        low, high = -(-LEAST * r.score // 100), MOST * r.score // 100
        out[r.place, r.rank - 1] = low, high
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of
    ``rows`` as made by ``coded`` and stored; ``is_anchor`` is a predicate of ``id``."""
    spark = rows.sparkSession
    schema = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
              "negative_score bigint")
    anchors = stored(rows.where(is_anchor).select("id", "label", "v"), "anchors")
    chunks = max(1, -(-(anchors.agg(F.sum(F.size("v") + 1)).first()[0] or 0) // max(1, CHUNK // 2)))
    path = stage_dir(spark, "hard-negatives")
    for c in range(chunks):
        chunk = anchors.where(F.pmod(F.xxhash64("id", "label", "v"), F.lit(chunks)) == c)
        groups, ids = _chunk_anchors(chunk)
        if not len(ids):
            continue
        tops, sent = search(rows, groups, len(ids), True, positives)
        firsts = tops.collect()  # at most `positives` for each anchor of the chunk
        sent.destroy()
        tops, sent = search(rows, groups, len(ids), False, negatives, _windows(len(ids), firsts, positives))
        known = spark.createDataFrame([(r.place * positives + r.rank - 1, int(ids[r.place]), r.id, r.score) for r in firsts],
                                      "place bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        tops.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(known, "place").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
        sent.destroy()
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op11_hard_negatives(spark, sf_dir):
    relabel = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stored(coded(table(spark, sf_dir, "embeddings"), relabel=relabel), "codes")
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP11_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, r.id, r.label,
         list_dot_product(a.v, r.v)::BIGINT AS score
  FROM e a JOIN e r ON a.id % 100 = 0 AND a.id <> r.id AND len(a.v) = len(r.v)
), p AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score
  FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.anchor_label
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
