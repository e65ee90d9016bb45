r"""Similarity join on word n-grams: rare-first prefix filtering.

Two documents link when their sets of distinct n-word shingles reach a Jaccard
similarity of ``percent`` / 100.  All documents order their shingles alike, rare
ones first; then two similar documents share a shingle among the first few of
each (the probing prefix of the larger one, the shorter indexing prefix of the
smaller one).  Documents are joined on those shingles, and a pair must pass

* the length filter: the smaller set has at least ``percent`` % of the larger;
* the positional filter: what the places of the shared shingle leave is enough;
* the suffix filter: both sets are partitioned alike by hash into ``PARTS`` parts.  A
  part whose sizes are odd in one set and even in the other holds an unshared shingle, so
  the number of such parts bounds the unshared shingles; an entry carries one bit a part.
  Near copies that do not link share most prefixes, and nearly all of their pairs end here,
  in the join.  Pairs left after it pass the filter by the differences in size themselves;

before the sets themselves are compared, once per pair.

Order.  Counting every shingle exactly would shuffle more than the texts.  A
sketch counts them by hash instead, with about ``PER_COUNTER`` shingles per
counter over all documents, at most ``2 ** MOST_BITS`` counters: this bounds what
is sent to the executors at 64 MiB.  Any order common to all documents gives the
same links; a coarser one only gives more candidates.

Copies.  Documents with equal sets (by a 128-bit digest of the set) are one node.
Texts that are almost equal come in groups of thousands too, and all pairs of a
group would be quadratic.  So first each bucket (documents that share a prefix
shingle) ties its members to one member drawn by hash; what they verify is merged
into components, and this is repeated while it helps.  At the end only pairs in
different components are joined, which loses no component.

Defined results: null counts as empty; a text without words has no shingles and
links with nothing (its component is itself); a text of fewer than n words has its
whole sequence as only shingle; rows with the same id are one node; a null id links
with nothing and has a null component; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import hot_keys, join_hot, map_slices, slices, small_batches, stored, table, text_of
from lotwise.llm.components import components

#: A multiple of 64.
PARTS = 512
PER_COUNTER = 32
LEAST_BITS, MOST_BITS = 12, 26
CHUNK_BITS = 16
#: Earlier shared shingles that an entry carries, to meet a pair at its first one.
EARLIER = 8
LEADER_ROUNDS = 4
#: Ids whose texts are fetched by a sent table; more are joined.
SENT_IDS = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CUT = re.compile(rb"[\x20\x09-\x0D]")


# --- shingles -----------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A prime field and two numbers of it, drawn at random once: a word is hashed by its
#: polynomial at both.  (Modulo a power of two there are words that collide at every number.)
PRIME = (1 << 31) - 1
POINTS = (1_327_217_884, 402_653_189)
#: Powers of the points and of their inverses, as far as needed.
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64) for _ in range(4)]
#: Bytes of text hashed at once; a cut falls on a blank.
HASHED_BYTES = 1 << 20


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((*POINTS, *(pow(p, -1, PRIME) for p in POINTS))):
            known = _POWERS[i]
            while len(known) < n:
                known = np.concatenate([known, known * np.uint64(pow(base, len(known), PRIME)) % np.uint64(PRIME)])
            _POWERS[i] = known
    return _POWERS


def _word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word: the word's parts of two running polynomial
    sums over the bytes, shifted back to the word's start, and its length, mixed."""
    x = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(x) + 2, bool)
    inside[1:-1] = ~_BLANK[x]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, prime, letters = _powers(len(x) + 1), np.uint64(PRIME), x + np.uint64(1)
    h = (ends - starts).astype(np.uint64) * _MIX
    sums = np.zeros(len(x) + 1, np.uint64)
    for point in (0, 1):
        term = letters * powers[point][:len(x)]
        # Not quite reduced: under 2 ** 31 + 2 ** 9, so a million of them stay under 2 ** 52.
        np.cumsum((term & prime) + (term >> np.uint64(31)), out=sums[1:])
        h ^= ((sums[ends] - sums[starts]) % prime * powers[2 + point][starts] % prime) << np.uint64(31 * point)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles: A-Z are
    lower-cased and words split at the six ASCII blanks, both on bytes."""
    data = text.encode("utf-8", "surrogatepass").lower()
    if len(data) <= HASHED_BYTES:
        hashes = _word_hashes(data)
    else:
        parts, at = [], 0
        while at < len(data):
            m = _CUT.search(data, at + HASHED_BYTES)
            end = m.start() if m else len(data)
            parts.append(_word_hashes(data[at:end]))
            at = end
        hashes = np.concatenate(parts)
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    count = len(hashes) - n + 1
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out ^= hashes[i:i + count]
        out *= _MIX
        out ^= out >> np.uint64(29)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def needed(a, b, percent: int):
    """Shared shingles that sets of a and b shingles need to link."""
    return -((-percent * (a + b)) // (100 + percent))


def probe_length(n, percent: int):
    return n - -((-percent * n) // 100) + 1


def index_length(n, percent: int):
    return n - needed(n, n, percent) + 1


# --- first reading: sets as digests, and the sketch -----------------------------

def _first_reading(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows (id, n_shingles, digest) of documents, and at the end of each task
    rows (chunk, counts) of its sketch."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, n_shingles bigint, digest binary, chunk int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One byte each, which stays at its most: frequent shingles need no order among them.
        counters = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for ids, texts in slices(batch):
                sizes, digests = [], []
                for t in texts:
                    s = shingles(t, n)
                    at = s >> np.uint64(64 - bits)  # a text that hits a counter twice adds one
                    counters[at] = np.minimum(counters[at], 254) + 1
                    sizes.append(len(s))
                    digests.append(blake2b(s.tobytes(), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array(sizes, pa.int64()),
                     pa.array(digests, pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())],
                    names=["_id", "n_shingles", "digest", "chunk", "counts"])
        width = 1 << min(bits, CHUNK_BITS)
        for k in range(len(counters) // width):
            part = counters[k * width:(k + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, batch.schema.field(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                     pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                    names=["_id", "n_shingles", "digest", "chunk", "counts"])

    return docs.mapInArrow(run, schema)


def _sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """The counters of all documents as one byte each, on a scale of logarithms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0), batch.column(1)):
                part = np.frombuffer(zlib.decompress(counts.as_py()), np.uint8).astype(np.uint32)
                k = k.as_py()
                sums[k] = sums[k] + part if k in sums else part
        for k, part in sums.items():
            scaled = np.minimum(255, np.round(8 * np.log2(1 + part.astype(np.float64)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([scaled.tobytes()], pa.binary())],
                                             names=["chunk", "counts"])

    width = 1 << min(bits, CHUNK_BITS)
    parts = rows.where("chunk is not null").select("chunk", "counts").repartition("chunk")
    out = np.zeros(1 << bits, np.uint8)
    for r in parts.mapInArrow(run, "chunk int, counts binary").collect():  # 2 ** bits bytes in all
        out[r.chunk * width:(r.chunk + 1) * width] = np.frombuffer(r.counts, np.uint8)
    return out


# --- second reading: prefixes ---------------------------------------------------

def _prefixes(docs: DataFrame, n: int, percent: int, sketch: np.ndarray, bits: int) -> DataFrame:
    """_id, n, odd (whether the sizes of the parts of the set are odd, 64 to a number), fine (those
    sizes, at most 255 each) and prefix (the rarest shingles in order)."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def per_slice(ids, texts):
        sizes, odd, fine, prefixes = [], [], [], []
        for t in texts:
            s = shingles(t, n)
            sizes.append(len(s))
            held = np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
            fine.append(np.minimum(held, 255).astype(np.int16))
            odd.append(np.packbits((held & 1).astype(np.uint8)).view(np.int64))
            if len(s):
                order = np.argsort(sent.value[s >> np.uint64(64 - bits)], kind="stable")  # ties by hash
                prefixes.append(s[order[:probe_length(len(s), percent)]].view(np.int64))
            else:
                prefixes.append([])
        return ids, sizes, odd, fine, prefixes

    id_type = docs.schema["_id"].dataType.simpleString()
    return map_slices(docs, per_slice, f"_id {id_type}, n bigint, odd array<bigint>, fine array<smallint>, prefix array<bigint>")


def _entries(shared: DataFrame) -> DataFrame:
    """One row per document and shared prefix shingle, with up to EARLIER shared
    shingles before it."""
    return shared.select("id", "n", "odd", F.posexplode("shared").alias("_i", "_s"), "shared").select(
        F.col("_s.h").alias("h"), "id", "n", F.col("_s.pos").alias("pos"), "odd",
        F.transform(F.slice("shared", F.greatest(F.lit(1), F.col("_i") - EARLIER + 1), F.least(F.lit(EARLIER), F.col("_i"))),
                    lambda x: x["h"]).alias("earlier"))


def _need(total: Column, percent: int) -> Column:
    return F.ceil((total * percent) / F.lit(100.0 + percent) - 1e-6)


def _unshared(x: Column, y: Column) -> Column:
    """A lower bound of the shingles that two sets do not share, from their parts."""
    apart = F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int")))
    return F.aggregate(apart, F.lit(0), lambda s, v: s + v)


def _oddly_unshared(x: Column, y: Column) -> Column:
    """The same from the parts of odd size."""
    out = F.lit(0)
    for i in range(PARTS // 64):
        out = out + F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i)))
    return out


def _may_link(x: str, y: str, percent: int) -> Column:
    """The length, positional and suffix filters for x, the smaller or first, and
    y, met at a shared shingle."""
    c = lambda side, name: F.col(f"{side}.{name}")
    nx, ny, px, py = c(x, "n"), c(y, "n"), c(x, "pos"), c(y, "pos")
    total = nx + ny
    need = _need(total, percent)
    return (
        (nx * 100 >= ny * percent)
        & (px <= nx - F.ceil((nx * (2 * percent)) / F.lit(100.0 + percent) - 1e-6))
        & (F.least(px, py) + 1 + F.least(nx - px - 1, ny - py - 1) >= need)
        & (_oddly_unshared(c(x, "odd"), c(y, "odd")) <= total - 2 * need)
    )


def _first(x: str, y: str) -> Column:
    return (F.col(f"{x}.n") < F.col(f"{y}.n")) | ((F.col(f"{x}.n") == F.col(f"{y}.n")) & (F.col(f"{x}.id") < F.col(f"{y}.id")))


# --- verification ---------------------------------------------------------------

def _verified(docs: DataFrame, fine: DataFrame, pairs: DataFrame, n: int, percent: int,
              done: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) that link: those that pass the fine suffix filter and were not
    compared before (``done``, to which they are added), their whole sets compared."""
    pairs = pairs.select("a", "b").distinct()
    for before in done:
        pairs = pairs.join(before, ["a", "b"], "left_anti")
    pairs = (
        pairs
        .join(fine.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa")), "a")
        .join(fine.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb")), "b")
    )
    total = F.col("na") + F.col("nb")
    pairs = pairs.where(_unshared(F.col("fa"), F.col("fb")) <= total - 2 * _need(total, percent))
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    done.append(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    few = pairs.count() <= SENT_IDS // 2
    chosen = docs.join(F.broadcast(ids) if few else ids, "_id", "left_semi")
    id_type = docs.schema["_id"].dataType.simpleString()
    sets = map_slices(chosen, lambda ids, texts: (ids, [shingles(t, n).tobytes() for t in texts]),
                      f"_id {id_type}, s binary")
    sets = stored(sets.distinct(), "sets")
    both = (
        pairs.join(sets.select(F.col("_id").alias("a"), F.col("s").alias("x")), "a")
        .join(sets.select(F.col("_id").alias("b"), F.col("s").alias("y")), "b").select("a", "x", "y", "b")
    )

    def per_slice(a, xs, ys, b):
        kept = []
        for i, (x, y) in enumerate(zip(xs, ys)):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(np.intersect1d(p, q, assume_unique=True)) >= needed(len(p), len(q), percent):
                kept.append(i)
        return [a[i] for i in kept], [b[i] for i in kept]

    return stored(map_slices(both, per_slice, f"a {id_type}, b {id_type}"), "verified")


# --- the join -------------------------------------------------------------------

def _merged(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return stored(components(out, "a", "b"), "components")


def similar_groups(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles and component_id (the smallest id
    reachable by links, itself included)."""
    docs = docs.select(F.col(id_col).alias("_id"), text_of(F.col(text_col)).alias("_text"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size / 6 / PER_COUNTER)))))
    read = stored(_first_reading(docs, n, bits), "first-reading")
    rows = read.where("chunk is null").select("_id", "n_shingles", "digest")
    sets = rows.where("n_shingles > 0 and _id is not null")
    reps = stored(sets.groupBy("digest").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "digests")
    many = hot_keys(reps, "rows")
    # The set without shingles has no node: no key, so no join.
    keyed = rows.withColumn("digest", F.when(F.col("n_shingles") > 0, F.col("digest")))
    member = join_hot(keyed, reps.select("digest", "rep"), "digest", many.select("digest"))
    member = stored(member.select("_id", "n_shingles", "rep"), "members")

    prefixes = _prefixes(docs.where("_id is not null"), n, percent, _sketch(read, bits), bits)
    nodes = prefixes.join(member.select(F.col("rep").alias("_id")).distinct(), "_id", "left_semi")
    nodes = nodes.select(F.col("_id").alias("id"), F.xxhash64("n", "prefix").alias("d"), "n", "odd", "fine",
                         "prefix")
    nodes = stored(nodes, "prefixes")
    entries = nodes.select("id", "d", F.posexplode("prefix").alias("pos", "h"))
    buckets = entries.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    shared = (
        entries.join(buckets, "h").groupBy("id", "d").agg(F.sort_array(F.collect_set(F.struct("pos", "h"))).alias("shared"))
        .join(nodes.select("id", "d", "n", "odd").dropDuplicates(["id", "d"]), ["id", "d"])
    )
    shared = stored(shared, "shared")

    # Sets of rows with the same id are one node.
    twice = member.where("rep is not null").groupBy("_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_b")).where("a < _b")
    links = [stored(member.join(twice, "_id").select("a", F.col("rep").alias("b")), "same-id")]
    own, last, done = None, None, []
    for k in range(LEADER_ROUNDS):
        found = _led(shared, own, percent, k)
        links.append(_verified(docs, nodes, found, n, percent, done))
        own = _merged(links)
        cross = _cross_bound(shared, own)
        if not cross or (last is not None and cross > 0.8 * last):
            break
        last = cross
    links.append(_verified(docs, nodes, _crossing(shared, own, percent), n, percent, done))
    own = _merged(links)
    named = own.select(F.col("id").alias("rep"), "component")
    return (
        join_hot(member, named, "rep", many.select("rep"))
        .select(F.col("_id").alias(id_col), "n_shingles", F.when(F.col("_id").isNotNull(), F.coalesce("component", "rep", "_id")).alias("component_id"))
    )


def _with_component(shared: DataFrame, own: DataFrame | None) -> DataFrame:
    if own is None:
        return shared.withColumn("c", F.col("id"))
    return shared.join(own, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _mixed(entries: DataFrame) -> DataFrame:
    """The buckets that hold more than one component."""
    return entries.groupBy("h").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo < _hi").select("h")


def _slim(shared: DataFrame, own: DataFrame | None) -> DataFrame:
    return _with_component(shared, own).select("id", "c", F.explode("shared.h").alias("h"))


def _cross_bound(shared: DataFrame, own: DataFrame) -> int:
    """Pairs of entries in one bucket but different components."""
    per = _slim(shared, own).groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("h").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"))
    return int(per.agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0] or 0)


def _full(shared: DataFrame, own: DataFrame | None) -> DataFrame:
    entries = _entries(shared)
    if own is None:
        return entries.withColumn("c", F.col("id"))
    return entries.join(own, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _led(shared: DataFrame, own: DataFrame | None, percent: int, k: int) -> DataFrame:
    """Pairs of each bucket's leader of round k with the members of other components."""
    entries = _full(shared, own)
    if own is not None:
        entries = entries.join(_mixed(_slim(shared, own)), "h", "left_semi")
    draw = F.xxhash64("id", "h", F.lit(k))
    leaders = entries.groupBy("h").agg(F.min_by(F.struct("id", "n", "pos", "odd", "c"), F.struct(draw, "id")).alias("l"))
    leaders = leaders.select(F.col("h").alias("lh"), "l.*")
    x, y = entries.alias("x"), leaders.alias("y")
    met = F.when(_first("x", "y"), _may_link("x", "y", percent)).otherwise(_may_link("y", "x", percent))
    return x.join(y, (F.col("x.h") == F.col("y.lh")) & (F.col("x.c") != F.col("y.c")) & met).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _crossing(shared: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that pass the filters, each met at its
    first shared shingle as far as the entries tell."""
    entries = _full(shared, own).join(_mixed(_slim(shared, own)), "h", "left_semi")
    x, y = entries.alias("x"), entries.alias("y")
    return x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & _first("x", "y")
                  & ~F.arrays_overlap("x.earlier", "y.earlier") & _may_link("x", "y", percent)).select(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The documents without those that are linked, over any chain, to one with a
    smaller id; all columns stay.  Rows with a null id stay."""
    groups = similar_groups(docs, n, percent, id_col, text_col)
    gone = groups.where(F.col(id_col) > F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op9_ngram_join(spark, sf_dir):
    return similar_groups(table(spark, sf_dir, "documents"))
