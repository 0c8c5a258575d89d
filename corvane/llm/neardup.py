"""Near duplicates: MinHash bands propose, odd sketches filter, full shingle sets confirm.

A document's set holds the 64-bit hashes of its distinct ``SHINGLE``-word runs (all its words as one, if fewer). From
``BANDS`` x ``ROWS`` MinHash samples come band keys, and an odd sketch: ``BITS`` parities that sample i flips at a hash of
(i, value), so that the population count of two sketches' XOR estimates the share of samples that differ.

1. Documents of equal sets fold into the one of smallest id, by counting sums that combine before the shuffle.
2. Each member of a band bucket is compared with the smallest id, the hub, of each of its buckets. Sizes and sketches filter, full sets
   confirm; connected components follow.
3. Buckets whose members are then all in one component are done: no link between them could change it. Members of the others
   are compared across components: those outside of the bucket's largest component, the outsiders, with all members. Buckets of at most ``WIDE``
   members are left as they are. Members of wider ones, which a text that many pages
   share may fill, get finer keys instead, if these take fewer comparisons. Keys are made only where a bucket's members times its outsiders are more than ``COST``
   times its members' shingles, which are to be counted for it, and where no member has more than ``ALIKE`` of the others close by: alike members
   meet in finer keys anyway, in many of them. So the comparisons of any other unlike bucket grow with its members' shingles. Two sets at the
   level must share one of the rarest quarter of their shingles, in any order that is the same for all. The order is by counts of the shingles in these documents, so what many share comes last and makes no key, and
   shingles of one document alone make none either. Sets of 512 shingles or more are thinned by hash to 256 to 512 first, alike for all sets of
   about one size, and a larger share makes keys, so that a link is missed with probability ``THIN_MISS`` at most.
4. Inside the joins the parities of whole sets decide: the population count of their XOR never exceeds the number of shingles
   in one set alone, so no link is lost, and of ``SET_BITS`` parities few are hit twice, so what comes out is links and next to nothing else.
   First members are dealt into groups by a hash, and only pairs within a group are compared, about ``GROWTH`` a member. Where that finds
   more than ``GROWTH`` links a member for its share of the pairs, they are contracted and a sample ``GROWTH`` times as large follows. At
   last all pairs across components are compared, but for settled buckets, in tiles of a block of outsiders and a block of outsiders or of the
   largest component, of about ``TILE`` members each. So the rows that are compared are a bucket's members and outsiders, once each, as long as
   the outsiders fill one block, and each of its outsiders and blocks of members once more at most.

A pair at the level is missed by all bands with probability (1 - level^ROWS)^BANDS, 6e-6 for 0.75, and by its sketches with at
most ``SKETCH_MISS``; above the level both fall fast. Nothing is collected to the driver but counts.

Defined results: null and texts without words have an empty set and stand alone; rows without id stand alone with a null component
and are kept; repeated rows share a component; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ASCII_LOWER, batched, mix, slices, stored
from corvane.sources.records import numbered

SHINGLE = 5
LEVEL = 75  # in hundredths
BANDS, ROWS, BITS = 32, 4, 512
SKETCH_MISS = 1e-6
#: Parities of whole sets, for documents in unsettled buckets.
SET_BITS = 8192
#: Each sample of the pairs in unsettled buckets holds so many times the pairs of the one before.
GROWTH = 16
#: Pairs with one hub that a join takes together; the hub's row is sent as often as it needs more.
TOGETHER = 256
#: Unsettled buckets with more members get finer keys.
WIDE = 64
#: Comparisons that take as long as a shingle's way through the finer keys: 3.2 us a shingle and 0.3 us a comparison on eight cores.
COST = 10
#: Greatest share of a bucket's members that may be close to one of ``TRIED`` of them, if finer keys are made.
ALIKE, TRIED, ALIKE_MISS = 0.5, 4, 1e-3
#: Least size of a thinned set; sets of less than twice as many shingles aren't thinned.
THIN = 256
THIN_MISS = 1e-6
#: Logarithm of the most counters that order the shingles, a byte each when they are sent; fewer than shingles cost time only.
MOST_COUNTERS = 24
#: Members of a bucket in one block; a task compares two blocks at most.
TILE = 4096
#: Logarithm of the most bits of the bitmap of wanted documents: 32 MB.
MOST_BITS = 28

_MULTIPLY = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.Generator(np.random.PCG64(2)).integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def sketch_limit(level: float, samples: int, bits: int, miss: float) -> int:
    """The XOR population count that a pair of similarity ``level`` exceeds with probability ``miss`` at most.

    The differing samples are binomial and each flips two bits; the count of odd bits is taken as normal.
    """
    tails = np.zeros(bits + 1)
    counts = np.arange(bits + 1)
    for d in range(samples + 1):
        log_p = math.lgamma(samples + 1) - math.lgamma(d + 1) - math.lgamma(samples - d + 1) + d * math.log(1 - level) + (samples - d) * math.log(level)
        odd = (1 - (1 - 2 / bits) ** (2 * d)) / 2
        spread = math.sqrt(max(bits * odd * (1 - odd), 1e-9))
        tails += math.exp(log_p) * np.array([0.5 * math.erfc((c + 0.5 - bits * odd) / spread / math.sqrt(2)) for c in counts])
    return int(counts[np.argmax(tails <= miss)])


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    cut = [t.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if t else [] for t in texts]
    coded = pa.array([w for own in cut for w in own], pa.large_binary()).dictionary_encode()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)
    rolling = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            rolling = rolling * _BASE + words[k : k + len(rolling)]
        rolling = mix(rolling)
        out, at = [], 0
        for own in cut:
            n = len(own)
            if n >= SHINGLE:
                out.append(np.unique(rolling[at : at + n - SHINGLE + 1]))
            elif n:
                one = np.full(1, n, np.uint64)
                for w in words[at : at + n]:
                    one = one * _BASE + w
                out.append(mix(one))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def samples(sets: list[np.ndarray], n: int) -> np.ndarray:
    """The first ``n`` MinHash samples of non-empty sets, a row for each set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((len(sets), n), np.uint64)
    buffer = np.empty_like(flat)
    with np.errstate(over="ignore"):
        for i in range(n):
            np.multiply(flat, _MULTIPLY[i], out=buffer)
            np.add(buffer, _ADD[i], out=buffer)
            least[:, i] = np.minimum.reduceat(buffer, starts)
    return least


def odd_sketches(least: np.ndarray, bits: int) -> np.ndarray:
    """The samples folded into ``bits`` parities, as rows of signed 64-bit words."""
    with np.errstate(over="ignore"):
        bit = mix(least + np.arange(least.shape[1], dtype=np.uint64) * _BASE) % np.uint64(bits)
    place = np.arange(len(least))[:, None] * bits + bit.astype(np.int64)
    parity = np.bincount(place.ravel(), minlength=len(least) * bits).reshape(-1, bits) & 1
    return np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free fingerprints, band keys and odd sketches of non-empty sets, as signed 64-bit rows."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = samples(sets, BANDS * ROWS)
    with np.errstate(over="ignore"):
        names = np.column_stack([np.add.reduceat(mix(flat + np.uint64(s)), starts) for s in (11, 29)])
        keys = np.zeros((len(sets), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            keys = mix(keys * _BASE + least[:, r::ROWS])
    return names.view(np.int64), keys.view(np.int64), odd_sketches(least, BITS)


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _n, _k1, _k2, _keys, _sketch) of each row; rows with an empty set have null arrays."""

    def run(batches):
        for part in slices(batches, text_col):
            sets = shingle_sets(part.column(text_col).to_pylist())
            n = np.array([len(s) for s in sets])
            full = np.flatnonzero(n)
            names = np.zeros((len(sets), 2), np.int64)
            keys: list = [None] * len(sets)
            sketches: list = [None] * len(sets)
            if len(full):
                names[full], k, s = signatures([sets[i] for i in full])
                for j, i in enumerate(full.tolist()):
                    keys[i], sketches[i] = k[j], s[j]
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["_id", "_n", "_k1", "_k2", "_keys", "_sketch"],
            )

    return batched(docs.select(id_col, text_col)).mapInArrow(run, "_id long, _n long, _k1 long, _k2 long, _keys array<long>, _sketch array<long>")


def thinning(n: int) -> int:
    """How often sets of ``n`` shingles are halved by hash: to ``THIN`` shingles or a little more, sets of less than twice as many never."""
    return 0 if n < 2 * THIN else (n // THIN).bit_length() - 1


def key_share(size: int, thinned: bool) -> int:
    """How many of the first shingles, in an order that all sets share, must hold one of any other set that reaches the level.

    Of a thinned set of ``size`` the common share is by Hoeffding's bound, with probability ``THIN_MISS``, no smaller than taken here.
    """
    common = -(-LEVEL * size // 100)
    if thinned and size:
        common = max(0, math.ceil(size * (LEVEL / 100 - math.sqrt(-math.log(THIN_MISS / 2) / (2 * size)))))
    return min(size, size - common + 1)


def thinned_tokens(own: np.ndarray) -> list[tuple[bool, np.ndarray]]:
    """The sorted set ``own`` thinned for its own size, and for the next size too if a set at the level may be that large: whether it is
    thinned, and hashes of its shingles and the thinning."""
    out = []
    for k in sorted({thinning(len(own)), thinning(-(-100 * len(own) // LEVEL))}):
        part = own[: np.searchsorted(own, np.uint64(1 << (64 - k)))] if k else own
        with np.errstate(over="ignore"):
            out.append((k > 0, mix(part + np.uint64(k) * _BASE)))
    return out


def _bitmap(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap with a set bit for each id's hash, of at most 2^``MOST_BITS`` bits whatever the number of ids, and its size in bits."""
    wanted = min(1 << MOST_BITS, max(1 << 18, 1 << (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("_id"), F.lit(wanted)) + 1  # both functions count places from 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros(wanted // 8 + 4096, np.uint8)
    for k, own in rows:
        at = (k - 1) * 4096
        bits[at : at + 4096] |= np.frombuffer(own, np.uint8)
    return wanted, bits


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _set array<long>) of the documents that ``ids`` (_id) names, and of a few others.

    Texts aren't shuffled: a bitmap of bounded size says on the spot which texts can be wanted. If there are so many ids that
    the bitmap fills, more sets than needed are made, and the joins that follow leave them out.
    """
    wanted, bits = _bitmap(ids)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        own = sent.value
        for part in slices(batches, text_col):
            place = part.column("_place").to_numpy()
            part = part.filter(pa.array((own[place >> 3] >> (place & 7)) & 1 == 1))
            sets = [s.view(np.int64) for s in shingle_sets(part.column(text_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(sets, pa.list_(pa.int64()))], ["_id", "_set"])

    ident = F.col(id_col).cast("long")
    own = docs.where(ident.isNotNull()).select(ident.alias("_id"), F.pmod(F.xxhash64(ident), F.lit(wanted)).alias("_place"), F.col(text_col))
    return batched(own).mapInArrow(run, "_id long, _set array<long>")


def _close(a: str, b: str, miss: float = SKETCH_MISS) -> Column:
    """Whether sizes and sketches of two rows (aliases a and b) leave the level possible; a pair at it is refused with probability ``miss`` at most."""
    small, large = F.least(f"{a}._n", f"{b}._n"), F.greatest(f"{a}._n", f"{b}._n")
    differing = sum((F.bit_count(F.col(f"{a}._sketch")[i].bitwiseXOR(F.col(f"{b}._sketch")[i])) for i in range(BITS // 64)), F.lit(0))
    return (small * 100 >= large * LEVEL) & (differing <= sketch_limit(LEVEL / 100, BANDS * ROWS, BITS, miss))


def set_parities(sets: DataFrame) -> DataFrame:
    """(_id, _parity array<long>) of full sets (_id, _set): ``SET_BITS`` parities, flipped by each member's hash."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                column = part.column("_set")
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                bit = (mix(column.flatten().to_numpy().view(np.uint64)) % np.uint64(SET_BITS)).astype(np.int64)
                parity = np.bincount(np.repeat(np.arange(len(size)), size) * SET_BITS + bit, minlength=len(size) * SET_BITS) & 1
                words = np.packbits(parity.astype(np.uint8).reshape(-1, SET_BITS), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(list(words), pa.list_(pa.int64()))], ["_id", "_parity"])

    return batched(sets).mapInArrow(run, "_id long, _parity array<long>")


def _reach(a: str, b: str) -> Column:
    """Whether the sets of two rows can reach the level, by their sizes and parities: false only for pairs that don't."""
    each = F.zip_with(f"{a}._parity", f"{b}._parity", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(each, F.lit(0), lambda n, c: n + c) * (100 + LEVEL) <= (F.col(f"{a}._n") + F.col(f"{b}._n")) * (100 - LEVEL)


def fine_keys(full: DataFrame, ids: DataFrame) -> DataFrame:
    """(_id, _key) for the documents of ``ids`` (_id), and perhaps a few others, by their sets in ``full`` (_id, _set): two of
    them that reach the level have a key in common. Each key comes with two documents or more."""
    wanted, bits = _bitmap(ids)
    context = full.sparkSession.sparkContext
    sent = context.broadcast(bits)

    def tokens(batches):
        own = sent.value
        for batch in batches:
            place = batch.column("_place").to_numpy()
            batch = batch.filter(pa.array((own[place >> 3] >> (place & 7)) & 1 == 1))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(i, *x) for i, s in zip(part.column("_id").to_pylist(), part.column("_set"), strict=True) for x in thinned_tokens(np.sort(s.values.to_numpy().view(np.uint64)))]
                columns = pa.array([i for i, _, _ in found], pa.int64()), pa.array([t for _, t, _ in found], pa.bool_()), pa.array([x.view(np.int64) for *_, x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns), ["_id", "_thinned", "_tokens"])

    placed = full.select("_id", "_set", F.pmod(F.xxhash64("_id"), F.lit(wanted)).alias("_place"))
    made = stored(batched(placed).mapInArrow(tokens, "_id long, _thinned boolean, _tokens array<long>"))
    total = made.agg(F.sum(F.size("_tokens"))).first()[0] or 0
    counters = 1 << min(MOST_COUNTERS, max(16, (2 * total).bit_length()))
    counts = made.select(F.explode("_tokens").alias("_t")).groupBy(F.col("_t").bitwiseAND(counters - 1).cast("int").alias("_slot")).agg(F.count(F.lit(1)).alias("_n"))
    # Counts by quarters of a doubling; 0 stands for a shingle of one document.
    counts = counts.where("_n > 1").select("_slot", F.least(F.lit(127), F.floor(F.log2("_n") * 4)).cast("byte").alias("_rank")).toArrow()
    rank = np.zeros(counters, np.int8)
    rank[counts.column("_slot").to_numpy()] = counts.column("_rank").to_numpy()
    ranks = context.broadcast(rank)

    def keys(batches):
        rank = ranks.value
        for batch in batches:
            ids, out = [], [np.zeros(0, np.int64)]
            for i, thinned, own in zip(batch.column("_id").to_pylist(), batch.column("_thinned").to_pylist(), batch.column("_tokens"), strict=True):
                own = own.values.to_numpy()
                r = rank[own & (len(rank) - 1)]
                first = np.lexsort((own, r))[: key_share(len(own), thinned)]
                out.append(own[first[r[first] > 0]])
                ids.append(np.full(len(out[-1]), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*ids, out[0]])), pa.array(np.concatenate(out))], ["_id", "_key"])

    own = stored(batched(made).mapInArrow(keys, "_id long, _key long"))
    several = own.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_key")
    return own.join(several, "_key").select("_id", "_key")


def _shares(widest: int) -> list[float]:
    """The shares of pairs in the samples, and 1: the first one holds ``GROWTH`` pairs a member of the widest bucket at most."""
    rounds = max(math.ceil(math.log(max(widest, 1), GROWTH) - 1e-9) - 1, 0)
    return [float(GROWTH) ** -k for k in range(rounds, -1, -1)]


def _on_hubs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...), which are stored, joined with ``rows`` (b, ...). A hub b of many pairs has several salts, and its row comes
    with each of them, so that no task gets all pairs of a hub."""
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > TOGETHER).select("b", F.ceil(F.col("_n") / TOGETHER).cast("int").alias("_parts"))
    many = stored(many)
    parts = F.coalesce("_parts", F.lit(1))
    salted = pairs.join(many, "b", "left").withColumn("_salt", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("_parts")
    spread = rows.join(many, "b", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(spread, ["b", "_salt"]).drop("_salt")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) among ``pairs``, which are stored, whose full sets (_id, _set) reach the level."""
    met = _on_hubs(pairs, sets.select(F.col("_id").alias("b"), F.col("_set").alias("_sb")))
    both = met.join(sets.select(F.col("_id").alias("a"), F.col("_set").alias("_sa")), "a").withColumn("_common", F.size(F.array_intersect("_sa", "_sb")))
    union = F.size("_sa") + F.size("_sb") - F.col("_common")
    return both.where(F.col("_common") * 100 >= union * LEVEL).select("a", "b")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end of ``edges`` (a > b) has one smaller end, which is no larger end itself."""
    ends = edges.select(F.col("a").alias("v"), "b").unionByName(edges.select(F.col("b").alias("v"), F.lit(None).cast("long").alias("b")))
    node = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.count("b").alias("up"), F.min("b").alias("low"), F.max("b").alias("high"))
    odd = (F.col("up") > 0) & ((F.col("up") < F.col("n")) | (F.col("low") < F.col("high")))
    return not node.agg(F.max(odd)).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(_id, _component) of all ends of ``edges`` (a, b): the smallest id reachable.

    Alternates large-star and small-star steps until the edges are stars; every step shuffles the edges only.
    """
    now = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("_m")), "a")
        small = small.select("a", F.col("_m").alias("b")).unionByName(small.where("b != _m").select(F.col("b").alias("a"), F.col("_m").alias("b")))
        now = stored(small.where("a != b").distinct())
    return now.select(F.col("a").alias("_id"), F.col("b").alias("_component")).unionByName(now.select(F.col("b").alias("_id"), F.col("b").alias("_component")).distinct())


def _rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def _parted(rows: DataFrame) -> DataFrame:
    """(_key, _main, _inner, _outer) of those buckets of ``rows`` (_key, _component) that hold several components: the one of most members,
    how many these are, and how many the outsiders."""
    each = rows.groupBy("_key", "_component").agg(F.count(F.lit(1)).alias("_m"))
    buckets = each.groupBy("_key").agg(F.max(F.struct("_m", "_component")).alias("_most"), F.sum("_m").alias("_c")).where("_c > _most._m")
    return stored(buckets.select("_key", F.col("_most._component").alias("_main"), F.col("_most._m").alias("_inner"), (F.col("_c") - F.col("_most._m")).alias("_outer")))


def _unsettled(rest: DataFrame, label: DataFrame) -> DataFrame:
    """Of ``rest`` (_key, _band, _id) the rows in buckets of several components, with their component, whether they are outsiders (_out), and
    the bucket's _inner and _outer."""
    now = stored(rest.join(label, "_id", "left").withColumn("_component", F.coalesce("_component", "_id")))
    return stored(now.join(_parted(now), "_key").withColumn("_out", F.col("_component") != F.col("_main")).drop("_main"))


def _tiles(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outsiders of ``now`` and all its rows, by tiles (_row, _column) of a block of outsiders and a block of outsiders or of the largest component."""
    inner, outer = (F.ceil(F.col(c) / TILE).cast("int") for c in ("_inner", "_outer"))
    block = F.pmod(F.xxhash64("_id"), F.when(F.col("_out"), outer).otherwise(inner)).cast("int")
    x = now.where("_out").withColumns({"_row": block, "_column": F.explode(F.sequence(F.lit(0), inner + outer - 1))})
    y = now.withColumns({"_row": F.explode(F.sequence(F.lit(0), outer - 1)), "_column": block + F.when(F.col("_out"), inner).otherwise(0)})
    return x, y


def _contracted(rest: DataFrame, own: DataFrame, members: int, full: DataFrame, label: DataFrame) -> DataFrame:
    """``label`` (_id, _component) once all links between different components in the buckets of ``rest`` (_key, _band, _id) are
    contracted; the band of finer keys is -1. ``own`` has (_id, _n, _sketch, _keys, _parity)."""
    # A pair comes out of the first of its common bands alone, and out of any of its finer keys.
    once = (F.col("x._band") < 0) | (F.array_position(F.zip_with("x._keys", "y._keys", lambda p, q: p == q), True) == F.col("x._band") + 1)
    ends = F.greatest("x._id", "y._id").alias("a"), F.least("x._id", "y._id").alias("b")

    def links(outsiders: DataFrame, all_rows: DataFrame, by: list[str]) -> DataFrame:
        x, y = (rows.select("_key", "_band", "_id", "_component", "_out", *by).join(own, "_id").alias(name) for rows, name in ((outsiders, "x"), (all_rows, "y")))
        across = ~F.col("y._out") | (F.col("x._component") < F.col("y._component"))
        for c in ["_key", *by]:
            across = across & (F.col(f"x.{c}") == F.col(f"y.{c}"))
        return stored(x.join(y, across & _close("x", "y") & once & _reach("x", "y")).select(*ends).distinct())

    def added(pairs: DataFrame) -> DataFrame:
        return components(_confirmed(pairs, full).unionByName(label.select(F.col("_id").alias("a"), F.col("_component").alias("b"))))

    now = _unsettled(rest, label)
    *samples, _ = _shares(now.agg(F.max("_outer")).first()[0] or 0)
    for share in samples:
        dealt = now.withColumn("_group", F.pmod(F.xxhash64(F.lit(share), "_id"), F.lit(round(1 / share))))
        # Groups of one component have nothing to compare.
        several = dealt.groupBy("_key", "_group").agg(F.min("_component").alias("_low"), F.max("_component").alias("_high")).where("_low < _high")
        dealt = dealt.join(stored(several.select("_key", "_group")), ["_key", "_group"])
        found = links(dealt.where("_out"), dealt, ["_group"])
        n = _rows(found)
        if n:
            label = added(found)
            now = _unsettled(rest, label)
        if n <= share * GROWTH * members:
            break
    found = links(*_tiles(now), ["_row", "_column"])
    return added(found) if _rows(found) else label


def _unlike(wide: DataFrame, near: DataFrame) -> DataFrame:
    """The (_key) of ``wide`` (_key, _id) where of ``TRIED`` members none has more than ``ALIKE`` of the bucket close by, by sizes and
    sketches in ``near`` (_id, _n, _sketch): ``TRIED`` comparisons a member, whatever the size of a bucket."""
    tried = [F.min_by("_id", F.xxhash64(F.lit(k), "_id")) for k in range(TRIED)]
    some = wide.groupBy("_key").agg(F.array_distinct(F.array(*tried)).alias("_tried"))
    pairs = stored(wide.join(some, "_key").select("_key", F.col("_id").alias("a"), F.explode("_tried").alias("b")))
    met = _on_hubs(pairs, near.select(F.col("_id").alias("b"), F.struct("_n", "_sketch").alias("y")))
    met = met.join(near.select(F.col("_id").alias("a"), F.struct("_n", "_sketch").alias("x")), "a")
    shares = met.groupBy("_key", "b").agg(F.avg(_close("x", "y", ALIKE_MISS).cast("int")).alias("_share"))
    return shares.groupBy("_key").agg(F.max("_share").alias("_share")).where(F.col("_share") <= ALIKE).select("_key")


def finer(rest: DataFrame, full: DataFrame, near: DataFrame) -> DataFrame:
    """(_key, _band, _id) of ``rest`` (_key, _band, _id, _n, _c, _outer), with finer keys, of band -1, in place of those buckets of more than
    ``WIDE`` members in which they take fewer comparisons, so that all together never take more than the buckets do. ``near`` has (_id, _n, _sketch).

    A bucket is replaced as a whole: all its members get their finer keys, or none does for its sake.
    """
    wide = rest.where(F.col("_c") > WIDE)
    pairs = F.col("_c") * F.col("_outer")
    costly = wide.groupBy("_key").agg(F.first("_c").alias("_c"), F.first("_outer").alias("_outer"), F.sum("_n").alias("_n")).where(pairs > F.col("_n") * COST)
    wide = stored(wide.select("_key", "_id", "_c", "_outer").join(costly.select("_key"), "_key"))
    if not wide.isEmpty():
        wide = stored(wide.join(_unlike(wide, near), "_key"))
    if wide.isEmpty():
        return rest.select("_key", "_band", "_id")
    fine = stored(fine_keys(full, wide.select("_id").distinct()))
    met = fine.join(fine.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")), "_key").groupBy("_id").agg(F.sum("_c").alias("_met"))
    costs = wide.join(met, "_id", "left").groupBy("_key").agg(F.sum("_met").alias("_met"), F.first("_c").alias("_c"), F.first("_outer").alias("_outer"))
    replaced = stored(costs.where(F.coalesce("_met", F.lit(0)) < pairs).select("_key"))
    ids = wide.join(replaced, "_key", "left_semi").select("_id").distinct()
    kept = rest.join(replaced, "_key", "left_anti").select("_key", "_band", "_id")
    return stored(kept.unionByName(fine.join(ids, "_id", "left_semi").select("_key", F.lit(-1).alias("_band"), "_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row. Ids are whole numbers."""
    own = stored(features(docs, id_col, text_col))
    sets = stored(own.where("_n > 0 and _id is not null").groupBy("_k1", "_k2", "_n").agg(F.min("_id").alias("_rep")))
    whole = own.join(sets.select(F.col("_rep").alias("_id")).distinct(), "_id", "left_semi").where("_n > 0")
    reps = whole.select("_id", "_n", "_sketch")
    band = whole.select("_id", "_n", F.posexplode("_keys").alias("_band", "_key"))
    shared = stored(band.groupBy("_key").agg(F.min("_id").alias("_hub"), F.max("_id").alias("_last")).where("_hub < _last").select("_key", "_hub"))
    # Members of the buckets that hold two documents or more, with the bucket's smallest id.
    members = stored(band.join(shared, "_key"))

    none = own.sparkSession.createDataFrame([], "_id long, _component long")

    # Each member with the hub of each of its buckets: few different ones in a group of near copies, and never more than bands.
    hubs = stored(members.where("_id != _hub").select(F.col("_id").alias("a"), F.col("_hub").alias("b")).distinct())
    met = _on_hubs(hubs, reps.select(F.col("_id").alias("b"), F.struct("_n", "_sketch").alias("y")))
    near = stored(met.join(reps.select(F.col("_id").alias("a"), F.struct("_n", "_sketch").alias("x")), "a").where(_close("x", "y")).select("a", "b"))
    label = none
    if _rows(near):
        ids = near.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
        label = components(_confirmed(near, stored(full_sets(docs, ids, id_col, text_col))))

    # What is left: buckets of three or more whose members aren't in one component.
    now = stored(members.join(label, "_id", "left").select("_key", "_band", "_id", "_n", "_hub", F.coalesce("_component", "_id").alias("_component")))
    parted = _parted(now).select("_key", (F.col("_inner") + F.col("_outer")).alias("_c"), "_outer").where("_c > 2")
    rest = stored(now.where("_id != _hub").join(parted, "_key").select("_key", "_band", "_id", "_n", "_c", "_outer"))
    apart = stored(rest.select("_id").distinct())
    if _rows(apart):
        full = stored(full_sets(docs, apart, id_col, text_col))
        each = stored(whole.select("_id", "_n", "_sketch", "_keys").join(apart, "_id").join(set_parities(full), "_id"))
        fine = finer(rest, full, each.select("_id", "_n", "_sketch"))
        label = _contracted(fine, each, _rows(apart), full, label)

    by_set = sets.join(label.withColumnRenamed("_id", "_rep"), "_rep", "left").select("_k1", "_k2", "_n", F.coalesce("_component", "_rep").alias("_c"))
    out = own.select("_id", "_k1", "_k2", "_n").join(by_set, ["_k1", "_k2", "_n"], "left")
    component = F.when(F.col("_n") > 0, F.when(F.col("_id").isNotNull(), F.col("_c"))).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept")
    )


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their component; one row of each id and text.

    Rows without id all stay, for they stand alone. Where ids repeat, each text of an id is a document of its own: ids and texts are
    numbered in the order of the ids, and the numbers take the ids' place. Of several rows of one id and text the one stays whose
    columns have the smallest hash; where those are equal too, so are the rows. Texts are shuffled once, where no id repeats.
    """
    named = docs.where(F.col(id_col).isNotNull())
    if named.groupBy(id_col).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").isEmpty():
        kept = near_duplicates(docs, id_col, text_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(id_col)
        return named.join(kept, id_col, "left_semi").select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
    each = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    content = F.xxhash64(text_col, F.lit(0)).alias("_c0"), F.xxhash64(F.lit(1), text_col).alias("_c1")
    one = named.groupBy(F.col(id_col).alias("_i"), *content).agg(F.min_by(each, F.xxhash64(F.to_json(each))).alias("_row"))
    one = stored(one)
    keys = numbered(one.select(F.struct("_i", "_c0", "_c1").alias("_key")), "_key", "_number").select("_key._i", "_key._c0", "_key._c1", "_number")
    single = stored(one.join(keys, ["_i", "_c0", "_c1"]).select("_number", "_row"))
    kept = near_duplicates(single.select("_number", F.col(f"_row.`{text_col}`").alias("_text")), "_number", "_text").where("kept").select("_number")
    return single.join(kept, "_number", "left_semi").select("_row.*").select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


#: The same rows by joining all shingles; ids must be unique.
SQL = rf"""
WITH RECURSIVE letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x20\x09-\x0D]+') AS w FROM documents, letters),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {LEVEL} * (x.n + y.n - c)),
linked AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS least FROM documents UNION SELECT linked.b, r.least FROM r JOIN linked ON linked.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.least AS component_id, m.least = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(least) AS least FROM r GROUP BY 1) m ON m.id = d.doc_id
"""
