"""SimHash near pairs and the greedy similarity gate."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import hamming
from corvane.operators.materialise import stored

BITS = 64


def band(h: Column, i: int, width: int) -> Column:
    return F.shiftrightunsigned(h, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _block(h: Column, low: int, high: int) -> Column:
    """Bits ``low`` to ``high`` - 1."""
    return F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))


def _edges(bits: int, blocks: int) -> list[tuple[int, int]]:
    ends = [bits * i // blocks for i in range(blocks + 1)]
    return list(zip(ends, ends[1:], strict=False))


def _large(df: DataFrame) -> DataFrame:
    """``df`` for joins that shuffle and sort. Hashes and their links are so small in a file that Spark would take them for a table to broadcast,
    and the keys made of them, which are ten times as many, would all pass through the driver."""
    return df.hint("merge")


def block_keys(h: Column, threshold: int) -> Column:
    """Keys of which two hashes within ``threshold`` share one at least: a hash of each pair of ``threshold`` + 2 blocks of bits."""
    parts = _edges(BITS, threshold + 2)
    return F.array(*(F.xxhash64(F.lit(n), *(_block(h, *parts[i]) for i in c)) for n, c in enumerate(combinations(range(len(parts)), 2))))


def near_values(values: DataFrame, threshold: int, mode: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(x, y) of the distinct hashes ``values`` (_h) at a distance of 1 to ``threshold``, x < y; with ``by``, of those that agree in these columns, which come out too.

    ``threshold`` + 2 blocks leave two of them equal in every such pair, so pairs of blocks are keys: 26 bits of 64 for a threshold
    of 3. A pair comes out of its first two equal blocks alone, so no distinct follows. In ``compat`` mode the top 16 bits must be equal and
    are part of each key, beside one of ``threshold`` + 1 blocks of the others.
    """
    if mode == "compat":
        parts, top, equal = _edges(48, threshold + 1), [F.shiftrightunsigned("_h", 48)], 1
    else:
        parts, top, equal = _edges(BITS, threshold + 2), [], 2
    chosen = list(combinations(range(len(parts)), equal))
    blocks = F.array(*(_block(F.col("_h"), *p) for p in parts))
    keys = F.array(*(F.xxhash64(F.lit(n), *by, *top, *(_block(F.col("_h"), *parts[i]) for i in c)) for n, c in enumerate(chosen)))
    keyed = values.select(*by, "_h", blocks.alias("_blocks"), F.posexplode(keys).alias("_n", "_key"))
    a, b = _large(keyed.alias("a")), keyed.alias("b")
    agree = F.zip_with("a._blocks", "b._blocks", lambda p, q: p == q)
    first = F.slice(F.filter(F.transform(agree, lambda same, i: F.when(same, i)), lambda i: i.isNotNull()), 1, equal)
    of_key = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in chosen)), F.col("a._n") + 1)
    on = (F.col("a._key") == F.col("b._key")) & (F.col("a._h") < F.col("b._h")) & (hamming(F.col("a._h"), F.col("b._h")) <= threshold) & (first == of_key)
    if mode == "compat":
        on = on & (F.shiftrightunsigned("a._h", 48) == F.shiftrightunsigned("b._h", 48))
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on).select(*(f"a.{c}" for c in by), F.col("a._h").alias("x"), F.col("b._h").alias("y"))


def near_pairs(hashed: DataFrame, threshold: int = 3, mode: str = "compat", id_col: str = "doc_id", hash_col: str = "h", first: int | None = None) -> DataFrame:
    """(id_i, id_j, distance) with id_i < id_j and a distance of at most ``threshold``.

    ``compat`` compares within buckets of the top 16 bits and misses pairs that differ there. ``exact`` finds all. Equal hashes fold
    before the join, and the hashes are computed once and stored. Ids are spread out after it, since the result is of pairs of
    ids; with ``first`` no more than the ``first`` + 1 smallest ids of a hash are, which are all that the ``first`` pairs in the order
    of the ids can hold: each further id of a hash comes after as many pairs. An id that comes with several hashes pairs with others, never with itself.
    """
    own = stored(hashed.select(F.col(id_col).alias("_id"), F.col(hash_col).alias("_h")).where("_id is not null and _h is not null").distinct())
    if first is not None:
        own = own.withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy("_id"))).where(F.col("_r") <= first + 1).drop("_r")
    values = own.select("_h").distinct()
    left, right = _large(own.toDF("_i", "x")), _large(own.toDF("_j", "y"))
    unequal = near_values(values, threshold, mode).join(left, "x").join(right, "y").where("_i != _j")
    same = left.join(right, (F.col("x") == F.col("y")) & (F.col("_i") < F.col("_j")))
    pairs = unequal.unionByName(same).select(F.least("_i", "_j").alias("id_i"), F.greatest("_i", "_j").alias("id_j"), hamming(F.col("x"), F.col("y")).alias("distance"))
    return pairs


def pair_numbers(hashed: DataFrame, by: str, threshold: int = 3, mode: str = "compat", hash_col: str = "h") -> DataFrame:
    """(by, pairs): how many near pairs the rows of each value of ``by`` have, in one job for all. Rows of equal hashes are counted, not paired."""
    own = stored(hashed.where(F.col(hash_col).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(hash_col).alias("_h")).agg(F.count(F.lit(1)).alias("_c")))
    same = own.select("_by", (F.col("_c") * (F.col("_c") - 1) / 2).cast("long").alias("pairs"))
    near = near_values(own.select("_by", "_h"), threshold, mode, ("_by",))
    of = lambda name: _large(own.select("_by", F.col("_h").alias(name), F.col("_c").alias(f"_c{name}")))
    unequal = near.join(of("x"), ["_by", "x"]).join(of("y"), ["_by", "y"]).select("_by", (F.col("_cx") * F.col("_cy")).alias("pairs"))
    return same.unionByName(unequal).groupBy(F.col("_by").alias(by)).agg(F.sum("pairs").alias("pairs"))


def first_pairs(hashed: DataFrame, k: int, threshold: int = 3, id_col: str = "doc_id", hash_col: str = "h") -> DataFrame:
    """The first ``k`` compat pairs in the order in which buckets first occur, then by the ids; ids are distinct."""
    pairs = near_pairs(hashed, threshold, "compat", id_col, hash_col, first=k)
    buckets = hashed.select(F.col(id_col).alias("id_i"), F.shiftrightunsigned(hash_col, 48).alias("_key"))
    order = buckets.groupBy("_key").agg(F.min("id_i").alias("_first"))
    keyed = pairs.join(_large(buckets), "id_i").join(_large(order), "_key")
    return keyed.orderBy("_first", "id_i", "id_j").limit(k).select("id_i", "id_j", "distance")


def gate(hashed: DataFrame, threshold: int = 3, id_col: str = "doc_id", hash_col: str = "h") -> DataFrame:
    """(id, accepted) for each row, in the order of ids and then hashes: rejected if an earlier accepted row is near.

    Rows of equal hashes fold to the first one: those after it are rejected if it is accepted, and fail with it otherwise. Hashes
    stand for the rows that are left, so ids may repeat. On the edges between near ones, hashes without an earlier neighbour are accepted, their later
    neighbours are rejected and leave, and so on until no edge is left. Every round settles the first hash of each
    component at least, so the rounds are at most as many as the longest chain of neighbours in their order, and few where the order has nothing to do
    with the hashes. Null ids come first; a null hash is near nothing and accepted.
    """
    own = stored(hashed.select(F.col(id_col).alias("_id"), F.col(hash_col).alias("_h")).groupBy("_id", "_h").agg(F.count(F.lit(1)).alias("_c")))
    firsts = stored(own.where("_h is not null").groupBy("_h").agg(F.min(F.struct("_id"))["_id"].alias("_first")))
    near = near_values(firsts.select("_h"), threshold, "exact")
    met = near.join(_large(firsts.toDF("x", "_i")), "x").join(_large(firsts.toDF("y", "_j")), "y")
    a, b = F.struct(F.col("_i"), F.col("x")), F.struct(F.col("_j"), F.col("y"))
    edges = stored(met.select(F.when(a < b, F.col("x")).otherwise(F.col("y")).alias("early"), F.when(a < b, F.col("y")).otherwise(F.col("x")).alias("late")))
    rejected = None
    while not edges.isEmpty():
        accepted = edges.select("early").distinct().join(_large(edges.select(F.col("late").alias("early")).distinct()), "early", "left_anti")
        gone = stored(edges.join(_large(accepted), "early", "left_semi").select("late").distinct())
        rejected = gone if rejected is None else rejected.unionByName(gone)
        left = edges.join(_large(gone), "late", "left_anti").join(_large(gone.withColumnRenamed("late", "early")), "early", "left_anti")
        # Edges of accepted hashes have gone with their later ends.
        edges = stored(left)
    verdict = own.join(_large(firsts), "_h", "left")
    if rejected is not None:
        verdict = verdict.join(_large(rejected.select(F.col("late").alias("_h"), F.lit(True).alias("_near"))), "_h", "left")
    else:
        verdict = verdict.withColumn("_near", F.lit(None).cast("boolean"))
    ok = F.col("_h").isNull() | (F.col("_near").isNull() & F.col("_id").eqNullSafe(F.col("_first")))
    copies = F.explode(F.sequence(F.lit(1), F.col("_c").cast("int")))
    return verdict.select("_id", "_h", ok.alias("_ok"), copies.alias("_n")).select(F.col("_id").alias(id_col), (F.col("_ok") & (F.col("_h").isNull() | (F.col("_n") == 1))).alias("accepted"))
