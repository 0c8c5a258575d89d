"""Corpus metrics: diversity, distributions, correlations, lengths, histograms, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.sources.records import numbered


def bucket_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(bucket, key, count) of each column's values as text, in one pass over grouping sets."""
    shown = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")).alias(c) for c in columns))
    stacked = shown.select(F.explode(F.array(*(F.struct(F.lit(c).alias("bucket"), F.col(f"`{c}`").alias("key")) for c in columns))).alias("x"))
    return stacked.groupBy("x.bucket", "x.key").agg(F.count(F.lit(1)).alias("count"))


def rates(items: DataFrame, *by: str) -> DataFrame:
    """One row of shares, or one for each value of ``by``: items with an error, with a warning, and with errors of a kind."""
    has = lambda column, word: F.avg(F.exists(column, lambda m: F.contains(m, F.lit(word))).cast("double"))
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.size("errors") > 0).cast("double")).alias("error_rate"), F.avg((F.size("warnings") > 0).cast("double")).alias("warning_rate"),
        has("errors", "缺失或为空").alias("missing_rate"), has("errors", "非单段体裁").alias("paragraph_rate"), has("warnings", "年龄").alias("age_rate"), has("errors", "学术水平").alias("level_rate"),
    )


def distinct_n(df: DataFrame, tokens: Column, n: int) -> DataFrame:
    """(distinct_n): mean share of distinct n-grams over the rows of at least n tokens; 0 if there are none."""
    share = lambda grams: F.when(F.size(grams) > 0, F.size(F.array_distinct(grams)) / F.size(grams))
    return df.select(X.bound(X.array_ngrams(tokens, n), share).alias("r")).agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias(f"distinct_{n}"))


def distinct_chars(df: DataFrame, text: Column, *lengths: int) -> DataFrame:
    """(distinct_1, ...): :func:`distinct_n` of the characters of ``text`` without blanks and punctuation for all ``lengths`` in one pass."""
    shares = df.select(X.char_shares(text, lengths).alias("r"))
    return shares.agg(*(F.coalesce(F.avg(F.get("r", F.lit(i))), F.lit(0.0)).alias(f"distinct_{n}") for i, n in enumerate(lengths)))


def distinct_n_corpus(df: DataFrame, text: str, order: str, n: int, by: str | None = None) -> DataFrame:
    """(distinct_n): share of distinct n-grams of blank-separated tokens over all rows joined in ``order``; with ``by``, (by, distinct_n) of the rows of each of its values.

    N-grams run on from row to row. Those within a row are counted where it is read; for the others the first and last n - 1 tokens of each row, and nothing else, are
    numbered and joined with the heads of the rows after them.
    """
    tokens = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    of = F.col(by) if by else F.lit(0)
    own = df.select(of.alias("_of"), F.struct(of, F.col(order)).alias("_o"), tokens.alias("_t")).where(F.size("_t") > 0)
    if n > 1:
        ends = numbered(own.select("_of", "_o", F.slice("_t", 1, n - 1).alias("_head"), F.slice("_t", F.greatest(F.size("_t") - n + 2, F.lit(1)), n - 1).alias("_tail")), "_o", "_row")
        # Small as they are in their file, they are as many as the rows and pass no driver.
        heads, joined = ends.select("_of", "_row", "_head").hint("merge"), ends.select("_of", "_row", "_tail")
        for s in range(1, n):
            joined = joined.join(heads.select("_of", (F.col("_row") - s).alias("_row"), F.col("_head").alias(f"_h{s}")), ["_row", "_of"], "left")
        none = F.array().cast("array<string>")
        after = F.slice(F.concat(*(F.coalesce(f"_h{s}", none) for s in range(1, n))), 1, n - 1)
        # Dealt out in parts of moderate bytes whatever the file's splits are, so that a task's n-grams combine in its memory.
        own = own.select("_of", "_t").hint("rebalance").unionByName(joined.select("_of", F.concat("_tail", after).alias("_t")))
    grams = own.select("_of", F.explode(X.array_ngrams(F.col("_t"), n)).alias("g")).groupBy("_of", "g").agg(F.count(F.lit(1)).alias("c"))
    share = F.coalesce(F.try_divide(F.count(F.lit(1)).cast("double"), F.sum("c")), F.lit(0.0)).alias(f"distinct_{n}")
    return grams.groupBy(F.col("_of").alias(by)).agg(share) if by else grams.agg(share)


def hamming_moments(hashed: DataFrame, hash_col: str = "h") -> DataFrame:
    """(pairs, mean) of the Hamming distance over all pairs, in closed form: bit b differs in c_b (n - c_b) of them."""
    bits = hashed.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.shiftrightunsigned(hash_col, b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)))
    n = F.col("n")
    differing = sum((F.coalesce(F.col(f"b{b}"), F.lit(0)) * (n - F.coalesce(F.col(f"b{b}"), F.lit(0))) for b in range(64)), F.lit(0))
    pairs = F.floor(n * (n - 1) / 2)
    return bits.select(pairs.alias("pairs"), F.coalesce(F.try_divide(differing.cast("double"), pairs), F.lit(0.0)).alias("mean"))


def drawn_pairs(spark: SparkSession, n: int, most: int) -> DataFrame:
    """(i, j): ``most`` different pairs of the numbers below ``n``, or all of them if there are no more.

    All pairs are numbered and cut into as many runs of numbers as pairs are wanted, and one is drawn from each run by a hash of the run's number, so every
    pair is as likely as any other up to the roundings of runs' lengths. Number p is the pair of p mod n and the number p div n + 1 places after it, around the end.
    """
    total = n * (n - 1) // 2
    wanted = min(most, total)
    if not wanted:
        return spark.createDataFrame([], "i long, j long")
    each, rest = divmod(total, wanted)
    low = lambda k: f"(cast({k} as decimal(10,0)) * {each}BD + cast(({k} * {rest}L) div {wanted}L as decimal(19,0)))"
    hashed = "cast(conv(substring(md5(cast(id as string)), 1, 8), 16, 10) as decimal(10,0))"
    runs = spark.range(wanted).select("id", F.expr(low("id")).cast("decimal(27,0)").alias("low"), F.expr(f"{low('(id + 1)')} - {low('id')}").cast("decimal(25,0)").alias("width"))
    number = runs.select((F.col("low") + F.expr(f"({hashed} * width) div 4294967296BD").cast("decimal(19,0)")).cast("decimal(28,0)").alias("p"))
    placed = number.select(F.expr(f"cast(p % {n}BD as bigint)").alias("i"), F.expr(f"p div {n}BD").alias("d"))
    return placed.select("i", F.expr(f"(i + d + 1) % {n}L").alias("j"))


def hamming_stats(hashed: DataFrame, max_pairs: int = 50_000, id_col: str = "doc_id", hash_col: str = "h") -> DataFrame:
    """(pairs, mean, std, mean_normalized, std_normalized) of distances: of all pairs if there are at most ``max_pairs``, else of as many pairs
    drawn from all (:func:`drawn_pairs`), which are joined with the rows by their ranks. Null hashes take no part."""
    own = numbered(hashed.select(F.struct(F.col(id_col), F.col(hash_col)).alias("_o"), F.col(hash_col).alias("_h")).where("_h is not null"), "_o", "_r")
    drawn = drawn_pairs(hashed.sparkSession, own.count(), max_pairs)
    met = drawn.join(own.select(F.col("_r").alias("i"), F.col("_h").alias("_x")), "i").join(own.select(F.col("_r").alias("j"), F.col("_h").alias("_y")), "j")
    out = met.select(X.hamming(F.col("_x"), F.col("_y")).alias("d")).agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("std"))
    return out.select("*", (F.col("mean") / 64).alias("mean_normalized"), (F.col("std") / 64).alias("std_normalized"))


def self_bleu(df: DataFrame, tokens: Column, id_col: str, candidates: int = 2000, references: int = 20, max_n: int = 2) -> DataFrame:
    """(self_bleu): mean BLEU of candidates against references from the same corpus.

    Candidates are the rows of the smallest id hashes, and each takes the rows that follow it in that order as its references, the
    last ones going round: with at most ``references`` + 1 rows these are all others. Clipping, the closest length (the shorter of two)
    and the brevity penalty are those of BLEU; a precision of 0 counts as 1e-9.
    """
    wanted = candidates + references
    ranked = df.select(F.col(id_col).alias("_id"), tokens.alias("_t")).orderBy(F.xxhash64(id_col), id_col).limit(wanted)
    numbered = ranked.withColumn("_r", F.row_number().over(Window.orderBy(F.xxhash64("_id"), "_id")) - 1)
    n = numbered.count()
    if n <= 1:
        return df.sparkSession.createDataFrame([(0.0,)], "self_bleu double")
    steps = min(references, n - 1)
    own = numbered.where((F.size("_t") > 0) & (F.col("_r") < candidates))
    links = own.select(F.col("_id"), F.col("_t"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda s: (F.col("_r") + s) % n)).alias("_r"))
    pairs = links.join(numbered.select("_r", F.col("_t").alias("_ref")), "_r").where(F.size("_ref") > 0)
    size = F.size("_t")
    gap = F.struct(F.abs(F.size("_ref") - size).alias("gap"), F.size("_ref").alias("size"))
    closest = pairs.groupBy("_id").agg(F.min(gap)["size"].alias("_len"), F.first(size).alias("_size"))
    scored = closest
    for k in range(1, max_n + 1):
        gram = lambda c: X.array_ngrams(F.col(c), k)  # noqa: B023, E731
        mine = own.select("_id", F.explode(gram("_t")).alias("g")).groupBy("_id", "g").agg(F.count(F.lit(1)).alias("c"))
        theirs = pairs.select("_id", "_r", F.explode(gram("_ref")).alias("g")).groupBy("_id", "_r", "g").agg(F.count(F.lit(1)).alias("c"))
        most = theirs.groupBy("_id", "g").agg(F.max("c").alias("m"))
        clipped = mine.join(most, ["_id", "g"], "left").groupBy("_id").agg((F.sum(F.least("c", F.coalesce("m", F.lit(0)))) / F.sum("c")).alias(f"_p{k}"))
        scored = scored.join(clipped, "_id", "left")
    logs = sum((F.log(F.when(F.coalesce(F.col(f"_p{k}"), F.lit(0.0)) > 0, F.col(f"_p{k}")).otherwise(1e-9)) for k in range(1, max_n + 1)), F.lit(0.0)) / max_n
    brevity = F.when(F.col("_size") > F.col("_len"), 1.0).otherwise(F.exp(1 - F.col("_len") / F.col("_size")))
    return scored.select((brevity * F.exp(logs)).alias("b")).agg(F.coalesce(F.avg("b"), F.lit(0.0)).alias("self_bleu"))


def self_bleu_of_all(df: DataFrame, tokens: Column, id_col: str, max_n: int = 2) -> DataFrame:
    """(self_bleu): as :func:`self_bleu`, with every row as a candidate against all others, without forming pairs.

    A row's n-grams are clipped only where it alone holds an n-gram's highest count, to the second highest, so an n-gram
    takes something from one row at most. The closest length is the row's own if another row has it, else a neighbouring one.
    """
    own = df.select(F.col(id_col).alias("_id"), tokens.alias("_t")).where(F.size("_t") > 0).withColumn("_size", F.size("_t"))
    lengths = own.groupBy("_size").agg(F.count(F.lit(1)).alias("_c"))
    beside = Window.orderBy("_size")
    near = lengths.select("_size", "_c", F.lag("_size").over(beside).alias("_lower"), F.lead("_size").over(beside).alias("_upper"))
    upper = F.col("_lower").isNull() | (F.col("_upper") - F.col("_size") < F.col("_size") - F.col("_lower"))
    closest = near.select("_size", F.when(F.col("_c") > 1, F.col("_size")).otherwise(F.when(upper, F.coalesce("_upper", "_lower")).otherwise(F.col("_lower"))).alias("_len"))
    scored = own.select("_id", "_size").join(closest.where("_len is not null"), "_size")
    for k in range(1, max_n + 1):
        mine = own.select("_id", F.explode(X.array_ngrams(F.col("_t"), k)).alias("g")).groupBy("_id", "g").agg(F.count(F.lit(1)).alias("c"))
        levels = mine.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("who"))
        top = levels.groupBy("g").agg(F.max(F.struct("c", "n", "who")).alias("top"), F.sort_array(F.collect_list("c"), False).alias("counts"))
        second = F.when(F.size("counts") > 1, F.get("counts", F.lit(1))).otherwise(F.lit(0))
        lost = top.where("top.n = 1").groupBy(F.col("top.who").alias("_id")).agg(F.sum(F.col("top.c") - second).alias(f"_lost{k}"))
        scored = scored.join(lost, "_id", "left")
    share = [F.when(F.col("_size") >= k, 1 - F.coalesce(F.col(f"_lost{k}"), F.lit(0)) / (F.col("_size") - k + 1)).otherwise(F.lit(0.0)) for k in range(1, max_n + 1)]
    logs = sum((F.log(F.when(p > 0, p).otherwise(1e-9)) for p in share), F.lit(0.0)) / max_n
    brevity = F.when(F.col("_size") > F.col("_len"), 1.0).otherwise(F.exp(1 - F.col("_len") / F.col("_size")))
    return scored.select((brevity * F.exp(logs)).alias("b")).agg(F.coalesce(F.avg("b"), F.lit(0.0)).alias("self_bleu"))


def kl_divergence(counts: DataFrame, prior: DataFrame) -> DataFrame:
    """(kl): of (key, count) against (key, q), with one added to each count over the union of keys and q at least 1e-8.

    0 if nothing was counted. The prior is a short list; the join is on its keys.
    """
    joined = counts.groupBy("key").agg(F.sum("count").alias("count")).join(prior, "key", "full_outer").select(F.coalesce("count", F.lit(0)).alias("c"), F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(1e-8)).alias("q"))
    n, k = joined.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    p = (F.col("c") + 1.0) / F.lit(float(n + k or 1))
    return joined.agg((F.coalesce(F.sum(p * F.log(p / F.col("q"))), F.lit(0.0)) if n else F.lit(0.0)).alias("kl"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """(pearson): 0 without rows or without spread."""
    return df.agg(F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0)).alias("pearson"))


def length_stats(df: DataFrame, length: str, shortest: int, longest: int) -> DataFrame:
    n = F.col(length)
    return df.agg(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.avg((n < shortest).cast("double")).alias("short_ratio"), F.avg((n > longest).cast("double")).alias("long_ratio"))


def histogram(df: DataFrame, value: str, bins: int = 12) -> DataFrame:
    """(bin, low, high, count) of equal widths, the last one closed; one bin if all values are equal."""
    v = F.col(value).cast("double")
    low, high = df.agg(F.min(v), F.max(v)).first()
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, low double, high double, count long")
    n = bins if high > low else 1
    width = (high - low) / n
    place = F.least(F.floor((v - low) / width), F.lit(n - 1)) if high > low else F.lit(0)
    counts = df.where(v.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = spark.range(n).select(F.col("id").cast("int").alias("bin"))
    bounds = (low + F.col("bin") * width).alias("low"), (low + (F.col("bin") + 1) * width if high > low else F.lit(high)).alias("high")
    return edges.join(counts, "bin", "left").select("bin", *bounds, F.coalesce("count", F.lit(0)).alias("count"))


def mention_ratio(df: DataFrame, subjects: Column, text: Column) -> DataFrame:
    """(ratio): among rows with subjects, the share whose text holds one of them."""
    return df.where(F.size(subjects) > 0).agg(F.coalesce(F.avg(F.exists(subjects, lambda s: F.contains(text, s)).cast("double")), F.lit(0.0)).alias("ratio"))


def quality_score(missing: Column, age: Column, paragraph: Column, level: Column, distinct_1: Column, distinct_2: Column) -> Column:
    """100 points from four rates and diversity."""
    diversity = F.least(F.greatest(distinct_1 / 0.4 * 0.5 + distinct_2 / 0.6 * 0.5, F.lit(0.0)), F.lit(1.0))
    return 25 * (1 - missing) + 25 * (1 - age) + 15 * (1 - paragraph) + 20 * diversity + 15 * (1 - level)


def suspicious(items: DataFrame, order: str, k: int = 100) -> DataFrame:
    """The ``k`` items of most errors, then most warnings, then first in ``order``."""
    return items.orderBy(F.size("errors").desc(), F.size("warnings").desc(), F.col(order).asc()).limit(k)


def plan_match(records: DataFrame, schedule: DataFrame, pairs: dict[str, str], id_col: str = "id") -> DataFrame:
    """(attribute, joined, matched, rate): records against their slots, where both sides have a value."""
    joined = records.join(schedule, records[id_col] == schedule["sid"])
    rows = joined.select(F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(f"`{a}`").cast("string").alias("x"), F.col(f"slot.`{s}`").cast("string").alias("y")) for a, s in pairs.items()))).alias("r")).select("r.*")
    rows = rows.where("x <> '' and y <> ''").groupBy("attribute").agg(F.count(F.lit(1)).alias("joined"), F.sum((F.col("x") == F.col("y")).cast("long")).alias("matched"))
    return rows.withColumn("rate", F.col("matched") / F.col("joined"))
