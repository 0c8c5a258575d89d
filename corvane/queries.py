"""The operators' queries over the standard tables, and the same rows in SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import json_text as J
from corvane.functions import text as X
from corvane.functions.simhash import simhash64
from corvane.operators import dedup, metrics
from corvane.operators.rules import when
from corvane.plans import pool, quota
from corvane.sources import records as R
from corvane.streaming import compose, limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SimHash and near pairs -------------------------------------------------------------------------------------------------

_BITS = ", ".join(f"sum((v >> {b}) & 1) AS b{b}" for b in range(64))
_WORD = " + ".join(f"CASE WHEN 2 * b{b} >= n THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))
_HASHES = f"""
grams AS (SELECT doc_id, ('0x' || substr(md5(substr(t, i, 3)), 17, 16))::UBIGINT AS v
  FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT doc_id, regexp_replace(coalesce(text, 'None'), '\\s+', '', 'g') AS t FROM documents))),
votes AS (SELECT doc_id, count(*) AS n, {_BITS} FROM grams GROUP BY doc_id),
words AS (SELECT doc_id, {_WORD} AS w FROM votes),
hashed AS (SELECT d.doc_id, coalesce(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END, -1)::BIGINT AS h FROM documents d LEFT JOIN words USING (doc_id))
"""
_DISTANCE = "bit_count(xor(a.h, b.h))::INTEGER"
_PAIRS = f"SELECT a.doc_id AS id_i, b.doc_id AS id_j, {_DISTANCE} AS distance FROM hashed a JOIN hashed b ON a.doc_id < b.doc_id WHERE {_DISTANCE} <= 3"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", simhash64(F.col("text")).alias("h"))


@query(f"WITH {_HASHES} SELECT doc_id, h FROM hashed")
def simhash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir)


@query(f"WITH {_HASHES} {_PAIRS}")
def near_pairs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_hashed(spark, sf_dir), 3, "exact")


@query(f"WITH {_HASHES} {_PAIRS} AND (a.h >> 48) = (b.h >> 48)")
def near_pairs_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_pairs(_hashed(spark, sf_dir), 3, "compat")


# Documents one by one in the order of their ids, with the list of the hashes accepted so far.
@query(f"""WITH RECURSIVE {_HASHES}, o AS MATERIALIZED (SELECT doc_id, h, row_number() OVER (ORDER BY doc_id) AS k FROM hashed),
g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS doc_id, false AS accepted, []::BIGINT[] AS kept
  UNION ALL SELECT s.k, s.doc_id, s.ok, CASE WHEN s.ok THEN list_append(s.kept, s.h) ELSE s.kept END
  FROM (SELECT o.k, o.doc_id, o.h, g.kept, len(list_filter(g.kept, lambda x: bit_count(xor(x, o.h)) <= 3)) = 0 AS ok FROM g JOIN o ON o.k = g.k + 1) s)
SELECT doc_id, accepted FROM g WHERE k > 0""")
def similarity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.gate(_hashed(spark, sf_dir), 3)


@query(f"WITH {_HASHES} SELECT count(*)::BIGINT AS pairs, avg({_DISTANCE})::DOUBLE AS mean FROM hashed a JOIN hashed b ON a.doc_id < b.doc_id")
def hamming_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hamming_moments(_hashed(spark, sf_dir))


# --- diversity --------------------------------------------------------------------------------------------------------------

_PUNCTUATION = "[ ，。、“”‘’？！：；,.!?｜]"
_CHARS = rf"regexp_replace(regexp_replace(coalesce(text, ''), '\s+', '', 'g'), '{_PUNCTUATION}', '', 'g')"


def _distinct_chars_sql(n: int) -> str:
    lead = "".join(f", lead(w, {s}) OVER o" for s in range(1, n))
    last = f"lead(w, {n - 1}) OVER o IS NOT NULL" if n > 1 else "true"
    return f"""WITH t AS (SELECT doc_id, string_split({_CHARS}, '') AS c FROM documents),
u AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS w FROM t),
g AS (SELECT doc_id, concat_ws(chr(1), w{lead}) AS g, {last} AS whole FROM u WHERE w <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT count(DISTINCT g)::DOUBLE / count(*) AS r FROM g WHERE whole GROUP BY doc_id)
SELECT coalesce(avg(r), 0)::DOUBLE AS distinct_{n} FROM r"""


def _distinct_corpus_sql(n: int) -> str:
    lead = ", ".join(f"lead(w, {s}) OVER o" for s in range(1, n))
    gram = f"concat_ws(chr(1), w{', ' + lead if lead else ''})"
    last = f"lead(w, {n - 1}) OVER o IS NOT NULL" if n > 1 else "true"
    return f"""WITH t AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS l FROM documents)),
g AS (SELECT {gram} AS g, {last} AS whole FROM t WINDOW o AS (ORDER BY doc_id, i))
SELECT coalesce(count(DISTINCT g)::DOUBLE / nullif(count(*), 0), 0) AS distinct_{n} FROM g WHERE whole"""


@query(_distinct_chars_sql(1))
def distinct1_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_chars(_table(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), 1)


@query(_distinct_chars_sql(2))
def distinct2_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_chars(_table(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), 2)


@query(_distinct_corpus_sql(1))
def distinct1_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_n_corpus(_table(spark, sf_dir, "documents"), "text", "doc_id", 1)


@query(_distinct_corpus_sql(2))
def distinct2_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_n_corpus(_table(spark, sf_dir, "documents"), "text", "doc_id", 2)


@query(rf"""WITH s AS (SELECT conv_id, turn, list_distinct(string_split(regexp_replace(text, '[ ，。、“”‘’？！：；,.!?\t\r\n｜]', '', 'g'), '')) AS c FROM conversations),
p AS (SELECT a.conv_id, a.turn, list_filter(a.c, lambda x: x <> '') AS c, list_filter(b.c, lambda x: x <> '') AS d FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN len(c) = 0 OR len(d) = 0 THEN 0.0 ELSE len(list_intersect(c, d))::DOUBLE / len(list_distinct(list_concat(c, d))) END AS jaccard FROM p""")
def jaccard_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", X.char_set(F.col("text")).alias("c"))
    after = own.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("c").alias("d"))
    return own.join(after, ["conv_id", "turn"]).select("conv_id", "turn", X.jaccard(F.col("c"), F.col("d")).alias("jaccard"))


@query(f"""WITH t AS (SELECT item_id, string_split({_CHARS}, '') AS c FROM benchmark), u AS (SELECT item_id, generate_subscripts(c, 1) AS i, unnest(c) AS w FROM t),
v AS (SELECT item_id, w, lead(w) OVER (PARTITION BY item_id ORDER BY i) AS x FROM u WHERE w <> ''), s AS (SELECT item_id, count(*) AS n FROM v GROUP BY 1),
g AS (SELECT item_id, 1 AS k, w AS g, count(*) AS c FROM v GROUP BY 1, 3 UNION ALL SELECT item_id, 2, w || chr(1) || x, count(*) FROM v WHERE x IS NOT NULL GROUP BY 1, 3),
m AS (SELECT a.item_id, a.k, a.c, coalesce(max(b.c), 0) AS o FROM g a LEFT JOIN g b ON a.k = b.k AND a.g = b.g AND a.item_id <> b.item_id GROUP BY a.item_id, a.k, a.g, a.c),
p AS (SELECT item_id, k, sum(least(c, o))::DOUBLE / sum(c) AS p FROM m GROUP BY 1, 2),
r AS (SELECT a.item_id, a.n, min(abs(a.n - b.n) * 1000000 + b.n) % 1000000 AS len FROM s a JOIN s b ON a.item_id <> b.item_id GROUP BY 1, 2),
l AS (SELECT r.item_id, r.n, r.len, sum(ln(CASE WHEN p > 0 THEN p ELSE 1e-9 END)) / 2 AS l FROM (SELECT r.*, k FROM r, (VALUES (1), (2)) k(k)) r LEFT JOIN p ON p.item_id = r.item_id AND p.k = r.k GROUP BY 1, 2, 3)
SELECT coalesce(avg(CASE WHEN n > len THEN 1 ELSE exp(1 - len::DOUBLE / n) END * exp(l)), 0)::DOUBLE AS self_bleu FROM l""")
def self_bleu2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.self_bleu_of_all(_table(spark, sf_dir, "benchmark"), X.char_tokens(F.coalesce("text", F.lit(""))), "item_id")


# --- distributions, correlation, lengths ------------------------------------------------------------------------------------------


def _kl(counts: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.kl_divergence(counts, counts.sparkSession.createDataFrame([(k, 1 / len(keys)) for k in keys], "key string, q double"))


def _kl_sql(column: str, table: str, keys: list[str]) -> str:
    values = ", ".join(f"('{k}', {1 / len(keys)}::DOUBLE)" for k in keys)
    return f"""WITH c AS (SELECT coalesce({column}, 'None') AS key, count(*) AS c FROM {table} GROUP BY 1), q AS (SELECT * FROM (VALUES {values}) v(key, q)),
j AS (SELECT coalesce(c, 0) AS c, greatest(coalesce(q, 0), 1e-8) AS q FROM c FULL JOIN q USING (key)), p AS (SELECT (c + 1.0::DOUBLE) / (sum(c) OVER () + count(*) OVER ()) AS p, q FROM j)
SELECT sum(p * ln(p / q))::DOUBLE AS kl FROM p"""


_LANGUAGES, _EVENTS = ["en", "fr", "de", "es"], ["click", "error", "purchase", "signup", "view"]


@query(_kl_sql("lang", "documents", _LANGUAGES))
def kl_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kl(metrics.bucket_counts(_table(spark, sf_dir, "documents"), "lang"), _LANGUAGES)


@query(_kl_sql("event_type", "events", _EVENTS))
def kl_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kl(metrics.bucket_counts(_table(spark, sf_dir, "events"), "event_type"), _EVENTS)


_BUCKET = "SELECT '{0}' AS bucket, coalesce({0}::VARCHAR, 'None') AS key, count(*)::BIGINT AS count FROM {1} GROUP BY 2"


@query(" UNION ALL ".join(_BUCKET.format(*x) for x in (("lang", "documents"), ("source", "documents"), ("event_type", "events"))))
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = metrics.bucket_counts(_table(spark, sf_dir, "documents"), "lang", "source")
    return docs.unionByName(metrics.bucket_counts(_table(spark, sf_dir, "events"), "event_type"))


@query("""SELECT coalesce(covar_pop(quality::DOUBLE, n_chars::DOUBLE) / nullif(stddev_pop(quality::DOUBLE) * stddev_pop(n_chars::DOUBLE), 0), 0)::DOUBLE AS pearson
FROM labels JOIN documents USING (doc_id)""")
def pearson_quality_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.pearson(joined, "quality", "n_chars")


_LENGTH = r"length(regexp_replace(text, '\s+', '', 'g'))"


@query(f"""SELECT avg(n)::DOUBLE AS mean, stddev_pop(n)::DOUBLE AS std, avg((n < 80)::INT)::DOUBLE AS short_ratio, avg((n > 800)::INT)::DOUBLE AS long_ratio
FROM (SELECT {_LENGTH} AS n FROM documents)""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = _table(spark, sf_dir, "documents").select(F.char_length(X.without_blanks(F.col("text"))).alias("n"))
    return metrics.length_stats(lengths, "n", 80, 800)


@query("""WITH e AS (SELECT min(n_chars)::DOUBLE AS lo, (max(n_chars) - min(n_chars))::DOUBLE / 12 AS w FROM documents), b AS (SELECT unnest(range(0, 12))::INTEGER AS bin),
c AS (SELECT least(floor((n_chars - lo) / w), 11)::INTEGER AS bin, count(*) AS c FROM documents, e GROUP BY 1)
SELECT b.bin, lo + b.bin * w AS low, lo + (b.bin + 1) * w AS high, coalesce(c, 0)::BIGINT AS count FROM b LEFT JOIN c ON b.bin = c.bin, e""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(_table(spark, sf_dir, "documents"), "n_chars")


# --- rules ----------------------------------------------------------------------------------------------------------------------

_RULES = rf"""items AS (SELECT doc_id, {_LENGTH} AS n, list_filter([CASE WHEN coalesce(trim(source), '') = '' THEN 'missing source' END, CASE WHEN coalesce(text, '') = '' THEN 'missing text' END,
  CASE WHEN lang NOT IN ('en', 'fr', 'de') OR lang IS NULL THEN 'language' END, CASE WHEN regexp_matches(text, '(\n\s*\n)|(^\s*[-•\d]+\.)') THEN 'paragraph' END], lambda x: x IS NOT NULL) AS errors,
  list_filter([CASE WHEN {_LENGTH} < 80 THEN 'short' END, CASE WHEN {_LENGTH} > 800 THEN 'long' END, CASE WHEN contains(text, '%%%') OR contains(text, '!!') THEN 'junk' END], lambda x: x IS NOT NULL) AS warnings FROM documents)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under rules like those of records: presence, vocabulary and paragraph errors, length and word warnings."""
    text, n = F.col("text"), F.col("_n")
    docs = _table(spark, sf_dir, "documents").withColumn("_n", F.char_length(X.without_blanks(text)))  # a column of its own, so that two rules measure once
    blank = lambda c: X.stripped(F.coalesce(c, F.lit(""))) == ""
    errors = when((blank(F.col("source")), "missing source"), (F.coalesce(text, F.lit("")) == "", "missing text"), (F.coalesce(~F.col("lang").isin("en", "fr", "de"), F.lit(True)), "language"), (~X.is_single_paragraph(F.coalesce(text, F.lit(""))), "paragraph"))
    warnings = when((n < 80, "short"), (n > 800, "long"), (X.contains_any(text, ["%%%", "!!"]), "junk"))
    return docs.select("doc_id", errors.alias("errors"), warnings.alias("warnings"))


@query(f"WITH {_RULES} SELECT doc_id, array_to_string(errors, ',') AS errors, array_to_string(warnings, ',') AS warnings FROM items")
def rule_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("doc_id", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query(f"""WITH {_RULES} SELECT count(*)::BIGINT AS n, avg((len(errors) > 0)::INT)::DOUBLE AS error_rate, avg((len(warnings) > 0)::INT)::DOUBLE AS warning_rate FROM items""")
def rule_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rates(_items(spark, sf_dir)).select("n", "error_rate", "warning_rate")


@query(f"WITH {_RULES} SELECT doc_id, len(errors)::INTEGER AS n_errors, len(warnings)::INTEGER AS n_warnings FROM items ORDER BY 2 DESC, 3 DESC, 1 LIMIT 100")
def suspicious_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = metrics.suspicious(_items(spark, sf_dir), "doc_id", 100)
    return top.select("doc_id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


@query(f"""WITH {_RULES}, r AS (SELECT avg((list_contains(errors, 'missing source') OR list_contains(errors, 'missing text'))::INT)::DOUBLE AS m, avg((list_contains(errors, 'paragraph'))::INT)::DOUBLE AS p,
  avg((list_contains(errors, 'language'))::INT)::DOUBLE AS l, avg((len(warnings) > 0)::INT)::DOUBLE AS a FROM items), d1 AS ({_distinct_chars_sql(1)}), d2 AS ({_distinct_chars_sql(2)})
SELECT 25 * (1 - m) + 25 * (1 - a) + 15 * (1 - p) + 20 * least(greatest(distinct_1 / 0.4 * 0.5 + distinct_2 / 0.6 * 0.5, 0), 1) + 15 * (1 - l) AS score FROM r, d1, d2""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda *names: F.avg(F.arrays_overlap("errors", F.array(*map(F.lit, names))).cast("double"))
    r = _items(spark, sf_dir).agg(share("missing source", "missing text").alias("m"), share("paragraph").alias("p"), share("language").alias("l"), F.avg((F.size("warnings") > 0).cast("double")).alias("a"))
    d = map(F.lit, metrics.distinct_chars(_table(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), 1, 2).first())
    return r.select(metrics.quality_score(F.col("m"), F.col("a"), F.col("p"), F.col("l"), *d).alias("score"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '12. ' || html WHEN 1 THEN html || chr(10) || ' ' || chr(10) WHEN 2 THEN '- ' || html WHEN 3 THEN '  •. ' || html WHEN 4 THEN '12.5 ' || html ELSE html END AS t FROM pages)
SELECT page_id, NOT regexp_matches(t, '(\n\s*\n)|(^\s*[-•\d]+\.)') AS single FROM p""")
def single_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages behind bullets and numbers of several forms, or with a blank line."""
    html, kind = F.col("html"), F.col("page_id") % 6
    text = F.when(kind == 0, F.concat(F.lit("12. "), html)).when(kind == 1, F.concat(html, F.lit("\n \n"))).when(kind == 2, F.concat(F.lit("- "), html)).when(kind == 3, F.concat(F.lit("  •. "), html)).when(kind == 4, F.concat(F.lit("12.5 "), html)).otherwise(html)
    return _table(spark, sf_dir, "pages").select("page_id", X.is_single_paragraph(text).alias("single"))


@query("""SELECT p_partkey, list_bool_or(list_transform(string_split(p_name, ' '), lambda s: contains(lower(p_type || ' ' || p_brand || ' ' || p_name[3:]), s))) AS mentioned FROM part""")
def subject_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "p_type", "p_brand", F.expr("substring(p_name, 3)")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.exists(F.split("p_name", " "), lambda s: F.contains(text, s)).alias("mentioned"))


# --- JSON text -------------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties wrapped as models do: in a code fence, or in prose."""
    e = _table(spark, sf_dir, "events").select("event_id", "props")
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" as asked.")))
    return e.select("event_id", J.field(J.repaired(fenced), "k", "long").alias("k"))


@query("SELECT event_id, length(regexp_replace(props, '\\s+', '', 'g'))::INTEGER AS tokens FROM events")
def token_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", F.char_length(X.without_blanks(F.to_json(F.try_parse_json("props")))).alias("tokens"))


@query("SELECT event_id, (event_type IS NOT NULL AND trim(event_type) <> '') AS has_type, json_exists(props, '$.k') AS has_k, false AS has_other FROM events")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.try_parse_json(F.to_json(F.struct("event_type", F.from_json("props", "k bigint").alias("props"))))
    e = _table(spark, sf_dir, "events").select("event_id", record.alias("r"))
    props = J.field("r", "props")
    return e.select("event_id", J.non_empty(J.field("r", "event_type")).alias("has_type"), J.non_empty(J.field(props, "k")).alias("has_k"), J.non_empty(J.field(props, "other")).alias("has_other"))


@query("""SELECT name, count(event_id)::BIGINT AS failures FROM (VALUES ('CLICK'), ('ERROR'), ('VIEW'), ('NOBODY')) n(name) LEFT JOIN events ON contains(lower(event_type || ' ' || props), lower(name)) GROUP BY name""")
def failures_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("CLICK",), ("ERROR",), ("VIEW",), ("NOBODY",)], "name string")
    return R.failures_by_provider(_table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", "props").alias("error")), names)


# --- plans ----------------------------------------------------------------------------------------------------------------------


@query("""WITH j AS (SELECT d.lang, d.source, CASE WHEN l.quality = 1 THEN 'en' ELSE 'fr' END AS lang_slot, 'src' || (l.doc_id % 20) AS source_slot FROM documents d JOIN labels l USING (doc_id)),
r AS (SELECT 'lang' AS attribute, lang AS x, lang_slot AS y FROM j UNION ALL SELECT 'source', source, source_slot FROM j)
SELECT attribute, count(*)::BIGINT AS joined, sum((x = y)::INT)::BIGINT AS matched, sum((x = y)::INT)::DOUBLE / count(*) AS rate FROM r WHERE x <> '' AND y <> '' GROUP BY attribute""")
def plan_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.struct(F.when(F.col("quality") == 1, "en").otherwise("fr").alias("lang"), F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("source"))
    plan = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sid"), slot.alias("slot"))
    return metrics.plan_match(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), plan, {"lang": "lang", "source": "source"}, "doc_id")


@query("""WITH n AS (SELECT count(*) AS n FROM customer), g AS (SELECT ['一年级', '二年级', '三年级', '四年级', '五年级', '六年级', '初一', '初二', '初三', '高一', '高二', '高三'] AS g, ['男', '女'] AS s, ['理科向', '文社向', '艺体向', '外语生物向'] AS c)
SELECT g[((i % 96) // 8 + 1)::INT] AS grade, s[((i % 96) // 4 % 2 + 1)::INT] AS gender, c[(i % 4 + 1)::INT] AS cluster, count(*)::BIGINT AS slots FROM (SELECT unnest(range(n)) AS i FROM n), g GROUP BY 1, 2, 3""")
def quota_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of each triplet in a schedule of as many slots as there are customers: the shuffle moves them but keeps their counts."""
    plan = quota.schedule(spark, _table(spark, sf_dir, "customer").count())
    return plan.groupBy(F.col("slot.`年级`").alias("grade"), F.col("slot.`性别`").alias("gender"), F.col("slot.`优势学科偏向`")[0].alias("cluster")).agg(F.count(F.lit(1)).alias("slots"))


@query("""WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT level, round_even(n * share, 0)::BIGINT AS c, n, k FROM n, (VALUES ('高：成绩全校排名前10%', 0.4, 1), ('中：成绩全校排名前10%至30%', 0.3, 2), ('低：成绩全校排名前30%至50%', 0.2, 3), ('差：成绩全校排名后50%', 0.1, 4)) v(level, share, k)),
g AS (SELECT level, c, k, n - sum(c) OVER () AS gap FROM r) SELECT level, (c + CASE WHEN k <= gap THEN 1 WHEN k <= -gap THEN -1 ELSE 0 END)::BIGINT AS slots FROM g""")
def level_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = quota.schedule(spark, _table(spark, sf_dir, "customer").count(), X.parse_level_mix("高:0.4,mid:0.3,low:0.2,poor:0.1"))
    return plan.groupBy(F.col("slot.`目标学术水平`").alias("level")).agg(F.count(F.lit(1)).alias("slots"))


@query("SELECT (o_orderkey // 1000 + 1)::BIGINT AS chunk_no, count(*)::BIGINT AS records, min(o_orderkey + 1)::BIGINT AS first_sid FROM orders GROUP BY 1")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sids = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("sid"))
    return sids.groupBy(quota.chunk_no(F.col("sid"), 1000).alias("chunk_no")).agg(F.count(F.lit(1)).alias("records"), F.min("sid").alias("first_sid"))


@query("SELECT i::BIGINT AS sid FROM (SELECT unnest(range(1, (SELECT count(*) FROM documents) + 1)) AS i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _table(spark, sf_dir, "documents").count()
    return quota.pending(spark, total, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sid")))


@query("SELECT i::BIGINT AS sid FROM (SELECT unnest(range(1, (SELECT count(*) FROM documents) + 1)) AS i) WHERE i NOT IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 64")
def next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota.next_batch(resume_pending(spark, sf_dir), quota.batch_size(64, quota.concurrency(60)))


_PROVIDERS = """p AS (SELECT event_type AS name, avg(value) + 0.8 * (1 - avg((user_id % 7 <> 0)::INT)) + 0.5 * greatest(0, avg((user_id % 2)::INT) - 0.8)
  - sqrt(greatest(1, ln(greatest(2, (SELECT count(*) FROM events)))) / count(*)) AS score,
  greatest(1, ceil(1.3 * (count(*) / 100.0) / 60 * least(greatest(avg(value), 0.2), 30) * CASE WHEN bool_or(user_id % 7 = 0 AND value < 1) THEN 0.7 ELSE 1 END))::BIGINT AS capacity FROM events GROUP BY event_type),
r AS (SELECT name, capacity, sum(capacity) OVER (ORDER BY score, name) - capacity AS low, sum(capacity) OVER () AS total FROM p),
c AS (SELECT o_orderkey AS sid, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderstatus = 'O')"""


def _providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as providers: a user's number says which of their calls failed, and values are latencies."""
    failed = F.col("user_id") % 7 == 0
    of = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"))
    rows = of.agg(F.avg("value").alias("latency"), F.avg((~failed).cast("double")).alias("success"), F.avg((F.col("user_id") % 2).cast("double")).alias("used"), F.count(F.lit(1)).alias("calls"), F.bool_or(failed & (F.col("value") < 1)).alias("violated"))
    return rows.withColumn("capacity", pool.concurrency_of(F.col("calls") / 100, F.col("latency"), F.col("violated"))).drop("violated")


@query(f"WITH {_PROVIDERS} SELECT sid, name AS provider FROM c, r WHERE n % total >= low AND n % total < low + capacity")
def provider_allotment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which provider takes the call for each open order."""
    calls = _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("sid"))
    return pool.allot(calls, _providers(spark, sf_dir))


@query(f"WITH {_PROVIDERS} SELECT sid, name AS provider FROM c, r WHERE n < greatest(4, 2 * total) AND n % total >= low AND n % total < low + capacity")
def provider_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of open orders, as large as the providers' calls in flight allow, and who takes what."""
    providers = _providers(spark, sf_dir)
    in_flight = providers.agg(F.sum("capacity")).first()[0]
    calls = _table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("sid"))
    return pool.allot(quota.next_batch(calls, quota.batch_size(4, in_flight)), providers)


# --- limiter state over events: a user's errors are violations, values are latencies -----------------------------------------------

_ORDERED = "l AS (SELECT user_id, list({'t': epoch_us(ts), 'bad': event_type = 'error', 'v': value} ORDER BY ts, event_type, value) AS l FROM events GROUP BY user_id)"


_ORDER = ["ts", "event_type", "value"]


@query(f"""WITH {_ORDERED} SELECT user_id, s.c::BIGINT AS capacity, s.k::BIGINT AS streak, s.x::BIGINT AS violations FROM (SELECT user_id, list_reduce(l, lambda s, e:
  {{'c': CASE WHEN e.bad THEN greatest(1, floor(s.c * 0.7::DOUBLE))::BIGINT WHEN s.k + 1 >= 20 THEN least(s.c + 1, 180) ELSE s.c END, 'k': CASE WHEN e.bad OR s.k + 1 >= 20 THEN 0 ELSE s.k + 1 END, 'x': s.x + e.bad::INT}},
  {{'c': 6::BIGINT, 'k': 0::BIGINT, 'x': 0::BIGINT}}) AS s FROM l)""")
def aimd_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "error")
    return compose.composed(e, "user_id", _ORDER, ["bad"], (6, 0, 0), limiter.aimd(180), limiter.AIMD, compose.AimdRuns(6, 180))


@query(f"""WITH {_ORDERED} SELECT user_id, s.n AS tokens, s.g::BIGINT AS granted FROM (SELECT user_id, list_reduce(l, lambda s, e:
  {{'n': least(6::DOUBLE, s.n + (e.t / 1e6 - coalesce(s.t, e.t / 1e6)) * 0.1::DOUBLE) - CASE WHEN least(6::DOUBLE, s.n + (e.t / 1e6 - coalesce(s.t, e.t / 1e6)) * 0.1::DOUBLE) >= 1 THEN 1 ELSE 0 END, 't': e.t / 1e6,
   'g': s.g + CASE WHEN least(6::DOUBLE, s.n + (e.t / 1e6 - coalesce(s.t, e.t / 1e6)) * 0.1::DOUBLE) >= 1 THEN 1 ELSE 0 END}}, {{'n': 6::DOUBLE, 't': NULL::DOUBLE, 'g': 0::BIGINT}}) AS s FROM l)""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    state = limiter.folded(e, "user_id", _ORDER, ["seconds"], (6.0, None, 0), lambda s, t: limiter.token_bucket(s, t, 6.0), limiter.BUCKET)
    return state.select("user_id", "tokens", "granted")


@query(f"WITH {_ORDERED} SELECT user_id, list_reduce(list_transform(l, lambda e: e.v::DOUBLE), lambda a, v: a * 0.8::DOUBLE + v * 0.2::DOUBLE) AS latency FROM l")
def ewma_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("user_id", *_ORDER)
    return compose.composed(e, "user_id", _ORDER, ["value"], (None,), compose.ewma_step, "latency double", compose.EwmaRuns())


@query("""SELECT event_id, sum((event_type <> 'error')::INT) OVER w::BIGINT AS successes, sum((event_type = 'error')::INT) OVER w::BIGINT AS violations FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)""")
def sliding_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = limiter.sliding_counts(_table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error")
    return rows.select("event_id", "successes", "violations")


_SCORE = "avg(value) + 0.8 * (1 - avg((event_type <> 'error')::INT)) + 0.5 * greatest(0, count(*) / (SELECT count(*) FROM events) - 0.8) - sqrt(greatest(1, ln(greatest(2, (SELECT count(*) FROM events)))) / greatest(1, count(*)))"


@query(f"SELECT event_type, ({_SCORE})::DOUBLE AS score FROM events GROUP BY event_type ORDER BY 2, 1 LIMIT 1")
def provider_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    total = F.lit(e.count())
    ok = F.avg((F.col("event_type") != "error").cast("double"))
    n = F.count(F.lit(1))
    scores = e.groupBy("event_type").agg(limiter.provider_score(F.avg("value"), ok, n / total, total, n).alias("score"))
    return limiter.pick_provider(scores, "event_type", "score")
