"""Removal of lines that many documents share, whole corpus, by column expressions alone.

1. Texts are split at line ends and exploded with their positions. A line's key is the line without blanks at its ends and with A-Z in
   lower case; keys travel as two 64-bit hashes with independent seeds.
2. Distinct documents are counted for each key (rows of a key and a document fold first, then each key's counts, both before they
   are shuffled), together with the largest document id that holds it.
3. Lines of the keys in enough documents are found by a join on the hashes. The keys that hold more than a ``1 / HOT``-th of all repeated lines, of
   which there are fewer than ``HOT``, are broadcast, and their lines are dealt over ``SPREAD`` tasks.
4. The positions lost by a document meet its text again, which is the one time that texts are shuffled, and what is left is put together by position.

Defined results: a null or empty text is one empty line; rows without an id count as no document and lose the lines that are lost elsewhere; rows of one
id are one document for the counts, and each row gives its own result; a key's lines stay in its largest document, however often it
has them; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored

BLANKS = " \t\n\v\f\r"
MIN_DOCS, MIN_CHARS = 3, 20
#: Keys with more than a HOT-th of the repeated lines are dealt over SPREAD tasks each.
HOT, SPREAD = 1000, 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z in lower case; texts of ASCII alone take the faster way to the same result."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _keyed(own: DataFrame, min_chars: int) -> DataFrame:
    """(_id, _t, _pos, _h1, _h2) of every line whose key has ``min_chars`` code points."""
    lines = own.select("_id", "_t", F.posexplode(split_lines(F.col("_text"))).alias("_pos", "_line"))
    key = line_key(F.col("_line"))
    return lines.where(F.length(F.trim("_line", F.lit(BLANKS))) >= min_chars).select("_id", "_t", "_pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit("line"), key).alias("_h2"))


def repeated_keys(own: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_h1, _h2, _docs, _lines, _keeper) of the keys found in ``min_docs`` documents of ``own`` (_id, _t, _text)."""
    counted = _keyed(own, min_chars).groupBy("_h1", "_h2").agg(F.count_distinct("_id").alias("_docs"), F.count(F.lit(1)).alias("_lines"), F.max("_id").alias("_keeper"))
    return counted.where(F.col("_docs") >= min_docs)


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_dropped) for each row: the text without the lines that ``min_docs`` documents hold, except in the largest one."""
    # A row is told from others of its id by its text, so rows that are repeated as a whole share one list of positions.
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_t", F.xxhash64("_text"))
    keys = stored(repeated_keys(own, min_docs, min_chars))
    total = keys.agg(F.coalesce(F.sum("_lines"), F.lit(0))).first()[0]
    is_hot = F.col("_lines") > total // HOT + 1
    hot = keys.where(is_hot).select("_h1", "_h2", F.lit(SPREAD).alias("_spread"))
    lines = _keyed(own, min_chars).join(F.broadcast(hot), ["_h1", "_h2"], "left")
    dealt = lines.withColumn("_salt", F.when(F.col("_spread").isNull(), 0).otherwise(F.pmod(F.xxhash64("_id", "_pos"), F.lit(SPREAD)).cast("int")))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    lost = dealt.join(keys.select("_h1", "_h2", "_keeper", F.explode(salts).alias("_salt")), ["_h1", "_h2", "_salt"]).where(~F.col("_id").eqNullSafe(F.col("_keeper")))
    places = lost.groupBy(F.col("_id").alias("_of"), F.col("_t").alias("_of_t")).agg(F.collect_set("_pos").alias("_lost"))
    met = own.join(places, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_t") == F.col("_of_t")), "left").withColumn("_lines", split_lines(F.col("_text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_lost")
    rest = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    return met.select(
        F.col("_id").alias(id_col), F.when(F.col("_lost").isNull(), F.col("_text")).otherwise(rest).alias(text_col),
        F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )


SQL = r"""
with line as (
  select doc_id, unnest(string_split(coalesce("text", ''), chr(10))) as line, generate_subscripts(string_split(coalesce("text", ''), chr(10)), 1) as pos from documents
), keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line
), shared as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), judged as (
  select k.*, s.key is not null and k.doc_id <> s.keeper as lost from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, cast(sum(case when lost then 1 else 0 end) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from judged group by doc_id
"""
