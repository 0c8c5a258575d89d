import hashlib
import random

import duckdb
import pytest

from corvane.llm import line_dedup

LONG = "a line that is long enough"
BLANKS = " \t\n\v\f\r"


def plain(rows, min_docs=3, min_chars=20):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda line: line.strip(BLANKS).translate(lower)
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                held.setdefault(key(line), set()).add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def odd_rows():
    random.seed(5)
    some = [f"shared line number {n} of all" for n in range(12)] + [f"  Shared LINE number {n} of all\t\r" for n in range(12)]
    some += ["short", "", "   ", "ÄÖÜ is not lowered in this line", "äöü is not lowered in this line", "\xa0 no blank is cut here, surely", "漢字" * 10, "漢字" * 9 + "x", "x" * 20, "X" * 20, "x" * 19]
    rows = [(i, random.choice(["\n", "\n", "\n\n"]).join(random.choices(some, k=random.randint(0, 15))), "z", 1) for i in range(150)]
    rows += [(200, None, "z", 1), (201, "", None, 1), (202, "\n", "z", 1), (203, "\n".join([LONG] * 3000), "z", 1), (204, LONG, "z", 1), (205, LONG.upper() + " \n end", "z", 1)]
    rows += rows[:5] + [(7, "another text of id 7\n" + some[0], "z", 1), (None, LONG + "\n" + "rest", "z", 1), (None, "y", "z", 1)]
    return rows


@pytest.mark.parametrize("hot", [line_dedup.HOT, 3])
def test_equals_the_plain_way(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)  # with 3, shares are dealt out
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, _pos int").repartition(6)
    got = sorted((tuple(r) for r in line_dedup.drop_repeated_lines(docs).collect()), key=repr)
    assert got == plain(rows) and sum(r[3] for r in got) > 100


def test_thresholds_and_names(spark):
    rows = [("a", "one\ntwo"), ("b", "two\nthree"), ("c", "THREE")]
    docs = spark.createDataFrame(rows, "name string, body string")
    got = sorted(tuple(r) for r in line_dedup.drop_repeated_lines(docs, 2, 3, "name", "body").collect())
    assert got == plain(rows, 2, 3) == [("a", "one", 2, 1), ("b", "two", 2, 1), ("c", "THREE", 1, 0)]


def test_sql_says_the_same(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] is not None][:-6]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    path = str(tmp_path / "d.parquet")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    got = sorted(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({line_dedup.SQL})").fetchall())
    assert got == sorted((i, n, lost, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, lost in plain(rows))


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
