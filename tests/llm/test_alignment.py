import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
random.seed(3)
ODD = [None, "", " ", "  ", "a", " a  b ", "don't  '  x\x1c! \x1c\x85 y", "<|endoftext|> <s>a</s> <unk> x", "x" * 700, "▁ a▁b", "tab\t \n  x\r\n y \xa0 z \xa0", "漢字 かな　漢 字", "é é​ ᠎ 👩‍👩‍👧 a﻿ b", "word " * 150]
ODD += ["".join(random.choice(" \n\t\r\x0b\x1c 　ab'st12!.é漢́▁ᠠ") for _ in range(random.randint(1, 60))) for _ in range(250)]
ODD += [" ".join("".join(random.choice("thenßéräouqç") for _ in range(random.randint(1, 9))) for _ in range(random.randint(1, 50))) + "." for _ in range(40)]
ODD += ODD[3:9]


def plain(texts):
    """Each text encoded whole, links by comparing ranges, counts over a dictionary."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table = {chr(c): c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255}
    table |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if chr(c) not in table)}
    found = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            found.append(([], [], [], []))
            continue
        ranges = [[], []]
        for k, tokens in enumerate((bytes_a, bytes_b)):
            at = 0
            for x in tokens:
                ranges[k].append((at, at + len(x)))
                at += len(x)
        links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(ranges[0]) for j, (u, v) in enumerate(ranges[1]) if s < v and u < e]
        both = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups = ["|".join(",".join(str(i) for i, (s, e) in zip(ids, r, strict=True) if low <= s and e <= high) for ids, r in ((ids_a, ranges[0]), (ids_b, ranges[1]))) for low, high in zip([0, *both], both, strict=False)]
        found.append((ids_a, ids_b, groups, links))
    held = {}
    for _, _, _, links in found:
        for pair in set(links):
            held[pair] = held.get(pair, 0) + 1
    best = {}
    for (i, _), c in held.items():
        best[i] = max(best.get(i, 0), c)
    return [(len(x), len(y), len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", ";".join(g)) for x, y, g, links in found]


WANTED = plain(ODD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_a int, block string").repartition(5)


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 300])
def test_equals_the_plain_way(docs, block):
    got = {r[0]: tuple(r)[1:] for r in alignment.align(docs, A, B, with_groups=True, block_bytes=block).collect()}
    wanted = WANTED
    assert len(got) == len(ODD) and any(w[0] for w in wanted) and any(not w[0] for w in wanted[1:])
    for i, t in enumerate(ODD):
        assert got[i] == wanted[i], t


def test_long_texts_in_parts(docs, spark, monkeypatch):
    text = " ".join(t for t in ODD[-40:] if t and "▁" not in t)
    monkeypatch.setattr(alignment, "PART", 500)
    own = alignment.Aligner(A, B)
    long, short = alignment._Documents(True), alignment._Documents(True)
    monkeypatch.setattr(alignment, "KEPT_BYTES", 10_000)
    long.add_long(own, text)
    monkeypatch.setattr(alignment, "PART", 1 << 20)
    short.add(own, [own.pieces(text)])
    assert long.rows[0][1:] == short.rows[0][1:] and list(long.rows[0][0]) == list(short.rows[0][0])
    assert all(list(x[0]) == list(y[0]) for x, y in ((long.pairs, short.pairs), (long.links, short.links), (long.sizes, short.sizes)))
    assert short.rows[0][2] == plain([text])[0][7]
    long.add_long(own, text + " ▁")
    assert long.rows[1][1:] == ("", "") and long.sizes[1][0] == 0


def test_tokens_that_cannot_be_told_apart_go_alone():
    own = alignment.Aligner(A, B)
    spaced = [" alpha", " beta,", " gamma"]
    for encoder in (own.encoder_a, own.encoder_b):
        together = encoder.flat(spaced, alignment.np.array([6, 6, 6]), True)
        alone = encoder.flat(spaced, alignment.np.array([5, 7, 6]), True)  # sizes that don't fit
        assert all((x == y).all() for x, y in zip(together, alone, strict=True))


def test_empty_table_and_other_id_types(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B).collect() == []
    got = alignment.align(spark.createDataFrame([(None, "a b"), ("k", None)], "name string, body string"), A, B, "name", "body").orderBy("name").collect()
    assert [(r.name, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in got] == [(None, 2, 2, 2, 2, 2, 2), ("k", 0, 0, 0, 0, 0, 0)]
    assert got[1].groups_sha256 == ""


def test_unfit_vocabulary_is_refused(spark):
    with pytest.raises(ValueError):
        alignment.Aligner(P.path("word_bpe_49k.json"), B)


def test_workers_keep_no_pieces_after_a_task(docs, spark):
    alignment.blocks(docs, A, B).write.format("noop").mode("overwrite").save()

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            own = alignment._worker(A, B)
            yield pa.RecordBatch.from_arrays([pa.array([len(own.index) + len(own.groups) + own.held] * batch.num_rows, pa.int64())], ["n"])

    assert {r.n for r in spark.range(0, 400, 1, 40).mapInArrow(kept, "n long").collect()} == {0}


def test_a_file_holds_few_blocks_and_no_array_of_all_pairs(docs, spark, monkeypatch):
    kept, real = [], alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda *a, **b: kept.append(real(*a, **b)) or kept[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r[0]: tuple(r)[1:] for r in alignment.align(docs.coalesce(1), A, B, with_groups=True, block_bytes=1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got[i] for i in range(len(ODD))] == WANTED
    blocks = [r.asDict() for r in kept[0].selectExpr("input_file_name() AS file", "*").collect()]
    files = [r["file"] for r in blocks]
    assert len(blocks) > 20 and max(map(files.count, files)) <= 8
    own = alignment.Aligner(A, B)
    found = alignment._Documents(False)
    found.add(own, [own.pieces(t) if t else [] for t in ODD])
    n_pairs = sum(map(sum, found.sizes))
    assert sum(sum(r["sizes"]) for r in blocks) == n_pairs
    for column in blocks[0]:
        assert isinstance(blocks[0][column], (str, bytes, bytearray)) or sum(len(r[column] or ()) for r in blocks) < n_pairs, column


def test_packed_pairs_come_back():
    for places, links in (([], []), ([0], [1]), ([5, 2**31 - 1, 0, 7], [1, 2**31 - 1, 300, 70_000]), (list(range(0, 9000, 3)), [1, 2, 257] * 1000)):
        got = alignment._unpacked(alignment._packed(alignment.np.array(places, int), alignment.np.array(links, int)), len(places))
        assert [x.tolist() for x in got] == [places, links]
    assert len(alignment._packed(alignment.np.arange(0, 9000, 3), alignment.np.ones(3000, int))) < 3000
