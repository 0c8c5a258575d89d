import zlib

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import langid, quality, toxicity
from corvane.llm.common import held_out

SF = "/root/testdata/sf0.01"
ODD = [(10**7, None, "en"), (10**7 + 1, "", None), (10**7 + 2, "12 %% 3", "fr"), (10**7 + 3, "漢字 かな カナ 漢字", None), (10**7 + 4, "a" * 50_000, None), (10**7 + 5, "the of " * 40_000, "en"), (None, "the and of", "en"), (10**7 + 5, "the of " * 40_000, "en")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(rows)


@pytest.fixture(scope="module")
def labels(spark):
    odd = spark.createDataFrame([(None, 1, 0), (10**7, None, None), (10**7 + 2, 0, 0)], "doc_id long, quality int, toxic int")
    return spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").unionByName(odd)


def test_hold_out_is_the_crc_of_the_decimal_id(docs):
    got = {r[0]: r[1] for r in docs.select("doc_id", held_out("doc_id", 4, 2)).collect()}
    assert all(v == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, v in got.items())


def test_character_models_are_normalised():
    words = ["the", "then", "than", "a", "at", "tea"]
    tables = langid.train(words, np.array([5, 2, 1, 7, 3, 1]))
    model = langid.Models({"x": tables})
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]
    # After "th": the words th+c+... share all symbols but those after it, so compare by direct lookup.
    total = 0.0
    for prefix in ("th", "zz"):
        whole = 0.0
        base = model.word_scores([prefix])[0][0, 0]
        hashes, longest, _ = langid._grams([prefix])
        end = np.exp(base - _score_until(model, prefix))
        for c in letters:
            whole += np.exp(_score_until(model, prefix + c) - _score_until(model, prefix))
        rest = langid.ALPHABET - len(letters) - 1
        unseen = np.exp(_score_until(model, prefix + "一") - _score_until(model, prefix))
        total = whole + end + rest * unseen
        assert total == pytest.approx(1, abs=2e-3)


def _score_until(model, text):
    """Log-probability of the symbols of ``text``, its end mark left out."""
    hashes, longest, _ = langid._grams([text])
    score = 0.0
    for i in range(1, len(text) + 1):
        for k in range(int(longest[i]), 0, -1):
            at = langid._find(model.hash[k - 1], hashes[k][i : i + 1])[0]
            if at >= 0:
                score += float(model.log_p[k - 1][at, 0])
                break
            if k > 1:
                c = langid._find(model.hash[k - 2], hashes[k - 1][i - 1 : i])[0]
                score += float(model.log_back[k - 2][c, 0]) if c >= 0 else 0.0
        else:
            score += float(model.floor[0])
    return score


def test_language_held_out_accuracy_and_odd_rows(spark, docs):
    models = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    rows = langid.identify(docs, models).withColumn("held_out", held_out("doc_id", 4, 2)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out and r.doc_id < 10**7]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.99
    assert not any(r.rejected for r in held)
    odd = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id >= 10**7}
    assert [odd[10**7 + i].lang_pred for i in range(3)] == ["und"] * 3
    assert odd[10**7 + 3].rejected and odd[10**7 + 3].lang_pred in models.languages
    assert odd[10**7 + 5].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    assert len(rows) == docs.count()
    assert langid.keep_identified(docs, models).where("doc_id < 10000000").count() == docs.where("doc_id < 10000000").count()


FOREIGN = [
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
    "minden emberi lény szabadon születik és egyenlő méltósága és joga van az emberek ésszel és lelkiismerettel bírván egymással szemben testvéri szellemben kell hogy viseltessenek",
    "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
    "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler",
]


def test_wrong_labels_and_garbled_rows_dont_widen_the_rejection_limit(spark, docs):
    rng = np.random.default_rng(3)
    rows = [tuple(r) for r in docs.where("doc_id < 10000000 and lang is not null").collect()]
    names = sorted({r[2] for r in rows})
    noisy = []
    for i, t, lang in rows:
        kind = zlib.crc32(f"noise {i}".encode()) % 50
        if kind == 0:
            lang = names[(names.index(lang) + 1) % len(names)]
        if kind == 1:
            t = " ".join("".join(chr(c) for c in rng.integers(ord("a"), ord("z") + 1, 7)) for _ in range(60))
        noisy.append((i, t, lang))
    models = langid.fit(spark.createDataFrame(noisy, "doc_id long, text string, lang string"))
    assert all(models.decide(pa.array(FOREIGN))[2])
    assert not any(models.decide(pa.array([r[1] for r in rows]))[2])


def test_nothing_to_learn(spark, docs, labels):
    none = docs.limit(0)
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.identify(docs.limit(3), None).collect()} == {"und"}
    assert langid.identify(none, None).count() == 0
    model = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.limit(3), model).collect()} == {0.5}
    field = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs.limit(3), field).collect()} == {0.0}
    assert quality.score(none, model).count() == toxicity.score(none, field).count() == 0


@pytest.mark.parametrize(("module", "column", "level", "least"), [(quality, "quality", 0.3, 0.97), (toxicity, "toxic", 0.5, 0.95)])
def test_held_out_accuracy(spark, docs, labels, module, column, level, least):
    rule = held_out("doc_id", 5, 0)
    model = module.fit(docs, labels.where(~rule), column)
    rows = {r.doc_id: r.score for r in module.score(docs, model).where(rule).collect()}
    truth = {r.doc_id: r[column] for r in labels.where(rule).collect() if r[column] is not None}
    assert np.mean([(rows[i] >= level) == y for i, y in truth.items() if i in rows]) >= least
    odd = module.score(docs.where("doc_id is null or doc_id >= 10000000"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)


def test_quality_score_is_independent_of_slices(docs):
    texts = docs.toArrow().column("text").combine_chunks()
    whole = quality.statistics(texts)
    parts = np.vstack([quality.statistics(texts.slice(i, 7)) for i in range(0, len(texts), 7)])
    assert np.allclose(whole, parts)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    move, start = rng.normal(size=(2, 2)), 0.3
    lengths = [1, 4, 7, 1, 3]
    emission = rng.normal(size=sum(lengths)) * 3
    first = np.zeros(sum(lengths), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    p, pair = toxicity.forward_backward(emission, first, start, move)
    at = 0
    for n in lengths:
        weights, marginal, pairs = 0.0, np.zeros(n), np.zeros((n, 4))
        for path in np.ndindex(*[2] * n):
            s = start * path[0] + sum(emission[at + i] * path[i] for i in range(n)) + sum(move[path[i - 1], path[i]] for i in range(1, n))
            weights += np.exp(s)
            marginal += np.exp(s) * np.array(path)
            for i in range(1, n):
                pairs[i, 2 * path[i - 1] + path[i]] += np.exp(s)
        assert np.allclose(p[at : at + n], marginal / weights)
        assert np.allclose(pair[at : at + n], pairs / weights)
        at += n
    long = rng.normal(size=1000)
    one = np.zeros(1000, bool)
    one[0] = True
    a, _ = toxicity.forward_backward(long, one, start, move)
    alpha = np.array([1, np.exp(start + long[0])])
    forward = [alpha / alpha.sum()]
    for e in long[1:]:
        alpha = (forward[-1] @ np.exp(move)) * [1, np.exp(e)]
        forward.append(alpha / alpha.sum())
    assert a[-1] == pytest.approx(forward[-1][1])


def test_toxic_spans_are_offsets_of_words(spark, docs, labels):
    field = toxicity.fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    text = "İ — the Idiot, 12 and the moron; stupid SCUM trash"
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), field, with_spans=True).first()
    assert row.score > 0.5 and {text[s.start : s.end] for s in row.spans} <= {"Idiot", "moron", "stupid", "SCUM", "trash"} and row.spans
    assert all(s.score >= toxicity.SPAN_LEVEL for s in row.spans)
    assert toxicity.score(docs, field, with_spans=True).where("size(spans) > 0").count() > 0


def plain_gradient(texts, y, words, theta, places):
    """By enumeration of all label rows: the log-likelihood of the labels that ``words`` give."""
    total = 0.0
    for t, label in zip(texts, y, strict=True):
        own = t.split()
        emission = [theta[-6] + sum(theta[places[f]] for f in toxicity.features(w) if f in places) for w in own]
        move = theta[-4:].reshape(2, 2)

        def weight(path):
            return sum(e * s for e, s in zip(emission, path)) + theta[-5] * path[0] + sum(move[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, B905

        truth = [int(label and w in words) for w in own]
        total += weight(truth) - np.log(sum(np.exp(weight(path)) for path in np.ndindex(*[2] * len(own))))
    return total


def test_gradient_is_of_the_likelihood():
    texts, y = ["bad words here", "bad badly", "a good text here", "words"], np.array([1, 1, 0, 1])
    odds = {"=bad": 3.0, "badl": 2.0, "=words": 0.7, "=here": 0.6}
    places = {f: i for i, f in enumerate(odds)}
    assert toxicity.toxic_words(["bad", "badly", "words", ""], odds).tolist() == [True, True, False, False]
    chains = toxicity.Chains(pa.array(texts), y, [odds], [places])
    theta = np.random.default_rng(1).normal(size=len(odds) + 6)
    got = chains.gradient(0, theta)
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        up, down = (plain_gradient(texts, y, {"bad", "badly"}, theta + s, places) for s in (step, -step))
        assert got[i] == pytest.approx((up - down) / 2e-5, abs=1e-6), i


def test_toxicity_aggregates_and_score():
    field = toxicity.Field()
    field.weights, field.bias, field.curve = {"=bad": 6.0}, -3.0, np.array([1.0, 2.0, 0.5, -0.1, 0.0, -1.5])
    texts = ["a bad bad text", None, "bad"]
    value, (p, *_) = field.score(pa.array(texts))
    at = 0
    for v, t in zip(value, texts, strict=True):
        n = max(len((t or "").split()), 1)
        own = p[at : at + n]
        at += n
        total, share = sum(own), sum(own) / n
        z = np.log1p(total) + 2 * max(own) + 0.5 * share**0.5 - 0.1 * np.log1p(n) / 5 - 1.5
        assert v == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_is_the_difference_of_plain_log_densities(docs, labels):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(60, len(quality.FEATURES))), rng.normal(0.7, 1.4, size=(60, len(quality.FEATURES)))])
    model = quality.Discriminant(x, np.repeat([0, 1], 60), 0.0)
    z = (x - model.centre) / model.scale
    log = []
    for mean, factor in zip(model.means, model.factors, strict=True):
        covariance = factor @ factor.T
        log.append([-0.5 * (r - mean) @ np.linalg.inv(covariance) @ (r - mean) - 0.5 * np.linalg.slogdet(covariance)[1] for r in z])
    assert np.allclose(model._difference(x), np.array(log[1]) - np.array(log[0]))


def plain_kneser_ney(words, counts, order):
    """Probability of a character after a context, by the recursive definition over dictionaries."""
    grams = [{} for _ in range(order + 1)]
    for w, c in zip(words, counts, strict=True):
        text = "\n" + w + "\n"
        for i in range(1, len(text)):
            for k in range(1, min(order, i + 1) + 1):
                g = text[i - k + 1 : i + 1]
                grams[k][g] = grams[k].get(g, 0) + c
    for k in range(1, order):
        left = {}
        for g in grams[k + 1]:
            left.setdefault(g[1:], set()).add(g[0])
        grams[k] = {g: len(left[g]) if g in left else n for g, n in grams[k].items()}

    def p(g):
        k = len(g)
        if not k:
            return 1 / langid.ALPHABET
        n1, n2 = (sum(v == x for v in grams[k].values()) for x in (1, 2))
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        same = [v for x, v in grams[k].items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(grams[k].get(g, 0) - discount, 0) / sum(same) + discount * sum(min(v, 1) for v in same) / sum(same) * p(g[1:])

    return p


def test_character_models_equal_the_definition():
    words, counts = ["the", "then", "than", "a", "at", "tea", "thethe"], np.array([5, 2, 1, 7, 3, 1, 2])
    model = langid.Models({"x": langid.train(words, counts)})
    p = plain_kneser_ney(words, counts.tolist(), langid.ORDER)
    for w in ("the", "that", "zeta", "nat", "a", "thethen"):
        text = "\n" + w + "\n"
        want = sum(np.log(p(text[max(0, i - langid.ORDER + 1) : i + 1])) for i in range(1, len(text)))
        assert model.word_scores([w])[0][0, 0] == pytest.approx(want, rel=1e-4), w


@pytest.mark.parametrize("module", [langid, quality, toxicity])
def test_other_columns_may_clash(spark, docs, labels, module):
    """Columns named as those that the operators make."""
    more = docs.where("doc_id < 400 or doc_id is null").selectExpr("*", "'x' AS score", "1 AS spans", "2 AS _label", "'y' AS lang_pred", "3 AS rejected", "4 AS _place")
    if module is langid:
        found = langid.identify(more, langid.fit(more))
    else:
        column = "quality" if module is quality else "toxic"
        found = module.score(more, module.fit(more, labels.withColumn("text", labels[column]).withColumn("score", labels[column]), column))
    assert found.count() == more.count() and found.where("score between 0 and 1").count() == more.count()
