"""Encoding and mixing."""

import random

import pytest

from stockroom.llm import bpe, mix

DOCS = "doc_id long, text string, source string, tokens string, ids string"


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder()


def test_same_ids_as_the_public_tokenizer(enc):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    public.encode_special_tokens = True
    rnd = random.Random(1)
    texts = ["", " ", "  ", "a  b \n c\t\n\n d", " leading", "trailing  ", "\r\n x", "don't DON'T 'll", "<|endoftext|> a", "naïve Ærø 日本語 данные 🔧⚙️", "x" * 3000, "١٢٣ ½ Ⅷ", "ACGT" * 500, "\x00\x1c y"]
    texts += ["".join(rnd.choice(" \n\ta'sé1.,日 ") for _ in range(rnd.randrange(1, 14))) for _ in range(1500)]
    assert [enc.encode(t) for t in texts] == [x.ids for x in public.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(None) == []


def test_only_failing_words_are_merged_exactly(enc):
    words = [w.encode() for w in (" configuration", "zzxqj", " Lagerstütze", "aaaaaaaaaaaaaaaa")]
    flat, counts = enc.encode_words(words)
    at = 0
    for w, n in zip(words, counts):
        assert flat[at : at + n].tolist() == enc.merge(w)
        at += n
    assert 0 <= enc.exact


def test_encode_column_keeps_rows_and_ignores_clashing_columns(spark, enc):
    rows = [(1, "hello world", "a", "x", "y"), (1, "hello world", "a", None, None), (2, None, None, None, None), (3, "", "b", "", ""), (4, "long " * 50_000, "b", "", "")]
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_column(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted((r[0], enc.encode(r[1])) for r in rows)
    assert bpe.encode_column(spark.createDataFrame([], DOCS)).count() == 0


def test_quotas_fill_up_and_pass_on_what_a_source_cannot_give():
    assert mix.quotas({"a": 100, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2), "c": (0.0, 9)}, 110) == {"a": 90.0, "b": 20.0, "c": 0.0}
    assert mix.quotas({"a": 10}, {"a": (1.0, 1)}, 100) == {"a": 10.0}
    assert mix.quotas({}, {"a": (1.0, 3)}, 5) == {"a": 0.0}


def test_mixture_reaches_its_shares_within_a_document(spark, enc):
    rnd = random.Random(3)
    docs = [(i, "word " * rnd.randrange(1, 60), rnd.choice(["a"] * 8 + ["b", None]), "clash", "clash") for i in range(600)] + [(900, None, "a", "", ""), (901, "", "b", "", ""), (5, "word", "a", "", "")]
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.2, 3), ("gone", 0.1, 5), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, DOCS)
    got = mix.mixture(df, targets).collect()
    budget = sum(len(enc.encode(d[1])) for d in docs)
    held = {s: sum(len(enc.encode(d[1])) for d in docs if d[2] == s) for s in "ab"}
    want = mix.quotas(held, {"a": (0.7, 1), "b": (0.2, 3), "gone": (0.1, 5)}, budget)
    for s, most in (("a", 1), ("b", 3)):
        mine = [r for r in got if r.source == s]
        assert max(r.copies for r in mine) <= most and min(r.copies for r in mine) >= 1
        assert abs(sum(r.tokens * r.copies for r in mine) - want[s]) <= 60
    report = {r.source: r for r in mix.shares(mix.mixture(df, targets), targets).collect()}
    assert report["gone"].tokens == 0 and abs(sum(r.share for r in report.values()) - 1) < 1e-9
    assert mix.mixture(df.limit(0), targets).count() == 0 and mix.mixture(df, targets.limit(0)).count() == 0


def test_mixture_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(mix, "LANE_ROWS", 30)
    rows = [(i // 2 if i < 40 else i, "word " * (1 + i * 7 % 23), "ab"[i % 3 == 0], "", "") for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    one = sorted(tuple(r) for r in mix.mixture(df.coalesce(1), targets).collect())
    assert one and one == sorted(tuple(r) for r in mix.mixture(df.orderBy("text").repartition(7), targets).collect())


def test_flight_keeps_both_totals():
    rnd = random.Random(4)
    units, done = [], []
    sizes = [rnd.randrange(1, 900) for _ in range(3000)]
    for i, t in enumerate(sizes):
        units.append([i, t, 0.37])
        if len(units) == 3:
            mix._fly(units, done, 7)
    count = sum(x[2] for x in [*done, *units])
    tokens = sum(x[1] * x[2] for x in [*done, *units])
    assert abs(count - 0.37 * 3000) < 1e-3 and abs(tokens - 0.37 * sum(sizes)) < 1 and len(units) <= 2
    assert {x[2] for x in done} <= {0.0, 1.0}
