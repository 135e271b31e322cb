"""Operators that learn, on held-out rows; and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quiver.llm import decontaminate, language, lines, rules, simhash, similar, tokens, toxicity
from quiver.llm.queries import tokenizer_path


def test_nnpu_finds_the_positives():
    rng = np.random.default_rng(0)
    def sample(n, toxic):
        return [np.unique(np.concatenate((rng.integers(100, 5000, 40), rng.integers(0, 10, 3) if t else []))).astype(np.int64) for t in toxic[:n]]
    mixed = rng.random(4000) < 0.1
    model = toxicity.fit(sample(400, [True] * 400), sample(4000, mixed), 0.1)
    truth = rng.random(1000) < 0.5
    test = sample(1000, truth)
    s = model.score(np.concatenate(([0], np.cumsum([len(x) for x in test]))), np.concatenate(test))
    assert ((s >= 0.3) == truth).mean() > 0.97 and ((0 <= s) & (s <= 1)).all()


def test_risk_is_not_pushed_below_zero():
    """With the positives repeated among the unlabelled, their scores stay high."""
    p = [np.array([1, 2]), np.array([1, 3])] * 50
    model = toxicity.fit(p, p + [np.array([7 + i % 50]) for i in range(900)], 0.1)
    s = model.score(np.array([0, 2, 3]), np.array([1, 2, 9]))
    assert s[0] > 0.5 > s[1]


def test_settings_come_from_an_inner_fold():
    """The pick sees training rows alone, fits on three quarters of them, and is the same again."""
    rng = np.random.default_rng(1)
    clean = [np.unique(rng.integers(100, 3000, 30)).astype(np.int64) for _ in range(1500)]
    toxic = [np.unique(np.concatenate((rng.integers(100, 3000, 30), rng.integers(0, 12, 3)))).astype(np.int64) for _ in range(200)]
    far, decay, shift = toxicity.pick(toxic, clean + toxic[:160], 0.1)
    assert (far, decay) in toxicity.SETTINGS and (far, decay, shift) == toxicity.pick(toxic, clean + toxic[:160], 0.1)
    assert toxicity.pick([], clean, 0.1) == (*toxicity.SETTINGS[0], 0.0)
    model = toxicity.fit(toxic, clean, 0.1, far=far, decay=decay)
    s = model.score(np.cumsum([0, *map(len, toxic + clean)]), np.concatenate(toxic + clean))
    assert (s[:200] >= 0.3).mean() > 0.9 and (s[200:] >= 0.3).mean() < 0.1


def test_toxicity_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(100)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    blank = toxicity.train(empty, labels.limit(0))
    assert toxicity.score(empty, blank).count() == 0 and len({r.score for r in toxicity.score(docs, blank).collect()}) == 1


def brute_phrases(reference: str, text: str) -> int:
    n, at = 0, 0
    while at < len(text):
        k = 0
        while at + k < len(text) and text[at : at + k + 1] in reference:
            k += 1
        n += 1
        at += max(1, k)
    return n


@pytest.mark.parametrize("block", [512, 7, 1])
def test_phrases_are_longest_matches(monkeypatch, block):
    """Over blocks too, with letters that the reference lacks, and where readings never meet."""
    monkeypatch.setattr(language, "BLOCK", block)
    rng = random.Random(0)
    reference = "".join(rng.choice("abc ") for _ in range(300)).replace("  ", " ")
    model = language.build({"x": reference, "y": "ab" * 40})
    texts = ["".join(rng.choice(x) for _ in range(rng.choice([0, 1, 5, 80, 700]))) for x in ["abc "] * 20 + ["abcdz "] * 20]
    texts += ["abc" * 300, "ab" * 700, "b" + "ab" * 50, reference * 3, "zzz", "d" * 30]
    read = [language.letters(t) for t in texts]
    got = language.phrases(model, read)
    for row, inside in zip(got, (reference, "ab" * 40), strict=True):
        inside = "".join(map(chr, language.letters(inside)))
        assert row.tolist() == [brute_phrases(inside, "".join(map(chr, x))) for x in read]


def test_automaton_holds_exactly_the_parts():
    t = [1, 2, 1, 1, 2, 3, 1]
    states = language.automaton(t)
    parts = {tuple(t[a:b]) for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    def walk(x):
        s = 0
        for c in x:
            if c not in states[s]:
                return False
            s = states[s][c]
        return True
    assert all(walk(p) for p in parts) and not walk((3, 2)) and not walk((2, 2))


def test_language(spark, empty):
    rng = random.Random(2)
    vocabulary = {"aa": ["the", "thing", "and", "ring"], "bb": ["une", "chose", "et", "bague"], "cc": ["ein", "ding", "und", "größe"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(60)), lang) for i, lang in enumerate(list(vocabulary) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs.where("doc_id < 90"))
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "12 !? 34"), (903, "é"), (None, "the thing and")], "doc_id long, text string")
    got = language.identify(docs.where("doc_id >= 90").select("doc_id", "text"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got) and len(got) == 30
    other = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [other[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and other[903].lang_pred != "und" and other[None].lang_pred == "aa"
    nothing = language.learn(empty)
    assert {r.lang_pred for r in language.identify(docs.select("doc_id", "text"), nothing).collect()} == {"und"}


def test_pipeline(spark, tmp_path, docs, rows):
    names = ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "source mixing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    leak = next(t for i, t, *_ in rows if i == 20)
    spark.createDataFrame([(1, " ".join(leak.split()[:30]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = docs.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        assert after.count() <= before.count()
        if name != names[-1]:
            assert set(after.columns) == set(corpus_pipeline.COLUMNS)
            before = spark.createDataFrame(after.collect(), after.schema)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(got) == after.count()


def test_pipeline_keeps_a_holder_of_each_line(spark, tmp_path):
    """Near copies that differ by a shared line alone: the one that still holds it stays, at either end of the ids."""
    words = lambda tag, n: " ".join(f"{tag}w{j}" for j in range(n))
    shared = "this is a line of more than forty characters that many documents hold"
    rows = [(i, f"{words(f'd{i}', 120)}\n{shared}\n{words(f'e{i}', 90)}", "en", "s", 1) for i in range(1, 7)]
    rows += [(10, rows[0][1].replace("d1w3 ", "changed "), "en", "s", 1), (11, rows[1][1].replace("d2w3 ", "changed "), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lined = corpus_pipeline.line_dedup(spark, docs, str(tmp_path))
    assert [r.doc_id for r in lined.collect() if shared in r.text] == [11]
    kept = corpus_pipeline.near_dedup(spark, lined, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 5, 6, 10, 11] and sum(shared in r.text for r in kept) == 1
    # of equal lengths the largest id, of known and null ids the known one
    odd = [(2, words("q", 30), None, None, None), (5, words("q", 30), "en", None, 3), (None, words("q", 30), None, "s", 1), (None, None, None, None, None), (None, "", None, None, None)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(odd, docs.schema), str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 5]


def test_stages_keep_columns_with_inner_names(spark, docs):
    """Columns named like the operators' own stay; reserved names are refused."""
    named = docs.select("doc_id", "text", "lang", F.lit(1).alias("__doc"), F.lit(2).alias("__text"), F.lit(3).alias("__row"), F.lit(4).alias("a.b"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "no such words in any text")], "item_id long, text string")
    for got in (rules.keep_good(named, labels), decontaminate.drop_leaked(named, bench), similar.keep_first(named), simhash.keep_first(named)):
        row = got.first()
        assert got.columns == named.columns and (row["__doc"], row["__text"], row["__row"], row["a.b"]) == (1, 2, 3, 4)
    with pytest.raises(ValueError):
        lines.dedup_lines(docs.withColumn("n_lines", F.lit(1)), carry=("n_lines",))


def test_bytes_that_are_no_utf8(spark):
    """They count as replaced characters; no operator fails."""
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF6220C3' AS string) AS text, 'en' AS lang, 's' AS source")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 1
    assert decontaminate.leaks(docs, bench).count() == 0
    assert language.identify(docs, language.learn(docs)).first().lang_pred == "en"
    assert tokens.count_tokens(docs, tokenizer_path()).first().n_bytes == 5


def test_entry_lists_all():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in e.queries()} and "pipeline" in e.queries()
