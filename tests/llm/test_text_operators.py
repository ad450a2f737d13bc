"""Passages, similarity join, backoff scores, quality rules, language and pieces against plain restatements."""

import collections
import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from tallyhouse.llm import backoff, benchmarks, components, jaccard, language, passages, pieces, quality, words


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_words_and_hashes():
    texts = ["a b  c", None, "", " \t x\n", "héé wörld", "abc", "abc def"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for most in (5, 10_000):
        found = {}
        for _, _, w in words.slices(batch, "text", most):
            for s, e, h in zip(w.start, w.end, w.hashes()):
                found.setdefault(bytes(w.data[s:e]).decode(), set()).add(int(h))
        assert set(found) == {x for t in texts for x in brute.words(t)}
        assert all(len(v) == 1 for v in found.values()) and len(set.union(*found.values())) == len(found)


@pytest.mark.parametrize("width,k", [(35, 12), (6, 3), (3, 3)])
def test_passages_on_documents(documents, width, k):
    docs = documents.select("doc_id", "text").toPandas().sort_values("doc_id")
    got = passages.remove_repeated(documents, width=width, k=k, keep=["doc_id"]).toPandas().sort_values("doc_id")
    assert list(zip(got.n_words, got.n_removed, got.kept_sha256)) == brute.kept_words(list(docs.text), width)


def test_passages_random_words(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 60))) for _ in range(60)] + ["a " * 40, "a " * 8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict((r[0], r[1:]) for r in rows_of(passages.remove_repeated(df, width=7, k=3), "doc_id", "n_words", "n_removed", "kept_sha256"))
    assert [got[i] for i in range(len(texts))] == brute.kept_words(texts, 7)


def test_passages_odd_rows(odd):
    got = passages.remove_repeated(odd)
    assert got.columns == [*odd.columns, "n_words", "n_removed", "kept_sha256", "kept_text"]
    local = odd.toPandas()
    exp = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), *e) for r, e in zip(local.itertuples(), brute.kept_words(list(local.text), 35)))
    assert collections.Counter(rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256")) == exp
    assert passages.remove_repeated(odd.limit(0)).count() == 0


def test_band_shape():
    rows, bands = jaccard.band_shape(0.8, 0.999, 144)
    assert rows * bands <= 144 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def near_copies(seed, n, words_each=60):
    draw = random.Random(seed)
    base = [draw.choice("abcdefghij") + str(draw.randint(0, 99)) for _ in range(words_each)]
    out = []
    for _ in range(n):
        w = list(base)
        if draw.random() < 0.8:
            w[draw.randrange(len(w))] = "changed" + str(draw.randint(0, 5))
        out.append(" ".join(w))
    return out


def check_join(spark, texts, monkeypatch=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(df).collect()}
    links, label = brute.similar_rows(texts)
    assert [got[i]["n_links"] for i in range(len(texts))] == links
    assert [got[i]["class_id"] for i in range(len(texts))] == label
    kept = sorted(r["doc_id"] for r in jaccard.one_per_group(df).collect())
    assert kept == sorted(set(label))


def test_join_on_documents(spark, documents):
    check_join(spark, [r["text"] for r in documents.orderBy("doc_id").select("text").collect()])


def test_join_of_groups_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "UNIT_BYTES", 20_000)
    texts = [t for seed, n in ((1, 40), (2, 3), (3, 2), (4, 90)) for t in near_copies(seed, n)] + ["", "  ", "x", "x", "y", "x y z"]
    check_join(spark, texts)


def test_join_odd_rows(odd):
    got = jaccard.near_duplicates(odd)
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert got.count() == odd.count()
    assert (by[1]["n_links"], by[2]["n_links"], by[2]["class_id"], by[3]["n_links"], by[4]["class_id"]) == (2, 2, 1, 0, 4)
    kept = jaccard.one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(
        [(False, i) for i in (1, 3, 4, 5, 6, 7, 8)] + [(True, 0)] * 2)
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0 and jaccard.one_per_group(odd.limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    got = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    assert got == {x: root(x) for x in label}


def test_backoff(spark, documents, monkeypatch):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(backoff, "BUCKET_GRAMS", 30_000)
    docs = documents.select("doc_id", "text").toPandas()
    got = backoff.score(documents).toPandas().set_index("doc_id").log_score
    for i, exp in zip(docs.doc_id, brute.backoff(list(docs.text))):
        assert got[i] == pytest.approx(exp, rel=1e-9)


def test_backoff_odd_rows(odd):
    local = odd.toPandas()
    got = backoff.score(odd)
    exp = sorted(round(x, 6) for x in brute.backoff(list(local.text)) if x is not None)
    assert sorted(round(r[0], 6) for r in rows_of(got, "log_score") if r[0] is not None) == pytest.approx(exp)
    assert got.count() == odd.count() and backoff.score(odd.limit(0)).count() == 0


def test_quality_counts(spark, documents, odd):
    draw = random.Random(2)
    more = [" ".join(draw.choice("ab") for _ in range(draw.randint(0, 40))) for _ in range(80)] + ["x y\nx y\n\n x y\nz", "a&b|c #$%<>*"]
    df = documents.select("doc_id", "text").union(odd.select("doc_id", "text")).union(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    trusted = documents.where("doc_id % 3 = 0").select("doc_id")
    got = quality.judge(df, trusted)
    counts = collections.Counter(rows_of(got, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    local = df.toPandas()
    assert counts == collections.Counter(brute.quality_counts(t) for t in local.text)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_quality_scores(spark):
    good = [(i, "the quiet river runs below the old stone bridge near town number " + str(i % 7) + " again and again today it seems fine here") for i in range(40)]
    bad = [(100 + i, "cheap pills buy now click win cash fast offer bonus deal spin jackpot free click here now cheap pills number " + str(i)) for i in range(40)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs, docs.where("doc_id < 30").select("doc_id")).collect()}
    assert all(got[i]["kept"] for i, _ in good) and not any(got[i]["kept"] for i, _ in bad)
    # Without trusted texts the base rules alone decide.
    none = quality.judge(docs, docs.limit(0).select("doc_id")).collect()
    assert {r["score"] for r in none} == {0.0} and all(r["kept"] == (not r["base_failed"]) for r in none)
    assert quality.judge(docs.limit(0), docs.select("doc_id")).count() == 0


def test_quality_score_is_the_ratio(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "c d"), (3, "a b")], "doc_id long, text string")
    flagged = quality.trusted_flag(docs, docs.where("doc_id = 1").select("doc_id"))
    arrays = quality.word_arrays(flagged)
    weights = quality.bucket_weights(arrays, 64)
    got = {r["doc_id"]: r["score"] for r in quality.judge(docs, docs.where("doc_id = 1").select("doc_id"), buckets=64).collect()}
    hashes = {r["doc_id"]: r["h1"] + r["h2"] for r in arrays.collect()}
    assert [len(hashes[i]) for i in (1, 2, 3)] == [5, 3, 3]
    raw, good = np.ones(64), np.ones(64)
    for i, h in hashes.items():
        for x in h:
            raw[x % 64] += 1
            good[x % 64] += i == 1
    assert weights == pytest.approx(list(np.log(good / good.sum()) - np.log(raw / raw.sum())))
    for i, h in hashes.items():
        assert got[i] == pytest.approx(np.mean([weights[x % 64] for x in h]))


def test_language(spark, documents, odd):
    model = language.train(documents.where(language.fold() != 2))
    got = language.predict(documents, model).withColumn("fold", language.fold()).toPandas()
    held = got[(got.fold == 2) & got.lang.notna()]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    strange = {r["doc_id"]: r for r in language.predict(odd, model).collect() if r["doc_id"] is not None}
    assert [strange[i]["lang_pred"] for i in (3, 4, 5, 7)] == ["und"] * 4
    assert strange[8]["lang_pred"] != "und" and strange[1]["score"] > 0
    assert language.predict(odd.limit(0), model).count() == 0
    assert {r[0] for r in rows_of(language.predict(odd, language.train(odd.limit(0))), "lang_pred")} == {"und"}


def test_language_mixture(spark, documents):
    model = language.train(documents)
    parts = {r["lang"]: r["t"] for r in documents.where("length(text) > 1500").groupBy("lang").agg(F.min("text").alias("t")).collect()}
    a, b = "en", "de" if "de" in parts else sorted(set(parts) - {"en"})[0]
    text = " ".join(parts[a].split()[:150] + parts[b].split()[:100])
    r = language.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r["lang_pred"] == a and set(r["langs"]) == {a, b} and 0.5 < r["score"] < 0.7


def test_decontamination(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    filler = ["filler" + str(i) for i in range(400)]
    rows, expected = [], {}
    for n, (i, t) in enumerate(items[:12]):
        w = t.split()
        if n % 3 == 1:
            w = [x.upper() + "!" for x in w]  # other case and punctuation
        if n % 3 == 2:
            w = w[:-1]  # one word short: similarity depends on the size of the item
        rows.append((n, " ".join(filler[:100 + n] + w + filler[200:])))
        if n % 3 != 2:
            expected[n] = [i]
    rows += [(50, " ".join(filler)), (51, None), (52, ""), (53, items[0][1]), (53, items[0][1]), (54, items[1][1] + " " + items[2][1])]
    expected |= {53: [items[0][0]], 54: sorted([items[1][0], items[2][0]])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: list(r["item_ids"]) for r in benchmarks.contaminated(docs, bench).collect()}
    assert {k: v for k, v in got.items() if k not in (2, 5, 8, 11)} == expected
    assert sorted(r["doc_id"] for r in benchmarks.without_contaminated(docs, bench).collect()) == sorted({r[0] for r in rows} - set(got))
    assert benchmarks.contaminated(docs.limit(0), bench).count() == 0 and benchmarks.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_against_all_windows(spark, documents):
    """Every item-sized window is compared with every item of its size on the exact similarity."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    import re

    def fold(t):
        return [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if x]

    def cut(w):
        k = min(5, len(w))
        return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)]

    items = [(r["item_id"], fold(r["text"])) for r in bench.collect()]
    uses = collections.Counter(s for _, w in items for s in set(cut(w)))
    weight = lambda s: 1 / uses[s] if s in uses else 1.0
    expected = {}
    known = set(uses)
    for r in documents.select("doc_id", "text").collect():
        w = fold(r["text"])
        if not known & set(cut(w)):
            continue
        for i, x in items:
            right = collections.Counter(cut(x))
            for a in range(len(w) - len(x) + 1):
                left = collections.Counter(cut(w[a:a + len(x)]))
                if not left.keys() & right.keys():
                    continue
                both = sum(weight(s) * min(n, right[s]) for s, n in left.items())
                union = sum(weight(s) * max(left[s], right[s]) for s in left.keys() | right.keys())
                if both / union >= 0.8 - 1e-9:
                    expected.setdefault(r["doc_id"], set()).add(i)
    got = {r["doc_id"]: set(r["item_ids"]) for r in benchmarks.contaminated(documents, bench).collect()}
    assert got == expected


def test_decontamination_of_texts_shorter_than_the_item(spark):
    """Whole documents that lack words of an item, with nothing around them."""
    words_ = ["item" + str(i) for i in range(59)]
    bench = spark.createDataFrame([(1, " ".join(words_))], "item_id long, text string")
    rows = [(1, words_), (2, words_[:-1]), (3, words_[1:]), (4, words_[:30] + words_[31:]), (5, words_[:48]), (6, words_[:47]), (7, words_[:40])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r["doc_id"]: (list(r["item_ids"]), r["similarity"]) for r in benchmarks.contaminated(docs, bench).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: [1] for i in (1, 2, 3, 4, 5)}
    assert [got[i][1] for i in (1, 2, 3, 4, 5)] == pytest.approx([1, 54 / 55, 54 / 55, 50 / 59, 44 / 55])
    assert [r["doc_id"] for r in benchmarks.without_contaminated(docs, bench).orderBy("doc_id").collect()] == [6, 7]


@pytest.mark.parametrize("copies", [1, 2, 9])
def test_decontamination_with_repeated_items(spark, copies):
    """Listing an item or a part of it again changes no similarity."""
    words_ = ["item" + str(i) for i in range(60)]
    shared = [(100 + n, " ".join(words_[:30] + [f"own{n}x{i}" for i in range(30)])) for n in range(copies - 1)]
    bench = spark.createDataFrame([(i, " ".join(words_)) for i in range(copies)] + shared, "item_id long, text string")
    changed = words_[:30] + ["changed"] + words_[31:]
    docs = spark.createDataFrame([(1, " ".join(["before"] * 9 + changed + ["after"] * 9))], "doc_id long, text string")
    got = [(list(r["item_ids"]), r["similarity"]) for r in benchmarks.contaminated(docs, bench).collect()]
    assert got == [(list(range(copies)), pytest.approx(51 / 61))]


def test_decontamination_in_several_passes(spark, monkeypatch):
    """Items that share shingles give the same similarities in any number of passes."""
    base = ["item" + str(i) for i in range(60)]
    texts = [base] + [base[:40] + [f"own{n}x{i}" for i in range(20)] for n in range(5)]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(texts)], "item_id long, text string")
    docs = spark.createDataFrame([(n, " ".join(["before"] * 9 + w[:20] + ["changed"] + w[21:] + ["after"] * 9)) for n, w in enumerate(texts)], "doc_id long, text string")
    for most in (1_000_000, 60):
        monkeypatch.setattr(benchmarks, "ITEM_WORDS", most)
        got = sorted((r["doc_id"], list(r["item_ids"]), round(r["similarity"], 9)) for r in benchmarks.contaminated(docs, bench).collect())
        assert got == [(n, [n], round(51 / 61, 9)) for n in range(6)]


def test_item_blocks_meet_all_within_the_radius():
    draw = np.random.default_rng(1)
    bounds = benchmarks._bounds()
    assert bounds[0][0] == 0 and bounds[-1][1] == benchmarks.BITS and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    for _ in range(200):
        flips = draw.choice(benchmarks.BITS, size=benchmarks.RADIUS, replace=False)
        assert min(sum(lo <= f < hi for f in flips) for lo, hi in bounds) <= benchmarks.RADIUS // benchmarks.BLOCKS


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.default_vocabulary()


def test_pieces_round_trip(documents, odd, vocabulary):
    for df in (documents, odd):
        got = pieces.encode_and_check(df, vocabulary)
        assert got.count() == df.count() and got.where("not exact").count() == 0
    assert rows_of(pieces.encode_and_check(odd, vocabulary).where("doc_id = 3"), "ids") == [(None,)]
    back = pieces.decode(pieces.encode(odd, vocabulary), vocabulary, out="back")
    assert back.where("not (text <=> back)").count() == 0
    kept = pieces.encode(odd.withColumn("ids", F.lit("x")), vocabulary)
    assert kept.columns == [*odd.columns, "ids"] and pieces.encode(odd.limit(0), vocabulary).count() == 0


def test_pieces_best_path(documents, vocabulary):
    scores = {i: s for i, s in vocabulary.pieces.values()}
    bytes_ = set(vocabulary.byte_ids)
    texts = ["", " the", " Ünïcödé▁文字", " a" * 500, "x" * 3000, "####" * 100, " <s>\n\t"] + [" " + r["text"][:1500] for r in documents.limit(20).collect()]
    for n, text in enumerate(texts):
        search = pieces.Viterbi(vocabulary)
        ids = search.ids(text)
        assert pieces.np.array_equal(ids, np.frombuffer(pieces.Encoder(vocabulary).encode(text[1:]), dtype=np.int32)) or not text.startswith(" ")
        unknown = sum(c not in vocabulary.pieces for c in text)
        total = sum(scores[i] for i in ids if i not in bytes_) + unknown * vocabulary.unknown
        assert total == brute.best_path(vocabulary.pieces, text, vocabulary.unknown)
        assert b"".join(vocabulary.surfaces[i] for i in ids).decode() == text
        assert n < 7 or search.most_live <= 8 * vocabulary.longest  # the window, not the text


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    bench = spark.createDataFrame([(1, " ".join(f"alpha{i}" for i in range(20)))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).where("not exact").count() == 0


def test_language_stage_without_labels(spark, documents, odd):
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    with pytest.raises(ValueError):
        stage(spark, documents.withColumn("lang", F.lit(None).cast("string")), "")
    assert stage(spark, odd.where("text is null"), "").count() == 0
    # The least share rejects none of these.
    judged = language.predict(documents, language.train(documents.where(language.fold() != 2)))
    assert judged.where(F.col("lang_pred") != language.UNKNOWN).where(F.col("score") < corpus_pipeline.LEAST_SHARE).count() == 0


def test_pipeline_stages(spark, documents):
    """Each stage against plain restatements on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = documents
    stages = dict(corpus_pipeline.STAGES)
    languages = stages["language_id"](spark, docs, sf).toPandas()
    assert len(languages) == sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    after = spark.createDataFrame(languages, docs.schema)
    near = stages["ngram_jaccard"](spark, after, sf).toPandas().sort_values("doc_id")
    ordered = languages.sort_values("doc_id")
    _, label = brute.similar_rows(list(ordered.text))
    assert list(near.doc_id) == [ordered.doc_id.iloc[i] for i in sorted(set(label))]
    cut = stages["substring_dedup"](spark, spark.createDataFrame(near, docs.schema), sf).toPandas().sort_values("doc_id")
    exp = brute.kept_words(list(near.text), 35)
    for text, old, (n, gone, digest) in zip(cut.text, near.text, exp):
        if gone:
            assert brute.hashlib.sha256(text.encode()).hexdigest() == digest
        else:
            assert text == old
    clean = stages["decontamination"](spark, spark.createDataFrame(cut, docs.schema), sf).toPandas()
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = {d for d, t in zip(cut.doc_id, cut.text) if any(i in " ".join(t.split()) for i in items)}
    assert set(cut.doc_id) - set(clean.doc_id) >= holds and len(set(cut.doc_id) - set(clean.doc_id)) <= len(holds) + 2
