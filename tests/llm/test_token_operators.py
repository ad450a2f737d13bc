"""Token files, cross-tokenizer alignment and whitening against plain restatements."""

import collections
import glob
import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tallyhouse.llm import alignment, bidiagonal, tokenfiles, units, whitening

ODD_TEXTS = ["", None, " ", "  \n\n", "a ▁ b", " <|endoftext|> x\n\n", "x<|endoftext|>  <|endoftext|>", "  two  \x85 \x1c odd​ 中文字符 👍🏽", "don't  é  \n y",
             "word " * 3000, "ab" * 4000, "\t\tx\ty", "a,b;c'd 12ab34 é,è"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, f"s{i % 2}", i) for i, t in enumerate(ODD_TEXTS)] + [(3, "  \n\n", "again", 0), (4, "other text, same id", "again", 0), (None, "no id", "x", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, ids long")


def test_units_encode_alike_alone_and_in_texts():
    rng = random.Random(3)
    letters = ["a", "b", "Z", "é", "ß", "中", "1", "9", " ", " ", "\n", "\t", " ", " ", "\x1c", "\x85", "​", "'s", "'", "!", "<|endoftext|>", "👍", "́", "\r", "\x0b"]
    path, pieces_path = alignment.default_paths()
    plain = Tokenizer.from_file(path)
    bpe, model = units.ByteBpe(path), alignment.Pieces(pieces_path)
    for fine in (False, True):
        memo = units.Memo(bpe.encode_units, 50)  # so small that generations change often
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
            cut = [u for p in units.pieces(text, 5) for u in units.units(p, fine)]
            assert "".join(cut) == text
            assert np.frombuffer(b"".join(memo.values(cut)), dtype=np.int32).tolist() == plain.encode(text, add_special_tokens=False).ids
            if text and not fine:
                assert [int(i) for u in units.units(" " + text) for i in model.ids([u])[0]] == model.model.encode(text)


def test_units_of_many_texts_are_those_of_each_and_are_asked_for_once():
    rng = random.Random(5)
    letters = ["a", "b", "Z", "É", "ÿ", "×", "÷", "€", "中", "👍", "́", "1", "9", " ", " ", "\n", "\t", "'s", "_", "[", "`", "@", "{", "~", "\x00", "\x7f", "<|endoftext|>"]
    for fine in (False, True):
        for many in (0, 1, 2, 9):
            for _ in range(300):
                texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 30]))) for _ in range(many)]
                names, place, at = units.unit_table(texts, fine)
                assert [[names[i] for i in place[a:b]] for a, b in zip(at[:-1], at[1:])] == [units.units(x, fine) for x in texts]
                assert len(at) == many + 1 and len(set(names)) == len(names)
    bpe, asked = units.ByteBpe(alignment.default_paths()[0]), []

    class Counting(units.Memo):
        def values(self, names):
            asked.extend(names)
            return super().values(names)

    texts = ["one two, one two. one", None, "two one\n", "", "odd\x0b one", " two"] * 40
    packed = list(tokenfiles.packed_ids(texts, Counting(bpe.encode_units)))
    plain = Tokenizer.from_file(alignment.default_paths()[0])
    assert [np.frombuffer(x, dtype=np.int32).tolist() for x in packed] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(asked) < 100  # 9 different units, and those of 40 odd texts


def brute_stream(docs, end_id):
    plain = Tokenizer.from_file(tokenfiles.default_tokenizer())
    out, at = [], 0
    for doc_id, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        at += len(ids)
    return out


def test_token_files_on_documents(spark, documents, tmp_path):
    path = str(tmp_path / "out")
    tokenfiles.write(documents, path, tokenfiles.default_tokenizer(), shard_bytes=100_000, row_group_bytes=30_000, page_bytes=4_000, page_rows=10)
    want = brute_stream(sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()), 0)
    got = tokenfiles.checksums(spark, path).collect()
    assert sorted(tuple(r) for r in got) == [w[:4] for w in want]
    # Files are in id order, their columns encoded as stated, and reads get to the parts they need.
    files = sorted(glob.glob(f"{path}/tokens/*.parquet"))
    stored = [i for f in files for i in pq.read_table(f).column("doc_id").to_pylist()]
    assert len(files) > 3 and stored == [w[0] for w in want]
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_column_index and c.has_offset_index for c in columns.values())
        assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
        assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "at", "n_tokens"))
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > len(files)
    low, high = want[30][0], want[50][0]
    part = tokenfiles.documents(spark, path, low, high)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id" in part._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.start, r.ids) for r in part.collect()) == [(w[0], w[1], w[4]) for w in want[30:51]]
    assert "ids" not in tokenfiles.tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    whole = [i for w in want for i in w[4]]
    for first, last in ((0, 1), (777, 5_000), (len(whole) - 3, len(whole) + 9), (5, 5)):
        parts = sorted(tokenfiles.span(spark, path, first, last).collect(), key=lambda r: r.start)
        assert [i for r in parts for i in r.ids] == whole[first:last]


def test_token_files_odd_rows(spark, odd, tmp_path):
    path = str(tmp_path / "out")
    tokenfiles.write(odd.repartition(3), path, tokenfiles.default_tokenizer(), shard_bytes=3_000)
    got = sorted((tuple(r) for r in tokenfiles.checksums(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r.doc_id for r in odd.collect()], key=lambda i: -1 if i is None else i)
    texts = collections.defaultdict(list)
    for r in odd.collect():
        texts[r.doc_id].append(r.text)
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at and (n, crc) in {w[2:4] for t in texts[doc_id] for w in brute_stream([(doc_id, t)], 0)}
        at += n
    empty = str(tmp_path / "empty")
    tokenfiles.write(odd.where("false"), empty, tokenfiles.default_tokenizer())
    assert tokenfiles.checksums(spark, empty).count() == 0 and tokenfiles.span(spark, empty, 0, 9).count() == 0


def test_equal_rows_are_dealt_over_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.range(400).selectExpr("7L AS doc_id", "repeat('same words ', 100) AS text").write.parquet(str(tmp_path / "in"))
    tokenfiles.write(spark.read.parquet(str(tmp_path / "in")), path, tokenfiles.default_tokenizer(), shard_bytes=50_000)
    rows = [r.n_rows for r in tokenfiles.shards(spark, path).collect()]
    assert sum(rows) == 400 and len(rows) > 5 and max(rows) < 100


def brute_alignment(texts):
    tool = alignment.Aligner(*alignment.default_paths())
    found, count = [], collections.Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        a, b = tool.a.model.encode(" " + text, add_special_tokens=False).ids, tool.b.model.encode(text)
        a_bytes, b_bytes = [tool.a.surfaces[i] for i in a], [tool.b.surfaces[i] for i in b]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            continue
        a_end, b_end = list(itertools.accumulate(map(len, a_bytes))), list(itertools.accumulate(map(len, b_bytes)))
        links, groups, i, j = collections.Counter(), [], 0, 0
        for end in sorted({*a_end} & {*b_end}):
            in_a, in_b = [], []
            while i < len(a) and a_end[i] <= end:
                in_a.append(i)
                i += 1
            while j < len(b) and b_end[j] <= end:
                in_b.append(j)
                j += 1
            groups.append(",".join(str(a[k]) for k in in_a) + "|" + ",".join(str(b[k]) for k in in_b))
            for p in in_a:
                for q in in_b:
                    if max(a_end[p] - len(a_bytes[p]), b_end[q] - len(b_bytes[q])) < min(a_end[p], b_end[q]):
                        links[a[p], b[q]] += 1
        found[-1] = len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()
        count.update(links.keys())
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        *f[:3], sum(f[3].values()), sum(m for p, m in f[3].items() if count[p] == best[p[0]]), sum(m * count[p] for p, m in f[3].items()), f[4]) for f in found]


@pytest.mark.parametrize("block", [2_000, alignment.BLOCK_CHARS])
def test_alignment(spark, documents, odd, block):
    docs = documents.select("doc_id", "text").unionByName(odd.selectExpr("doc_id + 100000 AS doc_id", "text"))
    rows = docs.collect()
    got = alignment.align(docs.withColumn("block", docs.doc_id), *alignment.default_paths(), block_chars=block)
    want = collections.Counter(zip((r.doc_id for r in rows), brute_alignment([r.text for r in rows])))
    assert collections.Counter((r[0], tuple(r[1:])) for r in got.collect()) == want
    assert alignment.align(docs.where("false"), *alignment.default_paths()).count() == 0


def test_units_of_the_alignment_leave_marks_behind_words_out():
    rng = random.Random(7)
    tool = alignment.Aligner(*alignment.default_paths())
    assert tool.b.fine
    words = ["house", "é", "zwölf", "a1", "3", "_x", "it's", "中文", "Zz"]
    for _ in range(1000):
        text = " " + "".join(rng.choice(words) + rng.choice([", ", ". ", "; ", "\n", "!", " ", "...", "'", '" ', ")-(", "≠ ", "<s> ", "</s>", "<0x41>"]) for _ in range(rng.randint(1, 9)))
        cut = units.units(text, True)
        assert [int(i) for ids in tool.b.ids(cut) for i in ids] == tool.b.ids([text])[0].tolist()
        assert [int(i) for ids in tool.a.ids(cut) for i in ids] == tool.a.ids([text])[0].tolist()
    tool.document("house, house. house; house! house house: house? house")
    assert set(tool.memo.young) == {" house", *",.;!:?"}


def test_long_text_is_aligned_in_pieces(monkeypatch):
    text = "".join(f"Wort{i % 97},\n zwei  drei{i} " for i in range(2000))
    tool = alignment.Aligner(*alignment.default_paths())
    whole = tool.document(text)
    monkeypatch.setattr(units.pieces, "__defaults__", (500,))
    parts = tool.document(text)
    assert whole[:4] == parts[:4] and (whole[4] == parts[4]).all() and (whole[5] == parts[5]).all()


@pytest.mark.parametrize("kind", range(6))
def test_singular_values_and_vectors(kind):
    rng = np.random.default_rng(kind)
    for n in (1, 2, 3, 5, 16, 64):
        x = rng.standard_normal((3 * n + 2, n))
        if kind == 1:
            x *= 10.0 ** -np.linspace(0, 12, n)
        if kind == 2:
            x[:, :n // 2] = x[:, [0]]
        if kind == 3:  # two values, each many times
            x = (np.linalg.qr(x)[0] * np.where(np.arange(n) < n / 2, 3.0, 1.0)) @ np.linalg.qr(rng.standard_normal((n, n)))[0]
        if kind == 4:
            x = np.diag(np.arange(n, 0, -1.0))
        if kind == 5:
            x[:] = 0
        r = np.linalg.qr(x, mode="r")
        diagonal, above, _ = bidiagonal.bidiagonal(r)
        values = bidiagonal.squared_singular_values(diagonal, above)
        want = np.linalg.svd(r, compute_uv=False)
        assert np.allclose(np.sqrt(values), want, rtol=1e-13, atol=4e-15 * n * want[0])
        values, vectors = bidiagonal.leading(r, 8)
        assert len(values) == min(8, np.linalg.matrix_rank(r, tol=8 * n * 2.3e-16 * want[0])) if want[0] else len(values) == 0
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-11)
        assert len(values) == 0 or np.abs(r.T @ (r @ vectors) - vectors * values).max() <= 1e-13 * n * values[0]
    # Each value is accurate relative to itself, down to the smallest: known values of a graded two by two block.
    assert np.allclose(bidiagonal.squared_singular_values(np.array([1.0, 1e-20]), np.array([1.0])), [2.0, 5e-41], rtol=1e-14, atol=0)


def check_whitening(rows, got, k=8):
    good = [(i, [np.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    x = np.array([v for _, v in good], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    values, vectors = np.linalg.eigh((y / n).T @ (y / n) / n)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    assert len(got) == n * k
    for c in range(k):
        part = {r.vec_id: r for r in got if r.component == c + 1}
        want = (y / n) @ vectors[:, c] / np.sqrt(values[c])
        have = np.array([part[i].whitened for i, _ in good])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert [part[i].deviation for i, _ in good] == (y * y).sum(axis=1).tolist()
        assert all(r.n == n and abs(r.explained - values[c] / values.sum()) < 1e-12 and r.identity_error < 1e-9 for r in part.values())


def test_whitening_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = whitening.whitened(table.repartition(37)).collect()  # more tasks than one level of triangles takes
    check_whitening([(r.vec_id, r.embedding) for r in table.collect()], got)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(3) * (3, 2, 1)]) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0]),
           (106, [1e30, 0.0, 0.0])]
    schema = "vec_id long, embedding array<float>, component int"
    df = spark.createDataFrame([(*r, 5) for r in good + bad], schema)
    check_whitening(good, whitening.whitened(df).collect())
    assert whitening.whitened(df.where("vec_id >= 100")).count() == 0
    assert whitening.whitened(df.where("vec_id = 3")).count() == 0 and whitening.whitened(df.where("false")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(9)], schema)
    assert whitening.whitened(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(9)], schema)
    got = whitening.whitened(line).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)
    # A deviation beyond a long is null, one below is exact.
    far = spark.createDataFrame([(0, [2.0**30], 0), (1, [-(2.0**30)], 0), (2, [1.0], 0)], schema)
    x = [2**40 + 100_000, -(2**40) + 100_000, 101_024]
    exact = [(3 * v - sum(x)) ** 2 for v in x]
    assert {r.vec_id: r.deviation for r in whitening.whitened(far).collect()} == {i: v if v < 2**63 else None for i, v in enumerate(exact)}
