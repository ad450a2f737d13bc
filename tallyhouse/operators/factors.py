"""Truncated singular value decomposition of a sparse matrix kept as a long table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.hashing import uniforms
from tallyhouse.session import cleaned, kept_table

SPARE = 8  # directions iterated beyond those wanted
ROUNDS = 4
BLOCK_ENTRIES = 8_000_000
GROUP_ENTRIES = 8_000_000, 16_000_000  # least and most of a group of blocks: a small one does not pay for the vectors it gets
GROUP_PLACES = 2_000_000  # columns of the blocks of a group, those in several of them each time
SLICE_ENTRIES = 1_000_000
SENT = pa.int32(), pa.int32(), pa.binary(), pa.binary()  # a part of the columns to or from a group: both numbers, the columns and their vectors
PART_PLACES = 200_000  # columns of blocks whose vectors one task sends out or adds up
MOST_SENT = 200_000  # rows of a checked table that are broadcast


@dataclass(frozen=True)
class Blocks:
    """A stored matrix by blocks of whole rows, as ``cut`` makes them, and the factor of each column (column, scale), by which its rows get unit length."""

    frame: DataFrame
    scale: DataFrame | None = None

    @property
    def members(self) -> DataFrame:
        return self.frame.where("columns IS NULL").select("block", "ids", "lengths", "at", "w")

    @property
    def names(self) -> DataFrame:
        return self.frame.where("columns IS NOT NULL").select("block", "columns", "uses", "entries")


def _idf(uses: DataFrame, rows: Column, column: str, min_df: int, max_df: float) -> DataFrame:
    uses = uses.where((F.col("_df") >= min_df) & (F.col("_df") <= F.lit(float(max_df)) * rows))
    return kept_table(uses.select(column, (F.ln((1 + rows) / (1 + F.col("_df"))) + 1).alias("_idf")), "idf")


def tf_idf(counts: DataFrame | Blocks, row: str, column: str = "token", n: str = "n", min_df: int = 1, max_df: float = 1.0) -> DataFrame | Blocks:
    """Weights (row, column, w) of unit length per row: n * (ln((1 + rows) / (1 + df)) + 1).

    Columns found in fewer than ``min_df`` rows or in more than the share ``max_df`` of them are left out. The counts are computed once
    and stored; their weights meet in one shuffle by row. Counts by blocks stay where they are and get the factors of their columns.
    """
    if isinstance(counts, Blocks):
        rows = F.lit(float(counts.members.agg(F.sum(F.size("ids"))).first()[0] or 0))
        uses = counts.names.select(F.explode(F.arrays_zip("columns", "uses")).alias("u")).groupBy(F.col("u.columns").alias(column))
        return replace(counts, scale=_idf(uses.agg(F.sum("u.uses").alias("_df")), rows, column, min_df, max_df))
    counts = kept_table(counts.select(row, column, n), "counts")
    rows = counts.select(row).distinct().agg(F.count(F.lit(1)).cast("double")).scalar()
    idf = _idf(counts.groupBy(column).agg(F.count(F.lit(1)).alias("_df")), rows, column, min_df, max_df)
    few = idf.count() <= MOST_SENT
    weighted = counts.join(F.broadcast(idf) if few else idf, column).select(row, column, (F.col(n) * F.col("_idf")).alias("w")).where(F.col(row).isNotNull())
    whole = weighted.groupBy(row).agg(F.collect_list(F.struct(column, "w")).alias("_e"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return whole.select(row, "_norm", F.explode("_e").alias("_e")).select(row, F.col(f"_e.{column}").alias(column), (F.col("_e.w") / F.col("_norm")).alias("w"))


def _names(k: int) -> list[str]:
    return [f"z{i}" for i in range(k)]


def _gram(df: DataFrame, k: int) -> np.ndarray:
    """k x k products of the columns: each task sends one such table, whatever its number of rows."""
    names = _names(k)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for b in batches:
            x = b[names].to_numpy(dtype=float)
            total += x.T @ x
        i, j = np.divmod(np.arange(k * k), k)
        yield pd.DataFrame({"i": i, "j": j, "v": total.ravel()})

    found = df.select(*names).mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((k, k))
    out[found["i"], found["j"]] = found["v"]
    return out


def _times(df: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Rows times a small matrix."""
    names, out = _names(matrix.shape[0]), _names(matrix.shape[1])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[[key]].reset_index(drop=True), pd.DataFrame(b[names].to_numpy(dtype=float) @ matrix, columns=out)], axis=1)

    kind = dict(df.dtypes)[key]
    return df.select(key, *names).mapInPandas(part, ", ".join([f"`{key}` {kind}", *[f"{n} double" for n in out]]))


def _lists(entries: DataFrame, row: str, column: str) -> DataFrame:
    """Rows (id, c, w) of a long table; entries without row or column do not count."""
    whole = entries.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).agg(F.collect_list(F.struct(column, "w")).alias("e"))
    return whole.select(F.col(row).alias("id"), F.col(f"e.{column}").alias("c"), F.col("e.w").alias("w"))


def _blocks(entries: DataFrame, row: str, column: str, most: int = BLOCK_ENTRIES) -> DataFrame:
    """The blocks of a long table with their values laid open: per row its block, the places ``at`` of its columns and their ``w``; per block one more row with its ``columns``."""
    plain = _lists(entries, row, column)
    kinds = dict(plain.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["columns"] is not None:
                    rows = [(r["block"], None, [], [], r["columns"])]
                else:
                    ends = np.cumsum(np.frombuffer(r["lengths"], np.int32))
                    at, w = (np.split(_unpacked(r[n], ends[-1], t), ends[:-1]) for n, t in (("at", np.int32), ("w", np.float64)))
                    rows = [(r["block"], i, x, y, None) for i, x, y in zip(r["ids"], at, w)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["block", "id", "at", "w", "columns"])

    ids, names = (plain.limit(0).toArrow().schema.field(n).type for n in ("id", "c"))
    types = pa.int64(), ids, pa.list_(pa.int32()), pa.list_(pa.float64()), names
    return cut(plain, most).mapInArrow(run, f"block long, id {kinds['id']}, at array<int>, w array<double>, columns {kinds['c']}")


def cut(plain: DataFrame, most: int = BLOCK_ENTRIES) -> DataFrame:
    """Blocks of rows (id, c, w) that list their columns, or of rows (id, c) that repeat each as often as it counts.

    Of some rows at a time their block and ids, how many entries each has, the places ``at`` of the columns of these in the block and their ``w``,
    as bytes; per block one more row with its ``columns``, the rows that use each, and the number of entries. A block ends after ``most``
    entries or many different columns of it, and with its task. Rows without entries are left out.
    """
    kinds, given = dict(plain.dtypes), "w" in plain.columns
    names = ["block", "ids", "lengths", "at", "w", "columns", "uses", "entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, entries, places, uses = TaskContext.get().partitionId() << 32, 0, 0, {}, np.zeros(0, dtype=np.int64)
        blob, many = pa.binary(), pa.list_(pa.int64())

        def ended(ids: pa.DataType, lists: pa.DataType) -> pa.RecordBatch:
            row = (task + block, pa.int64()), (None, pa.list_(ids)), (None, blob), (None, blob), (None, blob), (list(places), lists), (uses, many), (entries, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], names=names)

        for batch in batches:
            lengths = pc.fill_null(batch.column(1).value_lengths(), 0).to_numpy()
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // max(min(most // 4, SLICE_ENTRIES), 1))) + 1
            for first, last in pairwise([0, *cuts.tolist(), batch.num_rows]):
                ids, lists, *weights = batch.slice(first, last - first).columns
                kind = ids.type, lists.type
                lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy()
                coded = lists.flatten().dictionary_encode()
                own = np.array([places.setdefault(c, len(places)) for c in coded.dictionary.to_pylist()], dtype=np.int64)
                at, width = own[coded.indices.to_numpy()], max(len(places), 1)
                if given:
                    w = weights[0].flatten().to_numpy()
                else:
                    pairs, w = np.unique(np.repeat(np.arange(len(ids)) * width, lengths) + at, return_counts=True)
                    owner, at = np.divmod(pairs, width)
                    lengths = np.bincount(owner, minlength=len(ids))
                    # Each row begins at a word of its own, so copies of a text differ in rounding, and k-means draws from all of them.
                    start, length = (np.cumsum(lengths) - lengths)[owner], lengths[owner]
                    turned = start + (np.arange(len(at)) - start + owner) % length
                    at, w = at[turned], w[turned]
                if not len(at):
                    continue
                ids = ids.filter(pa.array(lengths > 0))
                bounds = pa.array([0, len(ids)], pa.int32())
                blobs = lengths[lengths > 0].astype(np.int32).tobytes(), _packed(at.astype(np.int32)), _packed(w.astype(np.float64))
                yield pa.RecordBatch.from_arrays([
                    pa.array([task + block]), pa.ListArray.from_arrays(bounds, ids), *[pa.array([x], blob) for x in blobs],
                    pa.nulls(1, kind[1]), pa.nulls(1, many), pa.nulls(1, pa.int64())], names=names)
                now = np.bincount(at, minlength=len(places))
                now[: len(uses)] += uses
                uses, entries = now, entries + len(at)
                if entries >= most or len(places) >= most // 16:
                    yield ended(*kind)
                    block, entries, places, uses = block + 1, 0, {}, np.zeros(0, dtype=np.int64)
        if places:
            yield ended(*kind)

    schema = f"block long, ids array<{kinds['id']}>, lengths binary, at binary, w binary, columns {kinds['c']}, uses array<long>, entries long"
    return plain.mapInArrow(run, schema)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs: the first bytes of all, then their second bytes and so on. Others as they are."""
    whole = x.astype(np.uint32)
    if not (whole == x).all():
        return x.tobytes()
    planes = whole.view(np.uint8).reshape(-1, 4).T
    return planes[: max(int(whole.max(initial=0)).bit_length() + 7, 8) // 8].tobytes()


def _unpacked(data: bytes | pa.Scalar, n: int, kind: type) -> np.ndarray:
    data = np.frombuffer(data.as_buffer() if isinstance(data, pa.Scalar) else data, np.uint8)
    if len(data) > 4 * n:
        return data.view(kind)
    whole = np.zeros((n, 4), dtype=np.uint8)
    for i, plane in enumerate(data.reshape(-1, n) if n else ()):
        whole[:, i] = plane
    return whole.view(np.uint32).ravel().astype(kind)


def _numbers(data: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), kind)


def _groups(names: DataFrame) -> tuple[DataFrame, int]:
    """The group of each block, and the columns of all blocks. Small blocks are put together, as a column is sent once per group."""
    sizes = names.select("block", "entries", F.size("columns")).orderBy("block").collect()
    spark = names.sparkSession
    most = min(max(sum(r[1] for r in sizes) // spark.sparkContext.defaultParallelism, GROUP_ENTRIES[0]), GROUP_ENTRIES[1])
    found, group, entries, columns = [], 0, 0, 0
    for block, n, width in sizes:
        if entries and (entries + n > most or columns + width > GROUP_PLACES):
            group, entries, columns = group + 1, 0, 0
        found.append((block, group))
        entries, columns = entries + n, columns + width
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*found) if found else ([], []), (pa.int64(), pa.int32()))], names=["block", "group"])
    return spark.createDataFrame(table), sum(r[2] for r in sizes)


def _linked(places: DataFrame, columns: DataFrame, seeds: list[str]) -> DataFrame:
    """Per part of the columns their first vectors, and for each group of blocks which of them it needs (``pos``), their scales, and the places that name them in its blocks."""

    def run(places: pa.Table, columns: pa.Table) -> pa.Table:
        rows = {n: [] for n in ("groups", "pos", "scales", "blocks", "places", "links")}
        if not columns.num_rows:
            return pa.table([pa.array([], f.type) for f in schema], schema=schema)
        pos = pc.fill_null(pc.index_in(places.column("column"), value_set=columns.column("_column").combine_chunks()), -1).to_numpy()
        group, block, place = (places.column(n).to_numpy() for n in ("group", "block", "place"))
        scale = columns.column("scale").to_numpy()
        order = np.argsort(group, kind="stable")
        order = order[pos[order] >= 0]
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            needed, links = np.unique(pos[own], return_inverse=True)
            for n, x in (("pos", needed.astype(np.int32)), ("scales", scale[needed]), ("blocks", block[own]), ("places", place[own]), ("links", links.astype(np.int32))):
                rows[n].append(x.tobytes())
            rows["groups"].append(int(group[own[0]]))
        z = uniforms(seeds, columns.column("name").to_pylist()) - 0.5
        return pa.Table.from_pylist([{"part": columns.column("_part")[0].as_py(), **rows, "z": z.tobytes()}], schema=schema)

    blobs = pa.list_(pa.binary())
    schema = pa.schema([("part", pa.int32()), ("groups", pa.list_(pa.int32())), *[(n, blobs) for n in ("pos", "scales", "blocks", "places", "links")], ("z", pa.binary())])
    kind = "part int, groups array<int>, pos array<binary>, scales array<binary>, blocks array<binary>, places array<binary>, links array<binary>, z binary"
    return places.groupBy("part").cogroup(columns.groupBy("_part")).applyInArrow(run, kind)


def _factor(members: DataFrame, links: DataFrame, kind: str, unit: bool) -> DataFrame:
    """Slices of the rows of each group, with the columns that are left by their order among those of the group, and one more row with the scales of these."""

    def run(members: pa.Table, links: pa.Table) -> pa.Table:
        if not links.num_rows:
            return pa.Table.from_pylist([], schema=schema)
        named, scales, base = {}, [], 0
        for i in np.argsort(links.column("part").to_numpy()).tolist():
            block, place, link, scale = (_numbers(links.column(n)[i], t) for n, t in (("blocks", np.int64), ("places", np.int32), ("links", np.int32), ("scales", np.float64)))
            order = np.argsort(block, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                named.setdefault(int(block[own[0]]), []).append((place[own], link[own] + base))
            scales.append(scale)
            base += len(scale)
        scale, codes = np.concatenate(scales), {}
        for block, found in named.items():
            place = np.concatenate([p for p, _ in found])
            codes[block] = np.full(place.max() + 1, -1, dtype=np.int32)
            codes[block][place] = np.concatenate([x for _, x in found])
        group = links.column("group")[0].as_py()
        out, held = [pa.Table.from_pylist([{"group": group, "scale": scale.tobytes()}], schema=schema)], []

        def ended() -> None:
            ids = pa.concat_arrays([x[0] for x in held])
            n, norm, at, w = (np.concatenate([x[i] for x in held]) for i in range(1, 5))
            row = group, None, n.tobytes(), norm.tobytes(), _packed(at), _packed(w), None
            arrays = [pa.array([x], f.type) for x, f in zip(row, schema)]
            arrays[1] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            out.append(pa.table(arrays, names=schema.names))
            held.clear()

        for i in np.argsort(members.column("block").to_numpy(), kind="stable").tolist():
            code = codes.get(members.column("block")[i].as_py())
            if code is None:
                continue
            ids, n = members.column("ids")[i].values, _numbers(members.column("lengths")[i], np.int32)
            owner, size = np.repeat(np.arange(len(n)), n), int(n.sum())
            at, w = _unpacked(members.column("at")[i], size, np.int32), _unpacked(members.column("w")[i], size, np.float64)
            at = np.where(at < len(code), code[np.minimum(at, len(code) - 1)], -1)
            left = (at >= 0) & pc.is_valid(ids).to_numpy(zero_copy_only=False)[owner]
            owner, at, w = owner[left], at[left], w[left]
            n = np.bincount(owner, minlength=len(n)).astype(np.int32)
            norm = np.sqrt(np.bincount(owner, weights=(w * scale[at]) ** 2, minlength=len(n))) if unit else np.ones(len(n))
            if len(at):
                held.append((ids.filter(pa.array(n > 0)), n[n > 0], norm[n > 0], at, w))
                if sum(len(x[3]) for x in held) >= SLICE_ENTRIES:
                    ended()
        if held:
            ended()
        return pa.concat_tables(out)

    ids = members.limit(0).toArrow().schema.field("ids").type
    schema = pa.schema([("group", pa.int32()), ("ids", ids), *[(n, pa.binary()) for n in ("lengths", "norms", "at", "w", "scale")]])
    return members.groupBy("_group").cogroup(links.groupBy("group")).applyInArrow(
        run, f"group int, ids {kind}, lengths binary, norms binary, at binary, w binary, scale binary")


def _sent(state: DataFrame, size: int, turn: np.ndarray | None) -> DataFrame:
    """To each group the vectors of its columns, after the rotation of the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, groups, pos, z = (batch.column(n)[i] for n in ("part", "groups", "pos", "z"))
                z = _numbers(z, np.float64).reshape(-1, size)
                z = z if turn is None else z @ turn
                for group, own in zip(groups.as_py(), pos):
                    row = group, part.as_py(), own.as_py(), z[_numbers(own, np.int32)].tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, SENT)], names=["_group", "part", "pos", "z"])

    return state.select("part", "groups", "pos", "z").mapInArrow(run, "_group int, part int, pos binary, z binary")


def _rows(members: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice of a group its ids, where each row begins, and the row, the column and the value of each entry."""
    slices = [i for i in range(members.num_rows) if not members.column("scale")[i].is_valid]
    scale = next(_numbers(s, np.float64) for s in members.column("scale") if s.is_valid)
    for i in slices:
        get = lambda n: members.column(n)[i]
        n = _numbers(get("lengths"), np.int32)
        owner = np.repeat(np.arange(len(n)), n)
        at, w = (_unpacked(get(c), len(owner), t) for c, t in (("at", np.int32), ("w", np.float64)))
        yield get("ids").values, np.cumsum(n, dtype=np.intp) - n, owner, at.astype(np.intp), w * scale[at] / _numbers(get("norms"), np.float64)[owner]


def truncated_svd(entries: DataFrame | Blocks, row: str, column: str, k: int, rounds: int = ROUNDS, seed: int | str = "svd") -> tuple[DataFrame, list[float]]:
    """Projection of each row on the first ``k`` right singular vectors (columns z0, z1, ...), and the singular values.

    Subspace iteration: the matrix, (row, column, w) or blocks, and the vectors stay distributed; the driver sees only tables of k x k
    numbers, one per part of the columns, and the sizes of blocks. Nothing is centred, and no column is left out. The matrix is kept in groups of
    blocks of whole rows (entries without row or column do not count), the vectors in parts of the columns. A round sends each group the vectors
    of its columns, a part of them as one value, and adds up what the groups send back, so no task handles single entries or vectors as rows.
    """
    blocks = entries if isinstance(entries, Blocks) else Blocks(kept_table(cut(_lists(entries, row, column)), "blocks"))
    ids = dict(blocks.frame.dtypes)["ids"]
    kind = ids.removeprefix("array<").removesuffix(">")
    spark = blocks.frame.sparkSession
    groups, total = _groups(blocks.names)
    parts = total // PART_PLACES + 1
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    if blocks.scale is None:
        columns = kept_table(blocks.names.select(F.explode("columns").alias("_column")).distinct().withColumn("scale", F.lit(1.0)), "columns")
    else:
        columns = blocks.scale.toDF("_column", "scale")
    size = min(k + SPARE, columns.count())
    columns = columns.select(part("_column").alias("_part"), "_column", "scale", F.col("_column").cast("string").alias("name"))
    grouped = blocks.names.join(F.broadcast(groups), "block")
    places = grouped.select("block", "group", F.posexplode("columns").alias("place", "column")).select(part("column").alias("part"), "block", "group", "place", "column")
    state = kept_table(_linked(places, columns, [f"{seed}-{i}" for i in range(size)]), "vectors")
    links = state.select("part", F.explode(F.arrays_zip("groups", "scales", "blocks", "places", "links")).alias("e")).select(
        "part", F.col("e.groups").alias("group"), "e.scales", "e.blocks", "e.places", "e.links")
    members = blocks.members.join(F.broadcast(groups.withColumnRenamed("group", "_group")), "block")
    factor = kept_table(_factor(members, links, ids, blocks.scale is not None), "factor")

    def met(run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, state: DataFrame, size: int, turn: np.ndarray | None) -> DataFrame:
        return factor.groupBy("group").cogroup(_sent(state, size, turn).groupBy("_group")).applyInArrow(run, schema)

    def ordered(vectors: pa.Table, size: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """Line of each part and its first and last column in the matrix of vectors, one vector per line."""
        pos, bounds = vectors.column("pos"), [0]
        order = np.argsort(vectors.column("part").to_numpy()).tolist()
        for i in order:
            bounds.append(bounds[-1] + len(_numbers(pos[i], np.int32)))
        parts, z = list(zip(order, bounds, bounds[1:])), np.empty((size, bounds[-1]))
        for i, first, last in parts:
            z[:, first:last] = _numbers(vectors.column("z")[i], np.float64).reshape(-1, size).T
        return parts, z

    def back(size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(members: pa.Table, vectors: pa.Table) -> pa.Table:
            parts, z = ordered(vectors, size)
            sums, out = np.zeros(z.shape), []
            for _, starts, owner, at, w in _rows(members):
                for i, vector in enumerate(z):
                    left = np.add.reduceat(w * vector[at], starts)
                    sums[i] += np.bincount(at, weights=w * left[owner], minlength=len(vector))
            del z
            for i, first, last in parts:
                row = *(vectors.column(n)[i].as_py() for n in ("part", "_group", "pos")), sums[:, first:last].T.tobytes()
                out.append(pa.table([pa.array([x], t) for x, t in zip(row, SENT)], names=["part", "group", "pos", "z"]))
            return pa.concat_tables(out)

        return run

    def added(size: int) -> Callable[[pa.Table], pa.Table]:
        def run(sent: pa.Table) -> pa.Table:
            order = np.argsort(sent.column("group").to_numpy()).tolist()
            pos = [_numbers(sent.column("pos")[i], np.int32) for i in order]
            z = np.zeros((max(int(p.max()) for p in pos) + 1, size))
            for p, i in zip(pos, order):
                z[p] += _numbers(sent.column("z")[i], np.float64).reshape(-1, size)
            row = sent.column("part")[0].as_py(), [sent.column("group")[i].as_py() for i in order], [p.tobytes() for p in pos], z.tobytes(), (z.T @ z).tobytes()
            types = pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary()
            return pa.table([pa.array([x], t) for x, t in zip(row, types)], names=["part", "groups", "pos", "z", "gram"])

        return run

    def placed(size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(members: pa.Table, vectors: pa.Table) -> pa.Table:
            z, found = ordered(vectors, size)[1], []
            for ids, starts, _, at, w in _rows(members):
                found.append(pa.RecordBatch.from_arrays([ids, *[pa.array(np.add.reduceat(w * v[at], starts)) for v in z]], names=[row, *_names(size)]))
            return pa.Table.from_batches(found)

        return run

    held, turn = size, None  # the vectors of a round are those stored, of width ``held``, times ``turn``
    for _ in range(rounds):
        cleaned(spark)
        sent = met(back(size), "part int, group int, pos binary, z binary", state, held, turn)
        state = kept_table(sent.groupBy("part").applyInArrow(added(size), "part int, groups array<int>, pos array<binary>, z binary, gram binary"), "vectors")
        grams = [np.frombuffer(r["gram"]).reshape(size, size) for r in state.select("part", "gram").orderBy("part").collect()]
        values, rotation = np.linalg.eigh(sum(grams, np.zeros((size, size))))
        sound = values > max(values.max(), 0) * 1e-20
        del sent
        held, turn, size = size, rotation[:, sound] / np.sqrt(values[sound]), int(sound.sum())
    cleaned(spark)
    schema = ", ".join([f"`{row}` {kind}", *[f"{n} double" for n in _names(size)]])
    left = kept_table(met(placed(size), schema, state, held, turn), "placed")
    values, rotation = np.linalg.eigh(_gram(left, size))
    best = np.argsort(-values)[:k]
    return _times(left, row, rotation[:, best]), np.sqrt(np.maximum(values[best], 0)).tolist()
