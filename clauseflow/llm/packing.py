"""Token-ID output: best-fit-decreasing packing of documents into fixed rows.

Each document becomes token ids (ending with an end-of-document id) and is cut
into segments of at most ``length`` ids, so nothing is lost.  Segments are
packed by best-fit-decreasing: longest first, each into the open row with the
least room that still takes it, found in a segment tree over room sizes.  A
task packs its documents in blocks of a bounded number of ids, so packing needs
no shuffle and bounded memory; a block leaves about one unfilled row.

A packed row holds its ids padded to ``length``, the cumulative segment lengths
(for attention kernels that take sequence bounds) and position ids that start
again at 0 in each segment.
"""

from __future__ import annotations

import base64
import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, warc

#: Ranks of a public byte-level BPE vocabulary, base64 token and rank per line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The free id after the last rank ends every document and fills rows up.
END_ID = 50256
_SCHEMA = ("pack long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
           "doc_ids array<long>, doc_parts array<int>")


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """Open rows by room left; finds the least room of at least ``size`` in
    O(log length) steps in a segment tree of counts."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the tightest row that takes ``size``."""
        count, i = self.count, size + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right neighbour has an open row
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:  # down, to its smallest room
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows as lists of indexes into ``sizes`` (each at most ``length``); equal sizes in order."""
    tree, rows = RoomTree(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        got = tree.take(size)
        if got is None:
            got = length, len(rows)
            rows.append([])
        room, row = got
        rows[row].append(i)
        if room > size:
            tree.put(room - size, row)
    return rows


def _packed(segments: list[tuple[object, int, np.ndarray]], length: int, first_pack: int, end_id: int, kind) -> pa.RecordBatch:
    rows = best_fit_decreasing(np.array([len(s) for _, _, s in segments], np.int64), length)
    ids = np.full((len(rows), length), end_id, kind)
    places = np.zeros((len(rows), length), kind)
    bounds, docs, parts = [], [], []
    count = np.arange(length, dtype=kind)
    for r, row in enumerate(rows):
        at, ends = 0, [0]
        for i in row:
            ids_of = segments[i][2]
            ids[r, at:at + len(ids_of)] = ids_of
            places[r, at:at + len(ids_of)] = count[:len(ids_of)]
            at += len(ids_of)
            ends.append(at)
        bounds.append(ends)
        docs.append([segments[i][0] for i in row])
        parts.append([segments[i][1] for i in row])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(first_pack, first_pack + len(rows))), pa.array([b[-1] for b in bounds], pa.int32()),
         pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in places], pa.binary()),
         pa.array(bounds, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))],
        names=["pack", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_parts"])


def id_type(end_id: int, length: int) -> str:
    """Little-endian type of the ids and positions."""
    return "<u2" if max(end_id, length) < 1 << 16 else "<u4"


def pack(docs: DataFrame, length: int = 2048, block_ids: int = 1 << 21, vocabulary: str = VOCABULARY,
         pattern: str = PATTERN, end_id: int = END_ID) -> DataFrame:
    """Packed rows of all documents: pack (unique), n_tokens, input_ids and
    position_ids (``length`` little-endian values of ``id_type``), cu_seqlens
    (0 and the end of each segment), doc_ids and doc_parts (of each segment).

    Null and empty texts are a segment of the end id alone, so every row of
    ``docs`` comes back; rows that repeat a doc_id are documents of their own;
    a text longer than ``length`` ids continues in segments numbered 0, 1, ...
    An empty table gives no row.  ``vocabulary`` is a path on every machine."""
    kind = id_type(end_id, length)

    def run(batches):
        encode = encoder(vocabulary, pattern).encode_ordinary
        context = TaskContext.get()
        next_pack = (context.partitionId() if context else 0) << 40
        waiting, n_waiting = [], 0
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                ids = np.array([*encode(texts[i].as_py() or ""), end_id], kind)
                doc = doc_ids[i].as_py()
                for part, at in enumerate(range(0, len(ids), length)):
                    waiting.append((doc, part, ids[at:at + length]))
                n_waiting += len(ids)
                if n_waiting >= block_ids:
                    yield (out := _packed(waiting, length, next_pack, end_id, kind))
                    next_pack += out.num_rows
                    waiting, n_waiting = [], 0
        if waiting:
            yield _packed(waiting, length, next_pack, end_id, kind)

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, _SCHEMA)


def unpack(packed: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY, pattern: str = PATTERN,
           end_id: int = END_ID) -> DataFrame:
    """(doc_id, part, ids array<int>) of every segment of packed rows."""
    kind = id_type(end_id, length)

    def run(batches):
        for batch in batches:
            got = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["input_ids"], kind)
                for k, (doc, part) in enumerate(zip(row["doc_ids"], row["doc_parts"])):
                    got.append((doc, part, ids[row["cu_seqlens"][k]:row["cu_seqlens"][k + 1]].tolist()))
            docs, parts, ids = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(parts, pa.int32()),
                                              pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "part", "ids"])
    return packed.mapInArrow(run, "doc_id long, part int, ids array<int>")


def write_matrices(packed: DataFrame, folder: str, length: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Write packed rows as ``.npy`` matrices, one file set per Arrow batch:
    <name>.ids.npy and <name>.positions.npy (rows x length), <name>.cu_seqlens.npy
    (all rows' bounds one after the other), <name>.bounds_at.npy (where each
    row's bounds start), <name>.packs.npy, and per segment <name>.doc_ids.npy,
    <name>.no_id.npy (null ids) and <name>.doc_parts.npy.  Returns (name, n_rows,
    n_tokens), a written table that lists the files of the attempts that counted."""
    kind = id_type(end_id, length)

    def run(batches):
        where, root = warc._open(folder)
        where.create_dir(root, recursive=True)

        def save(name, array):
            data = io.BytesIO()
            np.save(data, array)
            with where.open_output_stream(f"{root}/{name}.npy", compression=None) as f:
                f.write(data.getvalue())
        for batch in batches:
            if not batch.num_rows:
                continue
            name = uuid.uuid4().hex
            for column, what in (("input_ids", "ids"), ("position_ids", "positions")):
                rows = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(column)]
                save(f"{name}.{what}", np.stack(rows))
            bounds = [np.array(x, np.int32) for x in batch.column("cu_seqlens").to_pylist()]
            save(f"{name}.cu_seqlens", np.concatenate(bounds))
            save(f"{name}.bounds_at", np.cumsum([0, *map(len, bounds)]))
            save(f"{name}.packs", batch.column("pack").to_numpy(zero_copy_only=False))
            segments = batch.column("doc_ids").flatten()
            save(f"{name}.doc_ids", segments.fill_null(0).to_numpy(zero_copy_only=False))
            save(f"{name}.no_id", segments.is_null().to_numpy(zero_copy_only=False))
            save(f"{name}.doc_parts", batch.column("doc_parts").flatten().to_numpy(zero_copy_only=False))
            n = sum(batch.column("n_tokens").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([batch.num_rows]), pa.array([n], pa.int64())],
                                             names=["name", "n_rows", "n_tokens"])
    return common.stash(packed.mapInArrow(run, "name string, n_rows long, n_tokens long"), "matrices")


def read_matrices(files: DataFrame, folder: str) -> DataFrame:
    """The packed rows (as ``pack`` gives them) of the matrices that
    ``files(name, ...)`` lists, read by as many tasks as there is room for."""
    def run(batches):
        where, root = warc._open(folder)

        def load(name):
            with where.open_input_file(f"{root}/{name}.npy") as f:
                return np.load(io.BytesIO(f.read()))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                ids, places, bounds, at, packs, docs, no_id, parts = (load(f"{name}.{what}") for what in (
                    "ids", "positions", "cu_seqlens", "bounds_at", "packs", "doc_ids", "no_id", "doc_parts"))
                at32 = pa.array(at.astype(np.int32))
                segments = pa.array((at - np.arange(len(at))).astype(np.int32))  # one less than bounds a row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(packs), pa.array(bounds[at[1:] - 1], pa.int32()),
                     pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in places], pa.binary()),
                     pa.ListArray.from_arrays(at32, pa.array(bounds, pa.int32())),
                     pa.ListArray.from_arrays(segments, pa.array(docs, pa.int64(), mask=no_id)),
                     pa.ListArray.from_arrays(segments, pa.array(parts, pa.int32()))],
                    names=["pack", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_parts"])
    tasks = 3 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("name").repartition(tasks, "name").mapInArrow(run, _SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the matrices of all documents to the shared folder and returns the rows read back from them."""
    folder = common.shared_folder(spark, "matrices")
    return read_matrices(write_matrices(pack(common.table(spark, sf_dir, "documents")), folder), folder)
