"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship
from .textbatch import slices
from .transducer import compiled

#: Rows packed together: enough that the one unfilled sequence of a group is below 0.1 %.
GROUP_ROWS = 4096

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


def attention_cost(length, linear: float, quadratic: float):
    """The estimated cost of one document in a sequence."""
    return linear * length + quadratic * length * length


def balance(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pack pieces shorter than a sequence.

    In descending order, each piece goes to the sequence of lowest cost so far
    that has room for it.  There are as few sequences as the tokens need; a
    piece for which none has room is cut: its beginning fills the sequence with
    most room, and the rest waits for its turn by its own length.

    Returns (piece, begin in piece, length, sequence, offset in sequence); ties
    go to the earlier piece and the earlier sequence.
    """
    count = -(-sum(lengths) // capacity)
    room = np.full(count, capacity, dtype=np.int64)
    cost = np.zeros(count)
    todo = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    out = []
    while todo:
        n, i, begin = heapq.heappop(todo)
        n = -n
        fits = room >= n
        at = int(np.where(fits, cost, np.inf).argmin())
        if not fits[at]:
            at = int(room.argmax())
            cut = int(room[at])
            heapq.heappush(todo, (cut - n, i, begin + cut))
            n = cut
        out.append((i, begin, n, at, capacity - int(room[at])))
        room[at] -= n
        cost[at] += attention_cost(n, linear, quadratic)
    return out


def pack(docs: DataFrame, vocab_path: str, capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1.0 / 4096, group_rows: int = GROUP_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    A document is its ids and then end_id.  Its full stretches of ``capacity``
    are sequences of their own; the rest is packed by ``balance`` in groups
    dealt by a hash of the row and its place, of about group_rows documents each,
    so no group grows with the input, nor with how often an id or a row occurs.  Returns one row per piece: doc_id, start, length,
    ids_crc32 (of the little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset, sequence_cost.  A null text is empty: one piece with
    end_id alone.  Null ids and repeated rows are packed like any other; an
    empty table gives no row; other columns are ignored.
    """
    ship(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_rows))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(vocab_path)
        narrow = np.uint16 if machine.vocab.size <= 65536 else np.uint32
        for batch in batches:
            for first, last, texts in slices(batch.column(1)):
                ids, off = machine.ids(texts)
                n = np.diff(off) + 1
                ids = np.insert(ids, off[1:], end_id).astype(np.uint32)
                begin = np.concatenate([[0], np.cumsum(n)])
                doc, start, length, crc, rest = [], [], [], [], []
                for i in range(texts.n):
                    own = ids[begin[i] : begin[i + 1]]
                    for s in range(0, len(own), capacity):
                        part = own[s : s + capacity]
                        doc.append(i)
                        start.append(s)
                        length.append(len(part))
                        full = len(part) == capacity
                        crc.append(zlib.crc32(part.astype("<u4").tobytes()) if full else None)
                        rest.append(None if full else part.astype(narrow).tobytes())
                doc = np.array(doc, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first).take(pa.array(doc)), batch.column(2).slice(first, last - first).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(n[doc], pa.int64()), pa.array(rest, pa.binary())],
                    names=["doc_id", "grp", "start", "length", "ids_crc32", "doc_tokens", "rest"],
                )

    def packed(group: pa.Table) -> pa.Table:
        t = group.sort_by([("doc_id", "ascending"), ("start", "ascending")]) if group.num_rows else group
        col = {c: t.column(c).to_pylist() for c in ("doc_id", "grp", "start", "length", "ids_crc32", "doc_tokens", "rest")}
        base = (col["grp"][0] if t.num_rows else 0) << 32
        narrow = "<u2" if compiled(vocab_path).vocab.size <= 65536 else "<u4"
        full_cost = float(attention_cost(capacity, linear, quadratic))
        rows, open_ = [], []
        for i in range(t.num_rows):
            if col["rest"][i] is None:
                rows.append((col["doc_id"][i], col["start"][i], capacity, col["ids_crc32"][i], col["doc_tokens"][i], base + len(rows), 0, full_cost))
            else:
                open_.append(i)
        base += len(rows)
        placed = balance([col["length"][i] for i in open_], capacity, linear, quadratic)
        cost: dict[int, float] = {}
        for _, _, n, at, _ in placed:
            cost[at] = cost.get(at, 0.0) + attention_cost(n, linear, quadratic)
        for k, begin, n, at, offset in placed:
            i = open_[k]
            ids = np.frombuffer(col["rest"][i], dtype=narrow)[begin : begin + n]
            rows.append((col["doc_id"][i], col["start"][i] + begin, n, zlib.crc32(ids.astype("<u4").tobytes()), col["doc_tokens"][i], base + at, offset, cost[at]))
        kinds = [t.schema.field("doc_id").type, *[pa.int64()] * 6, pa.float64()]
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id()), F.lit(groups)).alias("grp"))
    kind = src.schema["doc_id"].dataType.simpleString()
    cut = src.mapInArrow(pieces, f"doc_id {kind}, grp long, start long, length long, ids_crc32 long, doc_tokens long, rest binary")
    return cut.groupBy("grp").applyInArrow(packed, _PIECE.replace("doc_id long", f"doc_id {kind}", 1))
