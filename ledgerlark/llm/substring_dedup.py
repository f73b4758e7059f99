"""Removal of repeated passages by a distributed suffix sort.

A byte goes if a string of SIZE bytes that covers it also starts in a document with a smaller id.

1. Anchors. Each window of SIZE bytes has an anchor, the run of ANCHOR bytes in it with the least
   hash, so equal windows have equal anchors at equal places, wherever they stand. Documents send
   the hashes of their anchors once each; sorted by hash, equal neighbours show the shared ones.
   Windows whose anchor no other text has cannot repeat and are dealt with no further.
2. Segments. The windows with the same anchor occurrence lie side by side; together they are a
   segment of at most 2 * SIZE - ANCHOR bytes. Segments with shared anchors go to the task of
   their anchor.
3. Suffix sort. The suffixes that begin at the windows of a block of segments are sorted, within
   groups that have the same anchor at the same distance, as no others can agree. The
   sort is a mergesort whose comparisons find the common extension by binary search over prefix
   polynomial hashes, then compare the next byte. Neighbours that agree in SIZE bytes by hash are
   verified byte by byte; each class of equal windows belongs to its least document.

Exact copies of a text are one text from the start, under their least id. A block holds whole
anchors, and an anchor that more than HOT texts share sends its windows one by one under their own
hash instead; so blocks are bounded, whatever a passage's frequency.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import mix, powers, text_of
from ledgerlark.operators.common import stored

#: a longer anchor is shared by chance less often, a shorter one stands for more windows
SIZE, ANCHOR = 50, 20
#: an anchor's hash has 64 bits less these, a text's name 64 bits and these; by chance texts of one name are not to be met below 10**11 texts
NAME_BITS = 16
#: texts that share an anchor, above which its windows go one by one
HOT = 20_000
#: bytes of segments in a block, one anchor at least
BLOCK = 2 << 20
PIECE = 4 << 20
LAST = 2**63 - 1


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` bytes, by doubling."""
    weights = powers(size + 1)
    part = mix(data.astype(np.uint64) + np.uint64(1))
    total, done, step = None, 0, 1
    while True:
        if size & step:
            if total is None:
                total, done = part, step
            else:
                n = len(data) - done - step + 1
                total = total[:n] + part[done : done + n] * weights[done]
                done += step
        if done == size:
            return mix(total)
        part = part[:-step] + part[step:] * weights[step]
        step *= 2


def segments(data: bytes, size: int = SIZE, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor's place and anchor's hash of each segment of a text."""
    whole = np.frombuffer(data, np.uint8)
    parts = [_segments(whole[at : at + PIECE + size - 1], at, size, anchor) for at in range(0, max(0, len(whole) - size + 1), PIECE)]
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(data: np.ndarray, offset: int, size: int, anchor: int):
    hashes = run_hashes(data, anchor)
    # 40 bits of hash, then the place: the least is the first of the least hashes
    least = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
    wide, step = size - anchor + 1, 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < wide:
        least = np.minimum(least[: step - wide], least[wide - step :])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.append(first, len(at)))
    return first + offset, count, at[first] + offset, hashes[at[first]]


class Block:
    """Segments laid side by side with their prefix hashes, and the eight bytes at each place as a number."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.starts = np.cumsum([0, *(len(p) for p in pieces)])[:-1]
        self.powers = powers(len(self.data) + 1)
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], out=self.prefix[1:])
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.eight = np.zeros(len(self.data), np.uint64)
        for i in range(8):
            self.eight = (self.eight << np.uint64(8)) | padded[i : i + len(self.data)]

    def same(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes that begin `low` after a and after b have equal hashes."""
        x, y = a + low, b + low
        left, right = self.prefix[x + n] - self.prefix[x], self.prefix[y + n] - self.prefix[y]
        # bring both sums to the same power
        ahead = np.maximum(x, y)
        return left * self.powers[ahead - x] == right * self.powers[ahead - y]

    def common(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, at most `size`."""
        low = np.zeros(len(a), np.int64)
        step = 1 << (size.bit_length() - 1)
        while step:
            n = np.minimum(step, size - low)
            low += np.where((n > 0) & self.same(a, b, low, n), n, 0)
            step >>= 1
        return low

    def before(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """-1, 0 or 1 as the first `size` bytes (8 at least) at a are less than, equal to or more than those at b."""
        x, y = self.eight[a], self.eight[b]
        sign = (x > y).astype(np.int8) - (x < y)
        tie = np.flatnonzero(sign == 0)
        if len(tie):
            a, b = a[tie], b[tie]
            n = self.common(a, b, size)
            x, y = self.data[np.minimum(a + n, len(self.data) - 1)].astype(np.int16), self.data[np.minimum(b + n, len(self.data) - 1)]
            sign[tie] = np.where(n >= size, 0, np.sign(x - y))
        return sign

    def sort(self, at: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
        """Order of the suffixes at `at` by their first `size` bytes, within groups that lie side by side.

        Bottom-up mergesort of all groups at once: each element finds by binary search how many
        elements of the neighbouring run go before it, and moves there.
        """
        n = len(at)
        order = np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else order
        sizes = np.diff(np.append(first, n))
        begin, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
        width, longest = 1, int(sizes.max(initial=1))
        while width < longest:
            act = np.flatnonzero(end - begin > width)
            inside = act - begin[act]
            left = (inside // width) % 2 == 0
            run = begin[act] + inside // width * width
            other = np.where(left, np.minimum(run + width, end[act]), run - width)
            stop = np.minimum(other + width, end[act])
            low, high = other.copy(), np.maximum(stop, other)
            mine = at[order[act]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                sign = self.before(at[order[mid]], mine[open_], size)
                # equal elements of the left run stay before those of the right run
                goes = (sign < 0) | ((sign == 0) & ~left[open_])
                low[open_] = np.where(goes, mid + 1, low[open_])
                high[open_] = np.where(goes, high[open_], mid)
            pair = np.where(left, run, run - width)
            target = pair + (act - run) + (low - other)
            moved = order.copy()
            moved[target] = order[act]
            order = moved
            width *= 2
        return order


def owners(pieces: list[bytes], docs: np.ndarray, anchors: np.ndarray, key: np.ndarray, may: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """For each window of distinct segments, the least document that has it; and where each segment's windows begin.

    docs: the least document of each segment; anchors: where the anchor begins in it; key: a number
    for the anchor; may: whether another segment can have a window of it.
    """
    block = Block(pieces)
    counts = np.array([len(p) - size + 1 for p in pieces], np.int64)
    offset = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(pieces)), counts)
    inside = np.arange(len(of)) - offset[of]
    at = block.starts[of] + inside
    keys, distance = key[of], anchors[of] - inside
    open_ = np.flatnonzero(may[of])
    lay = open_[np.lexsort((distance[open_], keys[open_]))]
    group = np.cumsum((np.diff(keys[lay], prepend=-1) != 0) | (np.diff(distance[lay], prepend=-1) != 0)) - 1
    many = np.bincount(group)[group] > 1  # a window alone in its group has no equal
    lay, group = lay[many], group[many]
    first = docs[of]
    at, of_lay = at[lay], of[lay]
    order = block.sort(at, group, size)
    at, of_lay, group = at[order], of_lay[order], group[order]
    alike = np.flatnonzero((group[1:] == group[:-1]) & (block.before(at[:-1], at[1:], size) == 0)) if len(at) > 1 else np.empty(0, np.int64)
    if len(alike):
        span = np.arange(size)
        real = np.concatenate([
            (block.data[at[part][:, None] + span] == block.data[at[part + 1][:, None] + span]).all(1)
            for part in np.array_split(alike, max(1, len(alike) // 50_000))
        ])
        alike = alike[real]
    new = np.ones(len(at), bool)
    new[alike + 1] = False
    head = np.flatnonzero(new)
    if len(head):
        owner = np.minimum.reduceat(docs[of_lay], head)
        first[lay[order]] = np.repeat(owner, np.diff(np.append(head, len(at))))
    return first, np.append(offset, len(of))


def later_runs(first: np.ndarray, offset: np.ndarray, member: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a smaller document has: the row, the first window of the run in the row's segment, and their number.

    first, offset: from `owners`; member: the segment of each row; docs: the document of each row.
    """
    counts = offset[member + 1] - offset[member]
    begin = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(member)), counts)
    gone = first[np.arange(len(row)) + (offset[member] - begin)[row]] < docs[row]
    edge = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else gone
    starts = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
    ends = np.flatnonzero(gone & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([gone[1:], [False]])))
    return row[starts], starts - begin[row[starts]], ends - starts + 1


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[0::2], edges[1::2]


def _shared(anchors: DataFrame, hot: int) -> DataFrame:
    """The low 32 bits of anchors that more than one text has; inside one text that is enough to know them again.

    Rows arrive sorted by anchor; at most `hot` wait for a group's end.
    """

    def out(rows: np.ndarray, over) -> pa.RecordBatch:
        low = (rows[:, 0] >> NAME_BITS & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        name = (rows[:, 0] & (1 << NAME_BITS) - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(name), pa.array(low), pa.array(np.broadcast_to(over, len(rows)))], ["_t1", "_t2", "anchor", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = np.empty((0, 2), np.int64), None  # the group at hand; its anchor, once it is hot
        for batch in batches:
            rows = np.concatenate([held, np.column_stack([batch.column(c).to_numpy() for c in ("anchor", "_t1")])])
            anchor = rows[:, 0] >> NAME_BITS
            if over is not None:
                more = int(np.searchsorted(anchor != over, True))
                yield out(rows[:more], True)
                rows, anchor = rows[more:], anchor[more:]
            if not len(rows):
                continue
            over = None
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            sizes = np.repeat(np.diff(first), np.diff(first))
            many = sizes > 1
            yield out(rows[: first[-1]][many], sizes[many] > hot)
            held = rows[first[-1] :]
            if len(held) > hot:
                yield out(held, True)
                held, over = held[:0], anchor[-1]
        if len(held) > 1:
            yield out(held, False)

    return anchors.mapInArrow(run, "_t1 long, _t2 int, anchor int, hot boolean")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _name_of(text, size: int) -> tuple:
    """_t1, _t2: 64 and NAME_BITS hash bits of a text."""
    return F.xxhash64(text).alias("_t1"), F.shiftrightunsigned(F.xxhash64(F.lit(size), text), 64 - NAME_BITS).cast("int").alias("_t2")


def _segment(head: bytes, anchor: int) -> tuple[int, bytes]:
    """Place of the anchor in a segment, and the segment, of its head: anchor, its place, length of the segment, its other bytes."""
    place, body = head[anchor], head[anchor + 2 :]
    return place, body[:place] + head[:anchor] + body[place:]


def repeatable(heads: Iterable[bytes], hot: list[bool], size: int, anchor: int) -> np.ndarray:
    """Whether a window of each distinct segment can stand in another one.

    A window reaches half of its length without the anchor beyond the anchor on one side at least, so the other
    segment must have the same anchor with the same bytes beside it there. Lone windows have no equals.
    """
    side, body = (size - anchor + 1) // 2, anchor + 2
    left = [b"" if h or x[anchor] < side else x[:anchor] + x[body + x[anchor] - side : body + x[anchor]] for x, h in zip(heads, hot, strict=True)]
    right = [b"" if h or len(x) - body - x[anchor] < side else x[:anchor] + x[body + x[anchor] : body + x[anchor] + side] for x, h in zip(heads, hot, strict=True)]
    out = np.zeros(len(hot), bool)
    for keys in (left, right):
        seen = Counter(keys)
        out |= np.fromiter((k != b"" and seen[k] > 1 for k in keys), bool, len(keys))
    return out


@dataclass
class Rows:
    """Segments of a block as they were sent, each followed by the name of its text and its first windows there."""

    heads: list[bytes]
    hot: np.ndarray
    docs: np.ndarray
    t1: np.ndarray
    t2: np.ndarray
    many: np.ndarray  # first windows of each row
    at: np.ndarray  # the first windows, row by row

    @classmethod
    def of(cls, table: pa.Table, size: int, anchor: int) -> Rows:
        table = table.combine_chunks()
        values = table.column("row").chunk(0) if table.column("row").num_chunks else pa.array([], pa.binary())
        offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        hot = table.column("hot").to_numpy()
        lengths = np.full(len(values), size)
        cold = np.flatnonzero(~hot)
        lengths[cold] = data[offsets[:-1][cold] + anchor + 1].astype(np.int64) + 2
        tail = offsets[:-1] + lengths

        def numbers(at: np.ndarray, kind: type) -> np.ndarray:
            return data[at[:, None] + np.arange(np.dtype(kind).itemsize)].view(kind).ravel()

        many = (offsets[1:] - tail - 10) // 4
        inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        raw = data.tobytes() if len(values) else b""
        heads = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), tail.tolist(), strict=True)]
        return cls(heads, hot, table.column("doc").to_numpy(), numbers(tail, np.int64), numbers(tail + 8, np.uint16).astype(np.int32), many, numbers(np.repeat(tail + 10, many) + 4 * inside, np.int32).astype(np.int64))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, anchor: int = ANCHOR, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """_t1, _t2, _doc, _text, _gone: one row for each distinct text.

    _t1, _t2 name the text, _doc is its least id, _text is its bytes compressed (see `unpacked`).
    _gone lists runs of windows to go, as the first byte times 256 plus their number; null if none go.
    """
    if not 8 <= anchor < size or 2 * size - anchor > 255:
        raise ValueError("segments have at most 255 bytes, anchors at least 8")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("_doc"), text_of(text).cast("binary").alias("_text"))
    rows = rows.select(*_name_of(F.col("_text"), size), "_doc", "_text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            yield batch.set_column(at, "_text", pa.array([squeeze(t.as_py()) for t in batch.column(at)], pa.binary()))

    # one row for each distinct text, found before and after the shuffle; texts travel compressed
    texts = rows.mapInArrow(pack, rows.schema).groupBy("_t1", "_t2").agg(F.min("_doc").alias("_doc"), F.first("_text").alias("_text"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [np.unique(segments(unpacked(t.as_py()), size, anchor)[3] >> np.uint64(NAME_BITS)) for t in batch.column("_text")]
            many = np.array([len(x) for x in found])
            # anchor and the end of the name as one number: rows of two, which a shuffle writes shorter
            names = np.repeat(batch.column("_t2").to_numpy().astype(np.uint64), many)
            both = _signed(np.concatenate(found) << np.uint64(NAME_BITS) | names)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(np.repeat(batch.column("_t1").to_numpy(), many))], ["anchor", "_t1"])

    sent = texts.mapInArrow(send, "anchor long, _t1 long").repartition(F.shiftright("anchor", NAME_BITS)).sortWithinPartitions("anchor", "_t1")
    shared = _shared(sent, hot).groupBy("_t1", "_t2").agg(F.collect_list("anchor").alias("_anchors"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("_hot"))

    def cut_text(data: bytes, wanted: np.ndarray, hot: np.ndarray) -> tuple[dict[bytes, bytes], dict[bytes, bytes]]:
        """The distinct segments whose anchor is wanted, as heads, and their first windows; the windows of hot anchors one by one."""
        first, count, place, hashes = segments(data, size, anchor)
        low = (hashes >> np.uint64(NAME_BITS) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
        take = np.isin(low, wanted)
        lone = take & np.isin(low, hot)
        take &= ~lone
        whole, single = {}, {}
        begins = first[take]
        where = begins.astype(np.int32).tobytes()
        for i, (f, end, p) in enumerate(zip(begins.tolist(), (begins + count[take] + size - 1).tolist(), place[take].tolist(), strict=True)):
            head = data[p : p + anchor] + bytes((p - f, end - f)) + data[f:p] + data[p + anchor : end]
            whole[head] = whole.get(head, b"") + where[4 * i : 4 * i + 4]
        for f, c in zip(first[lone].tolist(), count[lone].tolist(), strict=True):
            for at in range(f, f + c):
                head = data[at : at + size]
                single[head] = single.get(head, b"") + struct.pack("<i", at)
        return whole, single

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [
                cut_text(unpacked(t.as_py()), a.values.to_numpy(), h.values.to_numpy(zero_copy_only=False))
                for t, a, h in zip(*(batch.column(c) for c in ("_text", "_anchors", "_hot")), strict=True)
            ]
            names = [struct.pack("<qH", *x) for x in zip(*(batch.column(c).to_pylist() for c in ("_t1", "_t2")), strict=True)]
            rows = [head + name + at for f, name in zip(found, names, strict=True) for kind in f for head, at in kind.items()]
            docs = np.repeat(batch.column("_doc").to_numpy(), [len(whole) + len(single) for whole, single in found])
            hot = np.tile([False, True], len(found)).repeat([len(kind) for f in found for kind in f])
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(hot, pa.bool_()), pa.array(rows, pa.binary())], ["doc", "hot", "row"])

    marked = texts.join(shared, ["_t1", "_t2"]).select("_t1", "_t2", "_doc", "_text", "_anchors", "_hot")
    # the key is the anchor's bytes or else the window, with which the value begins
    key = F.substring(F.col("row"), F.lit(1), F.when(F.col("hot"), F.lit(size)).otherwise(F.lit(anchor)))
    pieces = marked.mapInArrow(cut, "doc long, hot boolean, row binary").repartition(key).sortWithinPartitions(key, "doc")

    def keys_of(table: pa.Table) -> np.ndarray:
        """Numbers of the keys, which lie side by side."""
        rows = table.column("row").combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        begin = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows)].astype(np.int64)
        data, hot = np.frombuffer(rows.buffers()[2], np.uint8), table.column("hot").to_numpy()
        new = np.append(True, hot[1:] != hot[:-1])
        for cold, length in ((True, anchor), (False, size)):
            at = np.flatnonzero(hot ^ cold)
            names = data[begin[at][:, None] + np.arange(length)]
            new[at[1:]] |= (names[1:] != names[:-1]).any(1)
        return np.cumsum(new) - 1

    def settle(table: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
        rows = Rows.of(table, size, anchor)
        # equal segments are taken once, under their least document; a head names anchor, place and bytes
        seen: dict[bytes, int] = {}
        member = np.array([seen.setdefault(x, len(seen)) for x in rows.heads], np.int64)
        some = np.zeros(len(seen), np.int64)
        some[member] = np.arange(len(member))
        least = np.full(len(seen), LAST)
        np.minimum.at(least, member, rows.docs)
        hot = rows.hot[some].tolist()
        parts = [(0, x) if h else _segment(x, anchor) for x, h in zip(seen, hot, strict=True)]
        may = repeatable(seen, hot, size, anchor)
        first, offset = owners([x for _, x in parts], least, np.array([p for p, _ in parts], np.int64), keys[some], may, size)
        row, start, many = later_runs(first, offset, member, rows.docs)
        # once for each place at which the text has the segment
        times = rows.many[row]
        run = np.repeat(np.arange(len(row)), times)
        spot = (np.cumsum(rows.many) - rows.many)[row[run]] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows.t1[row[run]]), pa.array(rows.t2[row[run]]), pa.array((rows.at[spot] + start[run]) << 8 | many[run])], ["_t1", "_t2", "run"]
        )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        amount = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            amount += batch.nbytes
            if amount < block:
                continue
            rows = pa.concat_tables(held)
            keys = keys_of(rows)
            last = int(np.searchsorted(keys, keys[-1]))  # this key may go on
            if last:
                yield settle(rows.slice(0, last), keys[:last])
            rest = rows.slice(last).combine_chunks()
            if rest.nbytes > block:
                # rows come by rising document: what comes later only needs the first of equal segments
                yield settle(rest, keys[last:])
                firsts: dict[bytes, int] = {}
                for i, head in enumerate(Rows.of(rest, size, anchor).heads):
                    firsts.setdefault(head, i)
                rest = rest.take(list(firsts.values()))
            held, amount = [rest], 0
        if held and (rows := pa.concat_tables(held)).num_rows:
            yield settle(rows, keys_of(rows))

    gone = pieces.mapInArrow(resolve, "_t1 long, _t2 int, run long")
    lists = gone.groupBy("_t1", "_t2").agg(F.collect_list("run").alias("_gone"))
    return texts.join(lists, ["_t1", "_t2"], "left").select("_t1", "_t2", "_doc", "_text", "_gone")


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def removed_runs(length: int, gone: list[int], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the runs of windows cover."""
    runs = np.array(gone, np.int64)
    edge = np.bincount(runs >> 8, minlength=length + 1) - np.bincount((runs >> 8) + (runs & 255) + size - 1, minlength=length + 1)
    return runs_of(np.cumsum(edge[:-1]) > 0)


def cut_out(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes outside the runs, concatenated."""
    return b"".join(data[s:e] for s, e in zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, anchor: int = ANCHOR, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Null text counts as empty and loses nothing, as does any text shorter than `size` bytes. A null
    id counts as larger than all ids. Of repeated rows with one id none loses bytes to another;
    rows with the same id and different texts do not take from each other either. An empty table
    gives an empty result; other columns are ignored. Texts of any length are cut whole.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, gone in zip(batch.column("_text"), batch.column("_gone"), strict=True):
                data = unpacked(data.as_py())
                starts, ends = removed_runs(len(data), gone.as_py() or [], size)
                out.append((int((ends - starts).sum()), len(starts), hashlib.sha256(cut_out(data, starts, ends)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_t1", "_t2", "_doc")), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
                ["_t1", "_t2", "_doc", "n_removed", "n_spans", "kept_sha256"],
            )

    first = stored(
        spans(docs, doc_id, text, size, anchor, hot, block).mapInArrow(digest, "_t1 long, _t2 int, _doc long, n_removed long, n_spans long, kept_sha256 string"),
        "substrings",
    )
    plain = text_of(text).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("_id"),
        *_name_of(plain, size), F.octet_length(plain).cast("long").alias("n_bytes"),
    )
    copy = (F.col("_id") > F.col("_doc")) & (F.col("n_bytes") >= size)
    return rows.join(first, ["_t1", "_t2"]).select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
