"""Word multisets as sparse fingerprints, and exact pigeonhole blocks over them.

A text's fingerprint is the set of its *elements*: every word together with its occurrence number, hashed to 32 bits.
The word-multiset similarity of two texts is the Jaccard similarity of their element sets, and the size of the
symmetric difference is the Hamming distance of the two (sparse) bit vectors:

    similarity >= t   <=>   Hamming <= (1 - t) / (1 + t) * (n_a + n_b)

Blocks. Elements are put into one global order, rare before frequent (any fixed order is right, this one makes small
blocks). Two close texts share at least ``o = ceil(t / (1 + t) * (n_a + n_b))`` elements, so the longer one has at most
``n - ceil(t n)`` elements before their first common one and the shorter at most ``n - ceil(2t / (1 + t) n)``: with one block
more than there can be differences, one block must agree. A row of a block notes how many elements were *skipped* before it,
and whether it may stand for the longer (``LONG``) and for the shorter side (``SHORT``) of a pair. Texts of very different
sizes have separate blocks.

Blocks that grow. The rows of each block are counted, exactly and distributed (``find_splits``). A block of more than ``hot``
rows is split by the next common element of its pairs where that is cheaper than comparing them, up to ``LEVELS``
elements; one that is still larger, such as a family of texts that really are alike, is cut into a grid of sub-blocks of about
``hot`` rows a side, which holds every pair once. Whatever was decided, no close pair is lost and no block is capped.
The table of split blocks is broadcast and has at most ``MOST_SPLITS`` entries: were there more, only the largest would be split.

The order comes from a counting table of fixed size (``BUCKETS`` counters over all texts), so its broadcast does not grow;
full counters make the order poorer, not the result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialize

WORD = r"[\p{L}\p{N}]+"
BUCKETS = 1 << 20
#: Rows a block may hold before it is split, elements a block may be named by, entries of the broadcast table of split blocks.
HOT = 1024
LEVELS = 3
MOST_SPLITS = 1 << 19
#: A row more costs about as much as this many compared pairs.
ROW_COST = 128
#: Texts of fewer words than one of these and texts of as many or more stand in separate blocks.
SIZE_STEPS = (256, 2048, 16384, 131072, 1048576)
LONG, SHORT = 1, 2
MIN_WORDS = 15
#: Size of the bit table that keeps vectors nobody asks for out of a shuffle (2 MB).
SIEVE_BITS = 1 << 24
SIMILARITY = 0.7


def words(col: Column) -> Column:
    """Maximal runs of letters or digits of the lower-cased text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(WORD), F.lit(0))


def word_hashes(col: Column) -> Column:
    """The words' 64-bit hashes in ascending order, with repetition."""
    return F.sort_array(F.transform(words(col), lambda w: F.xxhash64(w)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def elements(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements (uint32) of ascending word hashes, ascending within each text; and the text of each."""
    n = np.diff(offsets)
    rec = np.repeat(np.arange(len(n), dtype=np.int64), n)
    if not len(values):
        return np.empty(0, np.uint32), rec
    first = np.empty(len(values), bool)
    first[0] = True
    first[1:] = (values[1:] != values[:-1]) | (rec[1:] != rec[:-1])
    at = np.arange(len(values), dtype=np.int64)
    occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
    e = _mix(values.view(np.uint64) + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    key = (rec.astype(np.uint64) << np.uint64(32)) | e
    key.sort()
    return (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), rec


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets from 0 of a list column without nulls."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off.astype(np.int64) - off[0]


def binary_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The uint32 values packed in a binary column, with offsets."""
    wide = pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if off[-1] == off[0]:
        return np.empty(0, np.uint32), off - off[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]]
    return np.frombuffer(data.tobytes(), np.uint32), (off - off[0]) // 4


def pack_binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def sketches(e: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 parity bits: each element flips one. Their Hamming distance never exceeds that of the element sets."""
    h = _mix(e.astype(np.uint64) + np.uint64(0x51ED270B))
    bit = np.uint64(1) << (h & np.uint64(63))
    upper = (h >> np.uint64(6)) & np.uint64(1) == 1
    full = np.diff(offsets) > 0
    out = []
    for part in (np.where(upper, bit, np.uint64(0)), np.where(upper, np.uint64(0), bit)):
        x = np.zeros(len(full), np.uint64)
        if len(part):
            x[full] = np.bitwise_xor.reduceat(part, offsets[:-1][full])
        out.append(x.view(np.int64))
    return out[0], out[1]


def fingerprints(df: DataFrame, text: str, keep: list[str], least: int = MIN_WORDS) -> DataFrame:
    """``keep`` columns of the texts with at least ``least`` words, with n, cls (hash of the word multiset: equal multisets
    are one class), vec (elements as packed uint32) and the sketch s1, s2. Null, empty and shorter texts have no row."""
    keep_fields = [df.schema[c] for c in keep]
    src = (
        df.select(*keep, word_hashes(F.col(text)).alias("_h"))
        .where(F.size("_h") >= max(1, least))
        .select(*keep, F.size("_h").alias("n"), F.xxhash64("_h").alias("cls"), "_h")
    )
    schema = T.StructType([*keep_fields, T.StructField("n", T.IntegerType()), T.StructField("cls", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())])
    names = [f.name for f in schema]

    def run(batches):
        for b in batches:
            values, off = list_values(b.column(b.num_columns - 1))
            e, _ = elements(values, off)
            s1, s2 = sketches(e, off)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pack_binary(e, off), pa.array(s1), pa.array(s2)], names=names)

    return src.mapInArrow(run, schema)


def frequency_table(fp: DataFrame) -> np.ndarray:
    """How many texts hold an element of each bucket (saturating int32): ``BUCKETS`` counters over all rows of ``fp``."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            e, _ = binary_values(b.column(0))
            counts += np.bincount(e & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["bucket", "n"])

    got = fp.select("vec").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS, np.int64)
    table[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(table, 2**31 - 1).astype(np.int32)


def overlap_needed(n_a, n_b, t: float):
    return np.ceil(t / (1 + t) * (n_a + n_b) - 1e-9).astype(np.int64)


class Splits(NamedTuple):
    """Large blocks of one level, keys ascending: whether they are split by a further element, else the grid's sides."""

    key: np.ndarray
    split: np.ndarray
    short: np.ndarray
    long: np.ndarray
    rows_short: np.ndarray
    rows_long: np.ndarray


def _join(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    return _mix(key * np.uint64(0x9E3779B97F4A7C15) + more.astype(np.uint64) + np.uint64(1))


def _named(e: np.ndarray, off: np.ndarray, freq: np.ndarray, t: float, splits: list[Splits], levels: int, upto: int | None = None, above: int = -1):
    """Blocks of every text, as (text, skipped, key, is own size class, further rows, sides of the grid, key of the block it was split from).

    With ``upto`` only the rows of that level, split or not, and only those whose first element has a counter ``above``."""
    n = np.diff(off)
    rec = np.repeat(np.arange(len(n), dtype=np.int64), n)
    count = freq[e & np.uint32(BUCKETS - 1)].astype(np.int64)
    order = np.lexsort((e, (rec << 32) | count))
    e = e[order]
    pos = np.arange(len(e), dtype=np.int64) - off[:-1][rec]
    most = n - np.ceil(t * n - 1e-9).astype(np.int64)
    least_class = np.searchsorted(SIZE_STEPS, np.ceil(t * n - 1e-9), side="right")
    own_class = np.searchsorted(SIZE_STEPS, n, side="right")
    first = np.flatnonzero((pos <= most[rec]) & (count[order] > above))
    back = (own_class - least_class)[rec[first]]
    at = np.repeat(first, back + 1)
    step = np.arange(len(at), dtype=np.int64) - np.repeat(np.cumsum(back + 1) - back - 1, back + 1)
    key = _join(e[at].astype(np.uint64), (own_class[rec[at]] - step).astype(np.uint64))
    own, parent = step == 0, np.zeros(len(at), np.uint64)
    for level in range(1, levels + 1):
        r = rec[at]
        further = np.minimum(most[r] + level, n[r] - 1) - pos[at]
        table = splits[level - 1] if level <= len(splits) else None
        short = long = np.ones(len(at), np.int64)
        split = np.zeros(len(at), bool)
        if table is not None and len(table.key) and len(at):
            i = np.minimum(np.searchsorted(table.key, key), len(table.key) - 1)
            hit = table.key[i] == key
            split = hit & table.split[i]
            short, long = np.where(hit & ~split, table.short[i], 1), np.where(hit & ~split, table.long[i], 1)
        if upto == level:
            yield r, pos[at] - level + 1, key, own, further, short, long, parent
            return
        if upto is None:
            end = ~split
            yield r[end], (pos[at] - level + 1)[end], key[end], own[end], further[end], short[end], long[end], parent[end]
        if not split.any():
            return
        at, key, own, further = at[split], key[split], own[split], np.maximum(further[split], 0)
        step = np.arange(further.sum(), dtype=np.int64) - np.repeat(np.cumsum(further) - further, further)
        at = np.repeat(at, further) + step + 1
        parent, own = np.repeat(key, further), np.repeat(own, further)
        key = _join(parent, e[at])


def _skippable(n: np.ndarray, t: float) -> np.ndarray:
    """Elements that the shorter text of a close pair may have before the first common one."""
    return n - np.ceil(2 * t / (1 + t) * n - 1e-9).astype(np.int64)


def _ranges(n: np.ndarray) -> np.ndarray:
    """0, 1 .. n - 1 for each of ``n``, end to end."""
    return np.arange(n.sum(), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)


def block_rows(e: np.ndarray, off: np.ndarray, cls: np.ndarray, freq: np.ndarray, t: float, splits: list[Splits], role: str = "both", levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, size << 32 | skipped << 2 | sides) of every block row.

    ``role`` is ``both`` for a collection compared with itself; for two collections that are compared with each other one has
    ``stored`` rows and the other ``probe`` rows."""
    n = np.diff(off)
    chunk = (_mix(cls.view(np.uint64) + np.uint64(77)) >> np.uint64(33)).astype(np.int64)
    out = []

    def add(rec, skipped, key, sides):
        out.append((rec, key.view(np.int64), (n[rec] << 32) | (skipped << 2) | sides))

    for rec, skipped, key, own, _, short, long, _ in _named(e, off, freq, t, splits, levels):
        as_short = own & (skipped <= _skippable(n[rec], t))
        sides = LONG + SHORT * as_short
        cut = (short > 1) | (long > 1)
        add(rec[~cut], skipped[~cut], key[~cut], sides[~cut])
        rec, skipped, key, sides, short, long, as_short = rec[cut], skipped[cut], key[cut], sides[cut], short[cut], long[cut], as_short[cut]
        if role == "stored":
            add(rec, skipped, _join(key, chunk[rec] % long), sides)
        elif role == "probe":
            at = np.repeat(np.arange(len(rec)), long)
            add(rec[at], skipped[at], _join(key[at], _ranges(long)), sides[at])
        else:
            at = np.repeat(np.arange(len(rec)), short)
            add(rec[at], skipped[at], _join(_join(key[at], _ranges(short)), (chunk[rec] % long)[at]), np.full(len(at), LONG))
            at = np.repeat(np.flatnonzero(as_short), long[as_short])
            add(rec[at], skipped[at], _join(_join(key[at], (chunk[rec] % short)[at]), _ranges(long[as_short])), np.full(len(at), SHORT))
    return tuple(np.concatenate(x) for x in zip(*out))


def _slices(column: pa.Array, most: int = 1 << 18):
    """(from, to) of runs of rows of about ``most`` elements in all, so that long texts do not fill a worker's memory."""
    ends = (np.cumsum(np.diff(binary_values(column)[1])) // most).astype(np.int64)
    cuts = np.flatnonzero(np.diff(ends)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)])


def _once(b: pa.RecordBatch, distinct: str) -> pa.RecordBatch:
    """Copies within a batch count once."""
    _, first = np.unique(b.column(b.schema.get_field_index(distinct)).to_numpy(), return_index=True)
    return b.take(pa.array(np.sort(first))) if len(first) < b.num_rows else b


def deepest(t: float, min_words: int) -> int:
    """Elements that two close texts of at least ``min_words`` words share for certain, as far as levels go."""
    return max(1, min(LEVELS, int(np.ceil(t * max(1, min_words) - 1e-9))))


def count_blocks(e: np.ndarray, off: np.ndarray, freq: np.ndarray, t: float, splits: list[Splits], level: int, hot: int) -> tuple[np.ndarray, ...]:
    """Of each block of a level: key, key of the block it was split from, rows for the shorter and for the longer side, and the rows it would have if it were split."""
    n = np.diff(off)
    for rec, skipped, key, own, further, _, _, parent in _named(e, off, freq, t, splits, level, level, hot):
        keys, one, at = np.unique(key, return_index=True, return_inverse=True)
        sums = [np.bincount(at, w, len(keys)).astype(np.int64) for w in (own & (skipped <= _skippable(n[rec], t)), np.ones(len(at)), np.maximum(further, 0))]
        return keys.view(np.int64), parent[one].view(np.int64), *sums
    return tuple(np.empty(0, np.int64) for _ in range(5))


def decide(key: np.ndarray, short: np.ndarray, long: np.ndarray, further: np.ndarray, hot: int, can_split: bool) -> Splits:
    """Split a large block by a further element if its pairs cost more than the rows, else cut it into a grid."""
    order = np.argsort(key.view(np.uint64))
    key, short, long, further = key[order].view(np.uint64), short[order], long[order], further[order]
    split = (further * ROW_COST < short * long) & can_split
    side = max(1, hot)
    return Splits(key, split, -(-np.maximum(short, 1) // side), -(-long // side), short, long)


def keep_useful(splits: Splits, parent: np.ndarray, pairs: np.ndarray) -> Splits:
    """Blocks whose pairs mostly meet in large blocks again (``parent`` and ``pairs`` of these) are families of texts that are
    alike; they are cut into a grid rather than split."""
    at = np.searchsorted(splits.key, parent.view(np.uint64))
    again = np.bincount(at, pairs, len(splits.key))
    hot_pairs = splits.rows_short * splits.rows_long
    return splits._replace(split=splits.split & (2 * again < hot_pairs))


def find_splits(fp: DataFrame, freq: np.ndarray, t: float = SIMILARITY, hot: int = HOT, min_words: int = MIN_WORDS) -> list[Splits]:
    """The large blocks of each level, from exact counts of their rows.

    A block can only be large if the counter of its first element is above ``hot``; only such rows are counted, after
    a first count within each batch."""
    shared = fp.sparkSession.sparkContext.broadcast(freq)
    levels, splits = deepest(t, min_words), []
    for level in range(1, levels + 1):
        so_far = fp.sparkSession.sparkContext.broadcast(splits)

        def run(batches, level=level, so_far=so_far):
            freq, splits = shared.value, so_far.value
            for b in batches:
                if not b.num_rows:
                    continue
                b = _once(b, "cls")
                for lo, hi in _slices(pa.concat_arrays([b.column(0)])):
                    e, off = binary_values(pa.concat_arrays([b.column(0).slice(lo, hi - lo)]))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in count_blocks(e, off, freq, t, splits, level, hot)], names=["key", "parent", "short", "long", "further"])

        counted = fp.select("vec", "cls").mapInArrow(run, "key bigint, parent bigint, short bigint, long bigint, further bigint")
        large = materialize(counted.groupBy("key").agg(F.min("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("short", "long", "further")]).where(F.col("long") > hot), "large-blocks")
        held = large.agg(F.count(F.lit(1)).alias("n"), F.sum("long").alias("rows")).first()
        if not held["n"]:
            break
        if held["n"] > MOST_SPLITS:  # at most MOST_SPLITS blocks can hold more than this many of the rows
            large = large.where(F.col("long") > held["rows"] // MOST_SPLITS + 1)
        got = large.toArrow()
        key, parent, short, long, further = (got.column(c).to_numpy() for c in ("key", "parent", "short", "long", "further"))
        if splits:
            splits[-1] = keep_useful(splits[-1], parent, short * long)
        splits.append(decide(key, short, long, further, hot, level < levels))
        if not splits[-1].split.any():
            break
    return splits


def blocks(fp: DataFrame, freq: np.ndarray, splits: list[Splits], t: float = SIMILARITY, role: str = "both", carry: tuple[str, ...] = ("cls", "s1", "s2"), min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (key, np = size << 32 | skipped << 2 | sides, carry...) of the blocks. Copies within a batch count once."""
    shared = fp.sparkSession.sparkContext.broadcast((freq, splits))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("np", T.LongType()), *[fp.schema[c] for c in carry]])
    names = [f.name for f in schema]
    levels = deepest(t, min_words)

    def run(batches):
        freq, splits = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            b = _once(b, "cls")
            for lo, hi in _slices(pa.concat_arrays([b.column(0)])):
                part = b.slice(lo, hi - lo)
                e, off = binary_values(pa.concat_arrays([part.column(0)]))
                rec, key, np_ = block_rows(e, off, part.column(1).to_numpy(), freq, t, splits, role, levels)
                for at in range(0, len(rec), 1 << 17):
                    cut = slice(at, at + (1 << 17))
                    take = pa.array(rec[cut])
                    yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(np_[cut]), *[part.column(part.schema.get_field_index(c)).take(take) for c in carry]], names=names)

    return fp.select("vec", "cls", *[c for c in carry if c != "cls"]).mapInArrow(run, schema)


def size_of(np_: Column) -> Column:
    return F.shiftright(np_, 32)


def skipped_of(np_: Column) -> Column:
    return F.shiftright(np_, 2).bitwiseAND(F.lit(0x3FFFFFFF))


def has_side(np_: Column, side: int) -> Column:
    return np_.bitwiseAND(F.lit(side)) != 0


def needed(n_a: Column, n_b: Column, t: float) -> Column:
    """The overlap of close texts is at least this (not rounded up: conditions in the inner loop stay plain arithmetic)."""
    return (n_a + n_b) * F.lit(t / (1 + t)) - F.lit(1e-9)


def pair_filter(np_a: Column, np_b: Column, t: float) -> Column:
    """Sizes, and elements skipped before the common ones, allow the similarity."""
    o = needed(size_of(np_a), size_of(np_b), t)
    return (o <= size_of(np_a) - skipped_of(np_a)) & (o <= size_of(np_b) - skipped_of(np_b))


def met(rows: DataFrame, t: float) -> DataFrame:
    """(a, b), a < b: different classes that share a block of one collection (``role`` both).

    The rows are shuffled once; the two sides are told apart after that. Their filters name a row number (without effect),
    else the optimizer would move them below the shuffle and shuffle twice."""
    rows = rows.repartition("key")
    no = F.monotonically_increasing_id() < 0
    x, y = rows.where(has_side(F.col("np"), LONG) | no).alias("x"), rows.where(has_side(F.col("np"), SHORT) | no).alias("y")
    n_x, n_y = size_of(F.col("x.np")), size_of(F.col("y.np"))
    longer = (n_x > n_y) | ((n_x == n_y) & (F.col("x.cls") > F.col("y.cls")))
    return (
        x.join(y, (F.col("x.key") == F.col("y.key")) & longer & pair_filter(F.col("x.np"), F.col("y.np"), t) & sketch_filter("x", "y", n_x, n_y, t))
        .select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
        .distinct()
    )


def met_across(probes: DataFrame, stored: DataFrame, t: float) -> DataFrame:
    """(a, b): classes of ``probes`` and different ones of ``stored`` that share a block; repeated."""
    x, y = probes.alias("x"), stored.alias("y")
    n_x, n_y = size_of(F.col("x.np")), size_of(F.col("y.np"))
    return x.join(
        y, (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") != F.col("y.cls")) & pair_filter(F.col("x.np"), F.col("y.np"), t) & sketch_filter("x", "y", n_x, n_y, t)
    ).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"))


def sketch_filter(a, b, n_a: Column, n_b: Column, t: float) -> Column:
    """The parity bits' Hamming distance is within the bound of the elements' one."""
    d = F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1"))) + F.bit_count(F.col(f"{a}.s2").bitwiseXOR(F.col(f"{b}.s2")))
    return d <= n_a + n_b - F.lit(2) * needed(n_a, n_b, t)


def sifted(fp: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp`` (cls, vec) without most rows whose cls is not in ``wanted`` (cls), before anything is shuffled: a bit table of fixed
    size (``SIEVE_BITS``) holds the wanted hashes. Some others pass; none that is wanted is lost."""
    mask = SIEVE_BITS // 64 - 1
    word = F.shiftright("cls", 6).bitwiseAND(F.lit(mask)).cast("int")
    bit = F.expr("shiftleft(1L, cast(cls & 63 as int))")
    got = wanted.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(mask + 1, np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    shared = fp.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        bits = shared.value
        for b in batches:
            c = b.column(0).to_numpy().view(np.uint64)
            hit = (bits[((c >> np.uint64(6)) & np.uint64(mask)).astype(np.int64)] >> (c & np.uint64(63))) & np.uint64(1)
            yield b.filter(pa.array(hit == 1))

    return fp.mapInArrow(run, fp.schema)


def overlaps(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row: common elements, and the sizes, of two packed vectors."""
    ea, oa = binary_values(a)
    eb, ob = binary_values(b)
    row = np.arange(len(oa) - 1, dtype=np.uint64)
    ka = (np.repeat(row, np.diff(oa)) << np.uint64(32)) | ea
    kb = (np.repeat(row, np.diff(ob)) << np.uint64(32)) | eb
    both = np.concatenate([ka, kb])
    both.sort(kind="stable")
    same = both[:-1][both[1:] == both[:-1]] >> np.uint64(32)
    return np.bincount(same.astype(np.int64), minlength=len(row)), np.diff(oa), np.diff(ob)


def verified(pairs: DataFrame, vec_a: str, vec_b: str, keep: list[str], t: float = SIMILARITY) -> DataFrame:
    """Pairs whose Hamming distance is within the bound, with their similarity; ``keep`` columns stay."""
    schema = T.StructType([*[pairs.schema[c] for c in keep], T.StructField("similarity", T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                b = whole.slice(lo, 8192)
                if not b.num_rows:
                    continue
                common, n_a, n_b = overlaps(pa.concat_arrays([b.column(0)]), pa.concat_arrays([b.column(1)]))
                hamming = n_a + n_b - 2 * common
                ok = hamming <= n_a + n_b - 2 * overlap_needed(n_a, n_b, t)
                keep_at = pa.array(np.flatnonzero(ok))
                yield pa.RecordBatch.from_arrays([*[c.take(keep_at) for c in b.columns[2:]], pa.array((common / np.maximum(1, n_a + n_b - common))[ok])], names=names)

    return pairs.select(vec_a, vec_b, *keep).mapInArrow(run, schema)
