"""Removing long repeated byte strings with sparse enhanced suffix arrays.

Suffixes are sampled where a window's least hash stands (winnowing), so any two
equal windows share a sampled suffix at the same place.  Windows are all strings of
400 bytes and, where passages are asked for, all runs of so many whole words that
have fewer bytes than that.  Suffixes that start with the same seed are sorted; a
stack scan over their common-prefix lengths walks the interval tree, and the text to
the left of each interval's members decides which of them are one maximal repeat.

Of a seed with more than ``HOT`` suffixes, those in equal surroundings are first
counted as one.  If more than ``HOT`` different ones are left, they are split by
longer common parts: each part of the windows around a suffix has a core that all
of its windows hold, and only suffixes that share a core stay together.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_table
from . import common, textnum

LENGTH = 400
#: Bytes that members of a group start with; with passages, no more than the shortest passage has.
SEED = 96
#: Words of the passages that ``query`` counts: over 50.
PASSAGE_WORDS = 51
#: Suffixes of one seed that a task sorts.
HOT = 5_000
#: Parts that the windows of a hot seed are split into each time.
FAN = 7
#: Bytes of text in one bucket of the stored table of distinct texts, about.
BUCKET_BYTES = 8_000_000
#: Bytes of one text that are sampled at once.
PIECE_BYTES = 2_000_000
#: Low bits of a sorting key that hold a position; a text has fewer bytes than this allows.
PLACE = 32


def seed_bytes(words: int | None) -> int:
    return min(SEED, 2 * words - 1) if words else SEED


def least_places(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least key in each range, both ends included: answers from running minima over powers of two."""
    out = np.empty(len(first), key.dtype)
    level = np.frexp(last - first + 1)[1] - 1
    order = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    for k in range(len(ends) - 1):
        at = order[ends[k] : ends[k + 1]]
        if len(at):
            out[at] = np.minimum(key[first[at]], key[last[at] - (1 << k) + 1])
        if k + 2 < len(ends):
            key = np.minimum(key[: -(1 << k)], key[1 << k :])
    return out


def _ties(text: np.ndarray, hashes: np.ndarray, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For windows of one text whose least hash stands in two places or more: (place to sample, period, whether no sample is needed).

    Such text is often periodic.  A window that lies in the periodic stretch from its
    start on samples the last of the equal places, any other one the first, so that
    all that reach over one end of the stretch agree.  A window that equals the one a
    period earlier needs no sample: the earlier one has it, and both are repeats.
    """
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    following = np.zeros(len(hashes), np.int64)
    following[order[same]] = order[same + 1]
    period = following[left] - left
    pick, again = left.copy(), np.zeros(len(a), bool)
    for d in np.unique(period):
        at = np.flatnonzero(period == d)
        equal = text[:-d] == text[d:]
        place = np.arange(len(equal))
        broken = np.maximum.accumulate(np.where(equal, -1, place))
        breaks = np.minimum.accumulate(np.where(equal, len(equal), place)[::-1])[::-1]
        q = left[at]
        start = np.where(q > 0, broken[q - 1] + 1, 0)  # the stretch of that period around q
        end = np.where(q < len(equal), breaks[np.minimum(q, len(equal) - 1)], q) + d
        pick[at] = np.where(a[at] >= start, right[at], q)
        # whole words need equal neighbours too
        again[at] = (a[at] - d - kind[at] >= start) & (b[at] + kind[at] <= end)
    return pick, period, again


def runs(first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that ranges cover."""
    if not len(first):
        return first, past
    order = np.argsort(first, kind="stable")
    first, past = first[order], np.maximum.accumulate(past[order])
    new = np.flatnonzero(np.append(True, first[1:] > past[:-1]))
    return first[new], past[np.append(new[1:], len(first)) - 1]


def seeds(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, words: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash) of sampled suffixes, and rows (first, past, kind) of stretches that repeat themselves.

    In each window of a text it is the place with the least seed hash.  Windows are
    ``length`` bytes (kind 0) or ``words`` whole words with fewer bytes (kind 1).
    """
    seed, size = seed_bytes(words), np.diff(offsets)
    many = np.maximum(size - length + 1, 0)
    a = np.repeat(offsets[:-1] - np.cumsum(many) + many, many) + np.arange(many.sum())
    b, kind = a + length, np.zeros(len(a), np.int64)
    if words:
        start, end, row = textnum.words(data, offsets, textnum.SPACE)
        n = max(len(start) - words + 1, 0)
        good = np.flatnonzero((row[:n] == row[len(row) - n :]) & (end[len(end) - n :] - start[:n] < length))
        a, b, kind = np.append(a, start[good]), np.append(b, end[good + words - 1]), np.append(kind, np.ones(len(good), np.int64))
    none = np.zeros((0, 3), np.int64)
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), none
    up, down = textnum.powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(textnum._LETTERS[data] * up[: len(data)], out=total[1:])
    hashes = textnum.mix((total[seed:] - total[:-seed]) * down[: len(data) - seed + 1])
    del total
    high, low = (hashes >> np.uint64(PLACE)).astype(np.uint32), np.uint64((1 << PLACE) - 1)
    place = np.arange(len(hashes), dtype=np.uint64)
    left = (least_places((hashes & ~low) | place, a, b - seed) & low).astype(np.int64)
    # the few places whose hash comes again within reach: there the last such place is looked for too
    near, reach = np.unique(left), length - seed
    ahead = np.lib.stride_tricks.sliding_window_view(np.append(high, np.zeros(reach, np.uint32)), reach)
    close = [near[k : k + 2048][(ahead[near[k : k + 2048] + 1] == high[near[k : k + 2048], None]).any(axis=1)] for k in range(0, len(near), 2048)]
    found, picked, needed = [none], left.copy(), np.ones(len(a), bool)
    if len(close := np.concatenate(close)):
        owner = np.searchsorted(offsets, a, side="right") - 1
        odd = np.zeros(len(size), bool)
        odd[np.searchsorted(offsets, close, side="right") - 1] = True
        at = np.flatnonzero(odd[owner])
        right = (low - (least_places((hashes & ~low) | (low - place), a[at], b[at] - seed) & low)).astype(np.int64)
        at, right = at[right > left[at]], right[right > left[at]]
        order = np.argsort(owner[at], kind="stable")
        at, right = at[order], right[order]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(owner[at])) + 1) if len(at) else ():
            w = at[part]
            o, past = offsets[owner[w[0]]], offsets[owner[w[0]] + 1]
            pick, period, again = _ties(data[o:past], high[o : past - seed + 1], a[w] - o, b[w] - o, left[w] - o, right[part] - o, kind[w])
            picked[w], needed[w] = pick + o, ~again
            for k in (0, 1):
                own = again & (kind[w] == k)
                first, stop = runs(a[w[own]] - period[own], b[w[own]])
                found.append(np.stack([first, stop, np.full(len(first), k)], axis=1))
    chosen = np.unique(picked[needed])
    return chosen, hashes[chosen], np.concatenate(found)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row per distinct text, stored in buckets by ``key`` so that later joins leave texts where they are.

    Columns: ``key`` (a digest of the first row's id and text digest), ``digest``, ``text``
    (binary) and ``copies``.  Copies are counted before any text is moved.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", common.text_bytes(F.col("text")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b" "), F.col("digest"))))
    counted = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max(F.octet_length("text")).alias("size"))
    counted = common.materialise(counted.withColumn("key", key), "text-digests")
    buckets = max(spark.sparkContext.defaultParallelism, 8)
    buckets = max(buckets, (counted.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES)
    rows = rows.select(key.alias("key"), "text").repartition(int(buckets), "key")
    kept = rows.join(counted.select("key", "digest", "copies").hint("merge"), "key").dropDuplicates(["key"])
    # buckets need a table's name, but its files go to the shared folder: a warehouse may be local to each machine
    name = f"distinct_texts_{uuid.uuid4().hex}"
    kept.write.bucketBy(int(buckets), "key").option("compression", "zstd").option("path", shared_table(spark, name)).format("parquet").saveAsTable(name)
    return spark.table(name)


def seeds_of_long(data: np.ndarray, words: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``seeds`` of one very long text, piece by piece: pieces overlap by more than a window and its neighbours."""
    parts = []
    for at in range(0, len(data), PIECE_BYTES):
        piece = data[at : at + PIECE_BYTES + LENGTH + 2]
        pos, hashes, own = seeds(piece, np.array([0, len(piece)]), LENGTH, words)
        parts.append((pos + at, hashes, own + np.array([at, at, 0])))
    pos, hashes, own = (np.concatenate(x) for x in zip(*parts, strict=True))
    pos, first = np.unique(pos, return_index=True)
    return pos, hashes[first], own


SAMPLED = "seed long, key binary, pos int, past int, kind int"


def sampled(texts: DataFrame, words: int | None = None) -> DataFrame:
    """Every sampled suffix (seed, key, pos), and, with a null seed, stretches of a text that repeat themselves (key, pos, past, kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in textnum.blocks(batches):
            long = rows.num_rows == 1 and len(data) > PIECE_BYTES
            pos, hashes, own = seeds_of_long(data, words) if long else seeds(data, offsets, LENGTH, words)
            place = np.append(pos, own[:, 0])
            row = np.searchsorted(offsets, place, side="right") - 1
            n, m = len(pos), len(own)
            columns = [
                pa.concat_arrays([pa.array(hashes.view(np.int64)), pa.nulls(m, pa.int64())]),
                rows.column("key").take(pa.array(row)),
                pa.array(place - offsets[row], pa.int32()),
                pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(own[:, 1] - offsets[row[n:]], pa.int32())]),
                pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(own[:, 2], pa.int32())]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SAMPLED.split(", ")])

    return texts.select("key", "text").mapInArrow(run, SAMPLED)


AROUND = "seed long, key binary, pos int, hot boolean, right binary, left binary, around binary, spots array<int>"


def contexts(texts: DataFrame, places: DataFrame, seed_size: int) -> DataFrame:
    """Add to (seed, key, pos, hot) the bytes from ``pos`` on and, reversed, those before it: all that a window around it can reach.

    ``around`` is a hash of both.  Suffixes of hot seeds in equal surroundings are
    one row of a text, with all their places in ``spots``, and a batch gives the
    bytes of equal surroundings once; elsewhere these are null.
    """
    listed = places.groupBy("key").agg(F.collect_list(F.struct("pos", "seed", "hot")).alias("at"))
    joined = listed.hint("merge").join(texts.select("key", "text"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for key, at, text in zip(batch.column("key"), batch.column("at"), batch.column("text"), strict=True):
                whole = text.as_py()
                rows: list[list] = []
                own: dict[bytes, list[int]] = {}
                for p, seed, hot in zip(*(c.to_pylist() for c in at.values.flatten()), strict=True):
                    right, left = whole[p : p + LENGTH], whole[max(0, p - (LENGTH - seed_size)) : p][::-1]
                    if not hot:
                        rows.append([seed, key.as_py(), p, hot, right, left, None, None])
                        continue
                    h = hashlib.blake2b(b"%d " % len(left) + left + right, digest_size=16).digest()
                    if h in own:
                        own[h].append(p)
                        continue
                    own[h] = [p]
                    known = h in seen
                    seen.add(h)
                    rows.append([seed, key.as_py(), p, hot, None if known else right, None if known else left, h, own[h]])
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in AROUND.split(", ")])

    return joined.select("key", "at", "text").mapInArrow(run, AROUND)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and their lengths."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    out = np.zeros((len(column), width), np.uint8)
    inside = np.arange(width) < size[:, None]
    out[inside] = data[offsets[0] : offsets[-1]]
    return out, size


def common_lengths(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Common prefix length of matching rows."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(sizes_a, sizes_b))


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of every common-prefix interval, inner before outer: a stack scan.

    ``lcp[i]`` is the common prefix of sorted suffixes ``i`` and ``i + 1``.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp.tolist(), 0]):
        first = i
        while stack and stack[-1][1] > value:
            first, length = stack.pop()
            yield first, i, length
        if value and (not stack or stack[-1][1] < value):
            stack.append((first, value))


def repeats(right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, np.ndarray]]:
    """Maximal repeats of ``length`` bytes or more among suffixes sorted by ``right``: (bytes left, bytes right, members).

    Members of an interval agree on the bytes to the right.  In order of the bytes
    to their left they fall into runs that agree on enough of those too; where the
    neighbours of a run differ (left diversity) it can't be extended, and is output
    with all its occurrences.
    """
    lcp = common_lengths(right[:-1], right[1:], right_size[:-1], right_size[1:])
    order = sorted(range(len(left)), key=lambda i: left[i, : left_size[i]].tobytes())
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    by_left = np.array(order)
    shared = common_lengths(left[by_left[:-1]], left[by_left[1:]], left_size[by_left[:-1]], left_size[by_left[1:]])
    for first, last, reach in intervals(lcp):
        need = length - reach
        members = first + np.argsort(rank[first : last + 1], kind="stable")
        ranks = rank[members]
        if len(members) == len(shared) + 1:
            between = shared
        else:  # least of the stretch between neighbouring members
            between = np.minimum.reduceat(shared, ranks[:-1])
            ends = ranks[1:] - 1
            simple = ranks[1:] - ranks[:-1] == 1
            between[simple] = shared[ends[simple]]
            if not simple[-1]:
                between[-1] = shared[ranks[-2] : ranks[-1]].min()
        yield from runs_of(between, members, need, reach)


def runs_of(between: np.ndarray, members: np.ndarray, need: int, reach: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of members whose left sides agree on ``need`` bytes, by how many they agree on: inner runs first."""
    if not len(between) or between.max() < need:
        return
    for a, b, agreed in intervals(np.where(between >= max(need, 0), between + 1, 0)):
        yield agreed - 1, reach, members[a : b + 1]


def _at_edge(rows: np.ndarray, size: np.ndarray, at: np.ndarray, reach: int | np.ndarray) -> np.ndarray:
    """Whether white space or the end of the text follows the first ``reach`` bytes of the rows ``at``."""
    return (size[at] == reach) | textnum.SPACE[rows[at, np.minimum(reach, rows.shape[1] - 1)]]


def group_cover(right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, words: int | None = None) -> np.ndarray:
    """Rows (suffix, bytes left, bytes right, kind) of how far repeats reach around the suffixes of one group.

    Kind 0 has ``LENGTH`` bytes; kind 1 has fewer and may hold ``words`` whole words: an
    end at which no other member has a word's end too is moved in by a byte.

    Near copies nest in as many repeats as they have differing places to either side,
    each with nearly all suffixes.  So occurrences aren't listed: a table of one cell
    for each suffix and number of bytes to the right keeps the most bytes to the left.
    """
    before, after = np.full(len(right), -1), np.full(len(right), -1)
    none = -2  # an end that is moved in may be at -1
    most = np.full((len(right) if words else 0, LENGTH), none, np.int16)
    for back, ahead, members in repeats(right, right_size, left, left_size, 2 * words - 1 if words else LENGTH):
        if back + ahead >= LENGTH:
            before[members] = np.maximum(before[members], back)
            after[members] = np.maximum(after[members], ahead)
            continue
        begins = _at_edge(left, left_size, members, back)
        ends = _at_edge(right, right_size, members, ahead)
        whole = begins & ends & ((begins & ends).sum() > 1)
        begins, ends = begins & (begins.sum() > 1), ends & (ends.sum() > 1)
        for on, b, a in ((whole, 0, 0), (begins & ~whole, 0, 1), (ends & ~whole, 1, 0), (~begins & ~ends, 1, 1)):
            m = members[on]
            most[m, ahead - a] = np.maximum(most[m, ahead - a], back - b)
    hit = np.flatnonzero(before >= 0)
    out = [np.stack([hit, before[hit], after[hit], np.zeros(len(hit), np.int64)], axis=1)]
    if words:
        # of a suffix's reaches, by bytes to the right, only those that reach further left than all longer ones
        longer = np.full_like(most, none)
        longer[:, :-1] = np.maximum.accumulate(most[:, :0:-1], axis=1)[:, ::-1]
        m, ahead = np.nonzero(most > longer)
        out.append(np.stack([m, most[m, ahead], ahead, np.ones(len(m), np.int64)], axis=1))
    return np.concatenate(out)


def sorted_cover(sorted_contexts: DataFrame, words: int | None = None) -> DataFrame:
    """Ranges (key, first, past, kind) around suffixes; rows come with a seed's suffixes together and sorted."""
    seed_size = seed_bytes(words)

    def settle(table: pa.RecordBatch) -> pa.RecordBatch:
        seed, pos = np.array(table.column("seed")), np.array(table.column("pos")).astype(np.int64)
        right, right_size = matrix(table.column("right"), LENGTH)
        left, left_size = matrix(table.column("left"), LENGTH - seed_size)
        heads = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
        size = np.diff(np.append(heads, len(seed)))
        two = heads[size == 2]  # most groups: no tree is needed
        back = common_lengths(left[two], left[two + 1], left_size[two], left_size[two + 1])
        ahead = common_lengths(right[two], right[two + 1], right_size[two], right_size[two + 1])
        long = back + ahead >= LENGTH
        found = []
        for shift in (0, 1):
            found.append(np.stack([two[long] + shift, back[long], ahead[long], np.zeros(long.sum(), np.int64)], axis=1))
        if words:
            may = ~long & (back + ahead >= 2 * words - 1)
            t, b, a = two[may], back[may], ahead[may]
            b = b - ~(_at_edge(left, left_size, t, b) & _at_edge(left, left_size, t + 1, b))
            a = a - ~(_at_edge(right, right_size, t, a) & _at_edge(right, right_size, t + 1, a))
            found += [np.stack([t + shift, b, a, np.ones(len(t), np.int64)], axis=1) for shift in (0, 1)]
        for h, n in zip(heads[size > 2], size[size > 2], strict=True):
            at = slice(h, h + n)
            found.append(group_cover(right[at], right_size[at], left[at], left_size[at], words) + np.array([h, 0, 0, 0]))
        row, back, ahead, kind = np.concatenate(found).T
        return pa.RecordBatch.from_arrays([table.column("key").take(pa.array(row)), pa.array(pos[row] - back, pa.int32()), pa.array(pos[row] + ahead, pa.int32()), pa.array(kind, pa.int32())], ["key", "first", "past", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last, perhaps unfinished, seed
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                seed = np.array(part.column("seed"))
                cut = len(seed) - int((seed[::-1] != seed[-1]).argmax()) if seed[0] != seed[-1] else 0
                if held and (cut or held[-1].column("seed")[-1].as_py() != seed[0]):
                    yield settle(pa.concat_batches([*held, part.slice(0, cut)]))
                    held = []
                elif cut:
                    yield settle(part.slice(0, cut))
                if cut < len(seed):
                    held.append(part.slice(cut))
        if held:
            yield settle(pa.concat_batches(held))

    return sorted_contexts.select("seed", "key", "pos", "right", "left").mapInArrow(run, "key binary, first int, past int, kind int")


def sorted_by_seed(rows: DataFrame, words: int | None = None) -> DataFrame:
    """A seed's suffixes meet in one task, in the order of their bytes."""
    return sorted_cover(rows.repartition("seed").sortWithinPartitions("seed", "right"), words)


def windows_around(left: bytes, right: bytes, kind: int, words: int | None) -> dict[int, tuple[int, int]]:
    """By number, the windows of one kind around a suffix: bytes to the left, bytes to the right.

    Numbers rise with the bytes to the left.  ``left`` is reversed.
    """
    seed = seed_bytes(words)
    if not kind:
        return {d: (d, LENGTH - d) for d in range(max(0, LENGTH - len(right)), min(LENGTH - seed, len(left)) + 1)}
    start, end, _ = textnum.words(np.frombuffer(left[::-1] + right, np.uint8), np.array([0, len(left) + len(right)]), textnum.SPACE)
    start, end = (start - len(left)).tolist(), (end - len(left)).tolist()
    if start and len(left) == LENGTH - seed and start[0] == -len(left):  # may begin further left
        start, end = start[1:], end[1:]
    if end and len(right) == LENGTH and end[-1] == len(right):
        start, end = start[:-1], end[:-1]
    own = sum(s < 0 for s in start)
    found = {own - i: (-start[i], end[i + words - 1]) for i in range(len(start) - words + 1)}
    return {j: (b, a) for j, (b, a) in found.items() if b >= 0 and a >= seed and a + b < LENGTH}


def split_hot(classes: DataFrame, hot: int, words: int | None = None) -> DataFrame:
    """The same ranges for seeds with more than ``hot`` different surroundings: (seed, around, left, right).

    The numbered windows around each suffix are dealt into parts.  Whatever shares one
    of a part's windows shares the part's core: the left bytes of its first window and
    the right bytes of its last.  Suffixes that are alone with a core drop out, up to
    ``hot`` of them are sorted as one group, and others are split again; a part of one
    window is a repeat itself.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for around, left, right, kind, low, high in zip(*(batch.column(c).to_pylist() for c in ("around", "left", "right", "kind", "low", "high")), strict=True):
                found = windows_around(left, right, kind, words)
                step = -(-(high - low + 1) // FAN)
                for a in range(low, high + 1, step):
                    z = min(a + step - 1, high)
                    inside = [w for j, w in found.items() if a <= j <= z]
                    if not inside:
                        continue
                    if kind:  # the core goes by words, whichever windows this suffix has
                        b, n = _word_core(left, right, a, max(0, words - z))
                    else:
                        b, n = a, LENGTH - z
                    core = hashlib.blake2b(b"%d %d %d %d " % (kind, a, z, b) + left[:b] + right[:n], digest_size=16).digest()
                    rows.append((core, around, kind, a, z, b, n))
            kinds = [pa.binary(), pa.binary(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["core", "around", "kind", "low", "high", "back", "ahead"])

    top = max(LENGTH, words or 0)
    kinds = F.array(*[F.lit(k) for k in ([0, 1] if words else [0])])
    nodes = classes.select("around", F.explode(kinds).alias("kind"), F.lit(0).alias("low"), F.lit(top).alias("high"))
    bytes_of = classes.select("around", "left", "right")
    out, schema = None, "core binary, around binary, kind int, low int, high int, back int, ahead int"
    while True:
        made = common.materialise(nodes.join(bytes_of, "around").mapInArrow(split, schema), "suffix-cores")
        sizes = common.materialise(made.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"), "core-sizes")
        made = common.materialise(made.join(sizes, "core"), "suffix-cores")
        few = made.filter(F.col("n") <= hot).join(bytes_of, "around")
        seed = F.conv(F.substring(F.hex("core"), 1, 15), 16, 10).cast("long").alias("seed")
        found = sorted_by_seed(few.select(seed, F.col("around").alias("key"), F.lit(0).alias("pos"), "left", "right"), words)
        found = found.unionByName(made.filter((F.col("n") > hot) & (F.col("low") == F.col("high"))).select(F.col("around").alias("key"), (-F.col("back")).alias("first"), F.col("ahead").alias("past"), "kind"))
        out = found if out is None else out.unionByName(found)
        nodes = made.filter((F.col("n") > hot) & (F.col("low") < F.col("high"))).select("around", "kind", "low", "high")
        if nodes.isEmpty():
            return out


def _word_core(left: bytes, right: bytes, n_left: int, n_right: int) -> tuple[int, int]:
    """Bytes to the left up to the start of the ``n_left``-th word that begins there, and to the right up to the end of the ``n_right``-th."""
    start, end, _ = textnum.words(np.frombuffer(left[::-1] + right, np.uint8), np.array([0, len(left) + len(right)]), textnum.SPACE)
    start, end = start - len(left), end - len(left)
    own = int((start < 0).sum())
    back = -int(start[own - n_left]) if n_left else 0
    last = own + n_right - 1
    return back, max(0, int(end[last])) if 0 <= last < len(end) else 0


def hot_cover(rows: DataFrame, hot: int, words: int | None = None) -> DataFrame:
    """Covered ranges around suffixes of hot seeds, one look for all in equal surroundings.

    Surroundings that occur twice are covered whole.  Counting combines before its
    shuffle, and only different surroundings of a seed are sorted together.
    """
    classes = rows.groupBy("seed", "around").agg(F.first("right", True).alias("right"), F.first("left", True).alias("left"), F.sum(F.size("spots")).alias("n"))
    classes = common.materialise(classes, "suffix-classes")
    many = common.materialise(classes.groupBy("seed").agg((F.count("*") > hot).alias("many")), "suffix-counts")
    classes = common.materialise(classes.join(many, "seed"), "suffix-classes")
    twice = classes.filter((F.col("n") > 1) & (F.octet_length("left") + F.octet_length("right") >= LENGTH))
    covers = twice.select(F.col("around").alias("key"), (-F.octet_length("left")).alias("first"), F.octet_length("right").alias("past"), F.lit(0).alias("kind"))
    few = classes.filter("not many").select("seed", F.col("around").alias("key"), F.lit(0).alias("pos"), "left", "right")
    covers = covers.unionByName(sorted_by_seed(few, words))
    if not many.filter("many").isEmpty():
        covers = covers.unionByName(split_hot(classes.filter("many"), hot, words))
    # what 400-byte strings cover around a suffix joins up at the suffix
    long = covers.filter("kind = 0").groupBy("key").agg(F.array(F.struct(F.min("first").alias("first"), F.max("past").alias("past"), F.lit(0).alias("kind"))).alias("reach"))
    short = covers.filter("kind = 1").groupBy("key").agg(F.collect_set(F.struct("first", "past", "kind")).alias("reach"))
    covers = common.materialise(long.unionByName(short), "suffix-reaches")
    spots = rows.select("key", "spots", "around").join(covers.withColumnRenamed("key", "around"), "around")
    spans = F.flatten(F.transform("spots", lambda p: F.transform("reach", lambda r: F.struct((p + r["first"]).cast("int").alias("first"), (p + r["past"]).cast("int").alias("past"), r["kind"].alias("kind")))))
    return spots.select("key", spans.alias("spans"))


def cover(texts: DataFrame, hot: int = HOT, words: int | None = None) -> DataFrame:
    """Byte ranges of distinct texts that repeat, overlapping and unsorted: (key, array of (first, past, kind)).

    Those of kind 1 need a count of their whole words still.
    """
    found = common.materialise(sampled(texts, words), "suffixes")
    suffixes = found.filter("seed is not null").select("seed", "key", "pos")
    often = common.materialise(suffixes.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed", (F.col("n") > hot).alias("hot")), "shared-seeds")
    around = contexts(texts, suffixes.join(often.hint("merge"), "seed"), seed_bytes(words))
    any_hot = not often.filter("hot").isEmpty()
    if any_hot:
        around = common.materialise(around, "suffix-contexts")
    span = F.array(F.struct("first", "past", "kind")).alias("spans")
    out = sorted_by_seed(around.filter("not hot"), words).select("key", span)
    out = out.unionByName(found.filter("seed is null").select("key", F.col("pos").alias("first"), "past", "kind").select("key", span))
    return out.unionByName(hot_cover(around.filter("hot"), hot, words)) if any_hot else out


CUT = "digest binary, n_bytes long, n_removed long, n_spans long, n_repeated long, n_passages long, kept binary"


def remove_repeats(docs: DataFrame, hot: int = HOT, words: int | None = None, strings_only: bool = False) -> DataFrame:
    """What is left of each distinct text: (digest, n_bytes, n_removed, n_spans, n_repeated, n_passages, kept).

    ``digest`` is the MD5 of the text's bytes; rows that share a text share a result.
    Bytes covered by a 400-byte string that occurs twice go.  With ``words``, repeats
    of so many whole words go too, however few their bytes, unless ``strings_only``:
    then they are counted only, in ``n_repeated`` (bytes) and ``n_passages`` (runs).

    A text with a copy elsewhere loses all its bytes if it has 400 (or enough words);
    null and empty texts lose none.  Matches never cross texts.  An empty table gives
    an empty result.  A very long text is sampled in overlapping pieces.  Other columns
    of ``docs``, whatever their names, aren't read.
    """
    texts = distinct_texts(docs)
    spans = cover(texts, hot, words).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = texts.select("key", "digest", "text", "copies").join(spans.hint("merge"), "key", "left")

    def cut(whole: bytes, copied: bool, spans: pa.Array) -> list:
        n = len(whole)
        first, past, kind = (np.array(c, np.int64) for c in spans.flatten()) if spans is not None else (np.zeros(0, np.int64),) * 3
        strings = runs(first[kind == 0], past[kind == 0])
        if copied and n >= LENGTH:
            strings = np.array([0]), np.array([n])
        every = strings
        if words and (copied or len(first)):
            start, end, _ = textnum.words(np.frombuffer(whole, np.uint8), np.array([0, n]), textnum.SPACE)
            a, b = np.searchsorted(start, first[kind == 1]), np.searchsorted(end, past[kind == 1], side="right") - 1
            some = b - a + 1 >= words
            every = runs(np.append(strings[0], start[a[some]]), np.append(strings[1], end[b[some]]))
            if copied and len(start) >= words:
                every = np.array([0]), np.array([n])
        gone = strings if strings_only else every
        edges = [0, *np.stack(gone, axis=1).ravel().tolist(), n]
        kept = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        return [n, n - len(kept), len(gone[0]), int((every[1] - every[0]).sum()), len(every[0]), kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [[d.as_py(), *cut(t.as_py(), c.as_py() > 1, s.values if s.is_valid else None)] for d, t, c, s in zip(*(part.column(c) for c in ("digest", "text", "copies", "spans")), strict=True)]
                kinds = [pa.binary(), *[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in CUT.split(", ")])

    return joined.select("digest", "text", "copies", "spans").mapInArrow(run, CUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps once repeated 400-byte strings are gone.

    ``n_passages`` and ``n_repeated`` say how many runs of repeated text, and bytes in
    them, there are if passages of over 50 whole words count too.
    """
    docs = common.table(spark, sf_dir, "documents")
    cut = remove_repeats(docs, words=PASSAGE_WORDS, strings_only=True).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    rows = docs.select("doc_id", F.unhex(F.md5(common.text_bytes(F.col("text")))).alias("digest"))
    out = rows.join(cut.hint("merge"), "digest")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_repeated")
