"""Best-fit packing of documents into sequences of fixed capacity by bin completion.

The search works on the histogram of lengths, which never has more rows than the capacity has values, and yields
patterns (which lengths share a sequence) with multiplicities; pieces are then dealt to pattern slots by their rank
within their length. Ranks are counted in salted buckets, so a length that a third of all pieces have is no hot key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, staged
from .subwords import default_path, encoder
from .words import batch, pieces

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # times, ((length, count), ...)


def cut(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32: ids plus the end id, only longer ones cut."""

    def run(batches):
        enc = encoder(tokenizer)
        for b in pieces(batches):
            ids, off = enc.encode(b.column(1))
            rows: dict[str, list] = {"doc": [], "piece": [], "start": [], "length": [], "crc": []}
            for d in range(b.num_rows):
                own = np.append(ids[off[d] : off[d + 1]], end_id).astype("<u4")
                for p, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity]
                    for k, v in zip(rows, (d, p, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                        rows[k].append(v)
            yield batch(
                doc_id=b.column(0).take(pa.array(rows["doc"], pa.int64())),
                piece=pa.array(rows["piece"], pa.int32()),
                start=pa.array(rows["start"], pa.int64()),
                length=pa.array(rows["length"], pa.int64()),
                ids_crc32=pa.array(rows["crc"], pa.int64()),
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram, many equal bins at a time."""
    open_bins: dict[int, list[list]] = {}  # room left -> [times, {length: count}]
    rooms: list[int] = []
    done: list[tuple[int, dict[int, int]]] = []

    def put(room: int, times: int, filled: dict[int, int]) -> None:
        if not times:
            return
        if room == 0:
            done.append((times, filled))
            return
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room].append([times, filled])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, filled = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, filled = capacity, {}
                times = -(-left // (capacity // length))
            each = room // length
            whole = min(times, left // each)
            left -= whole * each
            put(room - each * length, whole, filled | {length: each})
            times -= whole
            if times and left and left < each:
                put(room - left * length, 1, filled | {length: left})
                times, left = times - 1, 0
            if filled:
                put(room, times, filled)
    for room, some in open_bins.items():
        done += [(times, filled) for times, filled in some]
    return [(t, tuple(sorted(f.items(), reverse=True))) for t, f in done]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The largest of the volume bound and Martello and Toth's second bound at every threshold: items over half the
    capacity have bins of their own, and the smaller ones not below the threshold fill the room that these leave."""
    n = np.zeros(capacity + 1, np.int64)
    for k, times in counts.items():
        n[k] += times
    size = np.arange(capacity + 1) * n
    half = capacity // 2
    best = -(-int(size.sum()) // capacity)
    upto, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size)])
    between = lambda a, lo, hi: a[hi + 1] - a[lo]  # noqa: E731  lengths lo to hi
    for small in range(half + 1):
        alone = between(upto, capacity - small + 1, capacity) if small else 0
        big = between(upto, half + 1, capacity - small)
        room = big * capacity - between(volume, half + 1, capacity - small)
        rest = between(volume, small, half)
        best = max(best, int(alone + big + max(0, -(-(rest - room) // capacity))))
    return best


def exact_few(free: np.ndarray, room: int, most: int = 8) -> list[tuple[int, ...]]:
    """Some ways to fill the room exactly with up to three free lengths: quick to find, and tried first."""
    if room <= 0:
        return []
    fits = np.flatnonzero(free[: room + 1])
    if not len(fits):
        return []
    top = int(fits[-1])
    found: dict[tuple[int, ...], int] = {(top,): room - top}

    def pairs(space: int, taken: tuple[int, ...]) -> None:
        x = fits[fits < space]
        if not len(x):
            return
        y = space - x
        ok = (free[y] > 0) & (x >= y)
        for a in x[ok][::-1][:3].tolist():
            add((*taken, a, space - a))
        for a in x[::-1][:4].tolist():
            k = int(np.searchsorted(fits, min(a, space - a), side="right")) - 1
            if k >= 0:
                add((*taken, a, int(fits[k])))

    def add(some: tuple[int, ...]) -> None:
        some = tuple(sorted(some, reverse=True))
        if top < sum(some) <= room and all(some.count(v) <= free[v] for v in set(some)):
            found[some] = room - sum(some)

    if top < room:
        pairs(room, ())
        if min(found.values()):
            for a in fits[::-1][:6].tolist():
                pairs(room - a, (a,))
    return [f for f, waste in sorted(found.items(), key=lambda x: (len(x[0]), [-v for v in x[0]])) if not waste][:most]


def fillings(free: np.ndarray, room: int, most: int):
    """All undominated ways to fill the room with any number of free lengths, least waste first, none above `most`.

    Yields None for a dominated way: one whose waste lets a length that stays free replace some of its pieces (or none)
    and hold no less, so that the other way round is no worse (Martello and Toth).
    """
    lengths = np.flatnonzero(free[: room + 1]).tolist() if room > 0 else []
    if not lengths:
        yield ()
        return
    # sums[k]: bit s tells whether the k smallest free lengths can sum to s
    mask, sums = (1 << (room + 1)) - 1, [1]
    for v in lengths:
        x, times, most_of = sums[-1], 1, min(int(free[v]), room // v) + 1
        while times < most_of:
            more = min(times, most_of - times)
            x |= (x << more * v) & mask
            times += more
        sums.append(x)
    unused = 0
    for v in lengths:
        unused |= 1 << v

    def exactly(total: int, k: int):
        """Every way to make the total of the k smallest lengths; larger ones first."""
        if not total:
            yield ()
            return
        while k and not total >= lengths[k - 1]:
            k -= 1
        for j in range(k, 0, -1):
            v = lengths[j - 1]
            if not sums[j] >> total & 1:
                return  # nor can fewer lengths
            for n in range(min(int(free[v]), total // v), 0, -1):
                if sums[j - 1] >> (total - n * v) & 1:
                    for rest in exactly(total - n * v, j - 1):
                        yield ((v,) * n) + rest

    def dominated(way: tuple[int, ...], waste: int) -> bool:
        left, several, one = unused, 0, 1
        for v in set(way):
            if free[v] == way.count(v):
                left &= ~(1 << v)
        for v in way:
            several |= (several << v) | ((one & ~1) << v)
            one |= 1 << v
        reached = several | one
        return bool(several & left) or any((reached << d) & left for d in range(1, waste + 1))

    for waste in range(min(room - lengths[-1], most) + 1):
        if sums[-1] >> (room - waste) & 1:
            for way in exactly(room - waste, len(lengths)):
                yield None if dominated(way, waste) else way


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> list[Pattern]:
    """Patterns that pack every length as often as counted, in as few bins as the search finds.

    Depth-first over all undominated fillings around the largest length left, as often as possible first and fewer times
    later; a branch ends when its waste could no longer beat the incumbent, which starts as the best-fit packing. Ends at
    the lower bound or after `nodes` steps, dominated fillings included.
    """
    counts = {k: n for k, n in counts.items() if n}
    best = best_fit(counts, capacity)
    size = sum(t for t, _ in best)
    low = lower_bound(counts, capacity)
    if size <= low:
        return best
    total = sum(k * n for k, n in counts.items())
    free = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        free[k] = n

    def choices(waste: int):
        largest = int(np.flatnonzero(free)[-1])

        def ways():
            quick = exact_few(alone, capacity - largest)
            yield from quick
            for way in fillings(alone, capacity - largest, (size - 1) * capacity - total - waste):
                if way is None or way not in quick:
                    yield way

        alone = free.copy()
        alone[largest] -= 1
        tried = []
        for way in ways():
            if way is None:
                yield None
                continue
            need: dict[int, int] = {largest: 1}
            for v in way:
                need[v] = need.get(v, 0) + 1
            lost = capacity - sum(k * n for k, n in need.items())
            times = fit_times(need, lost, waste)
            if times > 0:
                tried.append((need, times, lost))
                yield need, times, lost
        for need, times, lost in tried:
            for t in range(min(times, fit_times(need, lost, waste) + 1) - 1, 0, -1):
                yield need, t, lost

    def fit_times(need: dict[int, int], lost: int, waste: int) -> int:
        times = min(int(free[k]) // n for k, n in need.items())
        return min(times, ((size - 1) * capacity - total - waste) // lost) if lost else times

    path: list[tuple[dict[int, int], int, int]] = []
    waste, steps = 0, 0
    stack = [choices(0)]
    while stack and steps < nodes:
        steps += 1
        step = next(stack[-1], False)
        if step is False:
            stack.pop()
            if path:
                need, times, lost = path.pop()
                waste -= lost * times
                for k, n in need.items():
                    free[k] += n * times
            continue
        if not step:
            continue
        need, times, lost = step
        path.append(step)
        waste += lost * times
        for k, n in need.items():
            free[k] -= n * times
        if free.any():
            stack.append(choices(waste))
            continue
        used = sum(t for _, t, _ in path)
        if used < size:
            best, size = [(t, tuple(sorted(n.items(), reverse=True))) for n, t, _ in path], used
            if size <= low:
                break
        path.pop()
        waste -= lost * times
        for k, n in need.items():
            free[k] += n * times
    return best


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Per length, which ranks go to which pattern: rows sorted by (length, first rank)."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for times, items in patterns:
        at = 0
        for length, n in items:
            rows.append((length, seen.get(length, 0), n, base, at))
            seen[length] = seen.get(length, 0) + n * times
            at += length * n
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "base", "at"), table.T, strict=True))


def pack(items: DataFrame, capacity: int = 2048, nodes: int = 20_000) -> DataFrame:
    """Add sequence_id, offset and gap to rows with a `length` column of 1 to capacity.

    gap is the same in every row: the sequences used above the lower bound, 0 where the packing is proven to be best.
    items must be a staged table or otherwise give the same rows each time it is read. Every row gets a place;
    equal rows get places of their own; an empty table stays empty. Other columns pass through untouched.
    """
    hist = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 1 <= k <= capacity for k in hist):
        raise ValueError("length must be between 1 and the capacity")
    patterns = bin_completion(hist, capacity, nodes)
    gap = sum(t for t, _ in patterns) - lower_bound(hist, capacity)
    plan = slots(patterns)
    columns = items.columns
    salts = max(256, sum(hist.values()) // 50_000)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(salts)))
    per = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = per.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*columns)) - 1
    ranked = salted.withColumn("_inside", inside).join(before, ["length", "_salt"]).select(*columns, (F.col("_before") + F.col("_inside")).alias("_rank"))
    where = columns.index("length")
    start = plan["length"] << 44 | plan["rank"]

    def run(batches):
        for b in batches:
            length, rank = (b.column(k).to_numpy().astype(np.int64) for k in (where, len(columns)))
            row = np.searchsorted(start, length << 44 | rank, side="right") - 1
            k = rank - plan["rank"][row]
            each = plan["each"][row]
            yield batch(**{c: b.column(i) for i, c in enumerate(columns)}, sequence_id=plan["base"][row] + k // each, offset=plan["at"][row] + k % each * length)

    places = ranked.mapInArrow(run, items.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema)
    return places.withColumn("gap", F.lit(gap).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap.

    Null and empty texts are the end id alone; rows that repeat are packed as often as they occur; null doc_ids pass
    through; other columns are ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    return pack(staged(cut(docs, tokenizer or default_path(), capacity, end_id), "pieces"), capacity)
