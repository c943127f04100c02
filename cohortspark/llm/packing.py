"""Filling containers of fixed capacity with texts (problem 8): bin completion with branch and bound.

Texts of equal size are interchangeable, so what is packed is the histogram of sizes, which has no more rows
than the capacity has tokens, however many texts there are. A solution is a list of fillings, each used a
number of times. The search takes the largest item left, enumerates the fillings around it that no other one dominates,
by waste, and branches over them; a branch ends where the waste so far, or a lower bound for the rest, leaves no solution
better than the incumbent. Best fit gives the first incumbent, completing each container as fully as can be the second.
Every plan says how many containers it uses and how few there could be. Texts are then dealt to the places of
their size by rank.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import Stage

#: ``[(sizes of a filling, how often it is used)]``
Fillings = list[tuple[list[int], int]]

#: Steps of the search for one filling of the first solution, and of the search for a better one; what a search that ends by them
#: leaves open is reported as the gap to the bound.
NODE_LIMIT, SEARCH_LIMIT = 3000, 20_000
#: Parts into which texts of one size are cut to be ranked.
SALTS = 64


def byt5_tokens(text):
    """One token per UTF-8 byte plus the end token."""
    return F.octet_length(text) + 1


def complete(sizes: Sequence[int], counts: dict[int, int], room: int, limit: int = NODE_LIMIT) -> list[int]:
    """The fullest set of items for ``room``, as sizes in descending order.

    ``sizes``: ascending; ``counts``: how many of each are left. Depth first from the largest fitting item on, so that of
    fillings of equal waste one that isn't dominated (whose items no larger ones could replace) is met first. The best
    filling so far is the incumbent, found first by best fit. A branch ends when its least waste can't beat it.
    """
    best: list[int] = []
    best_sum, steps = -1, 0
    upto = [0]  # what all items of at most a size amount to
    for s in sizes:
        upto.append(upto[-1] + s * counts[s])
    stack: list[int] = []

    def walk(top: int, left: int, total: int) -> bool:
        """Add items of the sizes up to ``sizes[top]``. True: the search is over."""
        nonlocal best, best_sum, steps
        if total > best_sum:
            best, best_sum = stack.copy(), total
        if left == 0:
            return True
        steps += 1
        if steps > limit:
            return True
        for i in range(min(top, bisect_right(sizes, left) - 1), -1, -1):
            if total + min(left, upto[i + 1]) <= best_sum:
                return False
            s = sizes[i]
            for k in range(min(counts[s], left // s), 0, -1):
                stack.extend([s] * k)
                done = walk(i - 1, left - s * k, total + s * k)
                del stack[-k:]
                if done:
                    return True
        return False

    walk(len(sizes) - 1, room, 0)
    return best


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Fewest containers there could be: items above half a container need one each, and smaller ones at least what the room beside them lacks.

    The largest of these bounds over all sizes from which on items are counted.
    """
    sizes = sorted(s for s, n in histogram.items() if n > 0)
    if not sizes:
        return 0
    n = [histogram[s] for s in sizes]
    upto_n, upto_s = [0], [0]
    for s, k in zip(sizes, n):
        upto_n.append(upto_n[-1] + k)
        upto_s.append(upto_s[-1] + s * k)
    half = bisect_right(sizes, capacity // 2)
    best = -(-upto_s[-1] // capacity)
    for i in range(half + 1):  # items from sizes[i] on count; beside those above capacity - sizes[i] nothing fits
        least = sizes[i] if i < half else capacity // 2 + 1
        large = max(half, bisect_right(sizes, capacity - least))
        big, between = upto_n[-1] - upto_n[large], upto_n[large] - upto_n[half]
        room = between * capacity - (upto_s[large] - upto_s[half])
        best = max(best, big + between + max(0, -(-(upto_s[half] - upto_s[i] - room) // capacity)))
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> Fillings:
    """Items from the largest down, each into the fullest container that has room. Containers of equal contents are filled together."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []  # ascending
    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):  # new ones, each with as many as fit
                each = min(capacity // size, left)
                times = left // each
                filling = [size] * each
            else:
                filling, times = open_[rooms[at]].pop()
                if not open_[rooms[at]]:
                    del open_[rooms[at]]
                    rooms.pop(at)
                each = min((capacity - sum(filling)) // size, left)
                used = min(times, left // each)
                if used < times:
                    _keep(open_, rooms, capacity, filling, times - used)
                filling, times = [*filling, *[size] * each], used
            left -= each * times
            _keep(open_, rooms, capacity, filling, times)
    return [f for group in open_.values() for f in group]


def _keep(open_: dict, rooms: list[int], capacity: int, filling: list[int], times: int) -> None:
    room = capacity - sum(filling)
    if room not in open_:
        open_[room] = []
        insort(rooms, room)
    open_[room].append((filling, times))


def complete_each(histogram: dict[int, int], capacity: int, limit: int = NODE_LIMIT) -> Fillings:
    """Each container is filled as fully as can be around the largest item left, and used as often as its items last."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(counts)
    out: Fillings = []
    while sizes:
        largest = sizes[-1]
        counts[largest] -= 1
        open_ = [s for s in sizes if counts[s] > 0 and s <= capacity - largest] if sizes[0] <= capacity - largest else []
        filling = [largest, *(complete(open_, counts, capacity - largest, limit) if open_ else [])]
        counts[largest] += 1
        need = Counter(filling)
        times = min(counts[s] // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
                sizes.pop(bisect_left(sizes, s))
        out.append((filling, times))
    return out


def undominated(counts: dict[int, int], room: int, most_waste: int, steps: list[int]) -> Iterator[tuple[list[int], int]]:
    """``(sizes, waste)``: the ways to fill ``room`` from ``counts`` that waste at most ``most_waste`` and that no other way dominates.

    A way is dominated if an item that is left could be added, could take the place of a smaller one in it, or of two that are
    together no larger: whatever is packed after it can be packed after the other one too. ``steps[0]`` falls by one with each step; at 0 the enumeration ends.
    """
    sizes = sorted((s for s, n in counts.items() if n > 0 and s <= room), reverse=True)
    below = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        below[i] = below[i + 1] + sizes[i] * counts[sizes[i]]
    chosen: list[int] = []

    def free() -> list[int]:
        used = Counter(chosen)
        return [s for s in sizes if counts[s] > used[s]]

    def dominated(waste: int) -> bool:
        spare = free()
        if spare and spare[-1] <= waste:
            return True
        sums = {a for a in set(chosen)} if waste else set()
        sums |= {chosen[i] + chosen[k] for i in range(len(chosen)) for k in range(i)}
        singles = set(chosen)
        for s in spare:
            for a in sums:
                if s - waste <= a <= s and not (a in singles and a == s):
                    return True
        return False

    def walk(i: int, left: int) -> Iterator[tuple[list[int], int]]:
        steps[0] -= 1
        if steps[0] < 0 or left - min(left, below[i]) > most_waste:
            return
        if i == len(sizes) or left < sizes[-1]:
            if left <= most_waste and not dominated(left):
                yield chosen.copy(), left
            return
        s = sizes[i]
        for k in range(min(counts[s], left // s), -1, -1):
            chosen.extend([s] * k)
            yield from walk(i + 1, left - k * s)
            if k:
                del chosen[-k:]

    yield from walk(0, room)


def pack(histogram: dict[int, int], capacity: int, limit: int = NODE_LIMIT, search: int = SEARCH_LIMIT) -> tuple[Fillings, int]:
    """The best solution found for items of at most ``capacity``, and the fewest containers there could be.

    If both agree, or the search ended by itself, which sets the bound to what was found, the solution is optimal.
    """
    bound = lower_bound(histogram, capacity)
    total = sum(s * n for s, n in histogram.items())
    number = lambda fillings: sum(times for _, times in fillings)
    best = min((best_fit(histogram, capacity), complete_each(histogram, capacity, limit)), key=number)
    fewest, steps = number(best), [search]
    counts, path = {s: n for s, n in histogram.items() if n > 0}, []

    # a frame: fillings still to be tried, the one that is in use with its number, containers and waste before it
    def frame(used: int, waste: int) -> list:
        largest = max(counts)
        counts[largest] -= 1
        allowed = (fewest - 1) * capacity - total - waste
        ways = sorted(undominated(counts, capacity - largest, allowed, steps), key=lambda w: w[1]) if allowed >= 0 and used + 1 < fewest else []
        counts[largest] += 1
        moves = []
        for sizes, lost in ways:
            need = Counter([largest, *sizes])
            most = min(counts[s] // n for s, n in need.items())
            moves += [(need, times, lost) for times in ((most, 1) if most > 1 else (1,))]
        return [iter(moves), None, used, waste]

    def put(need: Counter, times: int, sign: int) -> None:
        for s, n in need.items():
            counts[s] = counts.get(s, 0) + sign * n * times
            if not counts[s]:
                del counts[s]

    stack = [frame(0, 0)] if counts and fewest > bound else []
    while stack and steps[0] > 0 and fewest > bound:
        top = stack[-1]
        if top[1]:
            put(*top[1], 1)
            path.pop()
            top[1] = None
        move = next(top[0], None)
        if move is None:
            stack.pop()
            continue
        need, times, lost = move
        used, waste = top[2] + times, top[3] + lost * times
        if used >= fewest or waste > (fewest - 1) * capacity - total:
            continue
        put(need, times, -1)
        top[1] = (need, times)
        path.append((sorted(need.elements(), reverse=True), times))
        if not counts:
            best, fewest = path.copy(), used
        elif used + lower_bound(counts, capacity) < fewest:
            stack.append(frame(used, waste))
    return best, bound if stack and steps[0] <= 0 else fewest if steps[0] > 0 else bound


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each target's histogram: segments of places, by size and the rank at which each begins; and a row of size 0 with the containers used and the bound."""
    held = [b for b in batches if len(b)]
    for (target, capacity), rows in pd.concat(held).groupby(["target_id", "capacity"]) if held else ():
        out, rank, container = [], {}, 0
        fillings, bound = pack(dict(zip(rows["size"].astype(int), rows["n"].astype(int))), int(capacity))
        for filling, times in fillings:
            at, i = 0, 0
            while i < len(filling):
                size, k = filling[i], filling.count(filling[i])
                begin = rank.get(size, 0)
                out.append((target, size, begin, begin + k * times, container, k, i, at))
                rank[size] = begin + k * times
                i, at = i + k, at + k * size
            container += times
        out.append((target, 0, container, bound, 0, 0, 0, 0))
        yield pd.DataFrame(out, columns=["target_id", "size", "begin", "end", "container", "each", "position", "offset"])


class Packing:
    """Texts in containers of each target's capacity.

    ``texts``: ``doc`` and ``size`` in tokens; ``targets``: ``target`` and ``capacity``. A text of more than the capacity is cut into pieces
    of the full capacity, each a container by itself, and a rest that is packed like a text; no other text is cut.
    Texts of null size and targets of null or no capacity are left out; a row with a size but without a doc is packed; repeated rows are packed as often as they
    come. Every place is given out once, whatever the order of the rows. Empty tables give no rows.
    """

    def __init__(self, texts: DataFrame, targets: DataFrame, doc: str = "doc_id", size: str = "size", target: str = "target_id", capacity: str = "capacity"):
        goals = targets.select(F.col(target).alias("target_id"), F.col(capacity).cast("int").alias("capacity")).filter("capacity > 0").distinct()
        rows = texts.select(F.col(doc).alias("doc_id"), F.col(size).cast("long").alias("tokens")).filter("tokens > 0")
        # every text is wanted once in every target: each part of the texts meets its own copy of the targets, however many there are
        order = F.xxhash64("doc_id", "tokens")
        copies = goals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cut = rows.withColumns({"ord": order, "salt": F.pmod(F.shiftrightunsigned(order, 5), F.lit(SALTS)).cast("int")}).join(copies, "salt")
        full = F.floor((F.col("tokens") - 1) / F.col("capacity"))
        self._salted = cut.withColumns({"full": full, "size": (F.col("tokens") - full * F.col("capacity")).cast("int")})
        self._histogram = Stage(self._salted.groupBy("target_id", "capacity", "size", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "histogram").df
        totals = self._histogram.groupBy("target_id", "capacity", "size").agg(F.sum("n").alias("n"))
        # a number of partitions that is named isn't merged: targets are planned side by side
        planned = totals.repartition(32, "target_id").mapInPandas(_plan, "target_id long, size int, begin long, end long, container long, each long, position int, offset int")
        self._plan = Stage(planned, "plan").df

    def report(self) -> DataFrame:
        """``(target_id, n_containers, least_containers)``: containers used and the fewest there could be, those of cut texts included."""
        whole = self._histogram.groupBy("target_id").agg(F.sum("full").alias("full"))
        packed = self._plan.filter("size = 0").select("target_id", F.col("begin").alias("used"), F.col("end").alias("bound"))
        return packed.join(whole, "target_id").select("target_id", (F.col("used") + F.col("full")).alias("n_containers"), (F.col("bound") + F.col("full")).alias("least_containers"))

    def containers(self) -> DataFrame:
        """``(target_id, doc_id, capacity, piece, piece_start, piece_tokens, container_id, position, token_offset)``.

        ``position`` counts the pieces of a container from 0, ``token_offset`` is where the piece begins in it.
        """
        off = F.sum("n").over(W.partitionBy("target_id", "size").orderBy("salt")) - F.col("n")
        parts = self._histogram.select("target_id", "size", "salt", "n", off.alias("off"))
        segments = self._plan.filter("size > 0").groupBy("target_id", "size").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "container", "each", "position", "offset"))).alias("segments"))
        # each part of a size gets those of its segments that hold ranks of the part; hot sizes meet them in as many tasks as they have parts
        own = F.filter("segments", lambda s: (s["begin"] < F.col("off") + F.col("n")) & (s["end"] > F.col("off")))
        offered = parts.join(segments, ["target_id", "size"]).select("target_id", "size", "salt", "off", own.alias("segments"))
        rank = F.row_number().over(W.partitionBy("target_id", "size", "salt").orderBy("ord", "doc_id")) - 1
        met = self._salted.withColumn("in_salt", rank).join(offered, ["target_id", "size", "salt"]).withColumn("rank", F.col("in_salt") + F.col("off"))
        met = met.withColumn("s", F.filter("segments", lambda s: (s["begin"] <= F.col("rank")) & (F.col("rank") < s["end"]))[0])
        k = F.col("rank") - F.col("s.begin")
        tail = F.struct(
            F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("capacity")).alias("piece_start"), F.col("size").alias("piece_tokens"),
            F.concat(F.lit("m"), F.col("s.container") + F.floor(k / F.col("s.each"))).alias("container_id"),
            (F.col("s.position") + k % F.col("s.each")).cast("int").alias("position"), (F.col("s.offset") + (k % F.col("s.each")) * F.col("size")).cast("int").alias("token_offset"),
        )
        head = F.transform(
            F.when(F.col("full") > 0, F.sequence(F.lit(0), F.col("full").cast("int") - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(
                i.alias("piece"), (i * F.col("capacity")).cast("bigint").alias("piece_start"), F.col("capacity").alias("piece_tokens"),
                F.concat(F.lit("w"), F.col("size").cast("string"), F.lit("-"), F.col("rank").cast("string"), F.lit("-"), i.cast("string")).alias("container_id"),
                F.lit(0).alias("position"), F.lit(0).alias("token_offset"),
            ),
        )
        return met.select("target_id", "doc_id", "capacity", F.inline(F.concat(head, F.array(tail))))


def cut_texts(packed: DataFrame) -> DataFrame:
    """``(target_id, doc_id)`` of the texts that were cut."""
    return packed.filter("piece > 0").select("target_id", "doc_id").distinct()
