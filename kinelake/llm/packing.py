"""Documents in containers of fixed capacity, by swap-based local search.

An item longer than the capacity is cut into full containers and a rest; no
other item is split. Items are spread over shards by a hash of their key, so
that a shard holds about ``shard_items`` of them whatever the table's size.
Each shard starts from a best fit in falling size; then documents move or are
exchanged one for one and two for one between its underfull containers
whenever that raises the sum of squared fills, until containers empty. The
items of containers that stay underfull meet again in fewer shards.

Defined results: items of size 0 (null and empty texts) take no room and lie at
the start of a container of their shard; null and negative sizes count as 0; a
key that comes twice is two items only if ``once`` is off; empty tables give no
rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.session import written

OUT = "piece long, n long, container string"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item in falling size goes where it leaves least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted rooms that some bin has
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            bins[b].append(int(i))
        else:
            room, b = capacity, len(bins)
            bins.append([int(i)])
        left = room - n
        if left not in by_room:
            by_room[left] = []
            bisect.insort(rooms, left)
        by_room[left].append(b)
    return bins


def _sums(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sums of two items of a bin, rising, and an example of each: places in ``sizes`` (sorted, rising).

    A bin holds few distinct sizes (their sum is at most its capacity), so all
    pairs of these are tried; a size that comes twice pairs with itself.
    """
    value, first, n = np.unique(sizes, return_index=True, return_counts=True)
    i, j = np.triu_indices(len(value))
    real = (i != j) | (n[i] > 1)
    i, j = i[real], j[real]
    total, at = np.unique(value[i] + value[j], return_index=True)
    return total, first[i[at]], first[j[at]] + (i[at] == j[at])


class Offers:
    """What open bins can give: single items and pairs of items of a bin, by size over all bins."""

    def __init__(self, bins: dict[int, np.ndarray], sizes: np.ndarray):
        ones, twos = [], []
        for k, items in bins.items():
            have = sizes[items]
            value, first = np.unique(have, return_index=True)
            ones.append((value, np.full(len(value), k), items[first], np.full(len(value), -1)))
            total, i, j = _sums(have)
            twos.append((total, np.full(len(total), k), items[i], items[j]))
        self.tables = [self._sorted(x) for x in (ones, twos)]

    @staticmethod
    def _sorted(parts: list[tuple]) -> list[np.ndarray]:
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
        order = np.argsort(columns[0], kind="stable")
        return [c[order] for c in columns]

    def without(self, closed: np.ndarray) -> None:
        """Take out the offers of closed bins (a mask over bins)."""
        for n, (size, bin_, i, j) in enumerate(self.tables):
            keep = ~closed[bin_]
            self.tables[n] = [size[keep], bin_[keep], i[keep], j[keep]]

    def best(self, own: np.ndarray, items: np.ndarray, room: int) -> tuple[int, int, list[int], list[int]] | None:
        """The exchange that moves most size, 1 to ``room``, into a bin with ``items`` of sizes ``own`` (rising): (size, from bin, given, taken)."""
        found: tuple[int, int, list[int], list[int]] | None = None
        value, first = np.unique(own, return_index=True)
        total, p, q = _sums(own)
        takes = {0: (np.zeros(1, np.int64), None, None), 1: (value, first, None), 2: (total, p, q)}
        for n_give, n_take in ((1, 0), (1, 1), (2, 1), (1, 2)):
            size, bin_, i, j = self.tables[n_give - 1]
            take, x, y = takes[n_take]
            if not len(size) or not len(take):
                continue
            at = np.searchsorted(size, take + room, "right") - 1
            gain = np.where(at >= 0, size[np.maximum(at, 0)] - take, 0)
            t = int(gain.argmax())
            if gain[t] >= 1 and (found is None or gain[t] > found[0]):
                g = int(at[t])
                given = [int(i[g])] + ([int(j[g])] if n_give == 2 else [])
                found = int(gain[t]), int(bin_[g]), given, [int(items[z[t]]) for z in (x, y) if z is not None]
                if found[0] == room:
                    break
        return found


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int, rounds: int | None = None) -> list[list[int]]:
    """Local search over underfull bins; every step raises the sum of squared fills.

    In each round every underfull bin, fullest first, takes from any emptier
    bin by the exchange that moves most, as long as it has room and one moves
    anything; a bin that gave is closed for the round. Rounds end when nothing
    moves, which comes as the sum of squares is bounded, or when there are no
    more bins than the sizes need at least, or after ``rounds`` if that is given.
    """
    fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
    need = -(-int(fill.sum()) // capacity)
    done = 0
    while (rounds is None or done < rounds) and int((fill > 0).sum()) > need:
        done += 1
        open_ = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: (-fill[k], k))
        items = {k: np.array(sorted(bins[k], key=lambda i: (sizes[i], i)), np.int64) for k in open_}
        offers, closed, changed = Offers(items, sizes), np.zeros(len(bins), bool), False
        for k in open_:
            if closed[k]:
                continue
            closed[k] = True
            offers.without(closed)
            while fill[k] < capacity:
                step = offers.best(sizes[items[k]], items[k], int(capacity - fill[k]))
                if step is None:
                    break
                size, j, given, taken = step
                for x, out, in_ in ((k, taken, given), (j, given, taken)):
                    left = np.concatenate([items[x][~np.isin(items[x], out)], np.array(in_, np.int64)])
                    items[x] = left[np.lexsort((left, sizes[left]))]
                fill[k] += size
                fill[j] -= size
                closed[j] = changed = True
                offers.without(closed)
        for k, x in items.items():
            bins[k] = x.tolist()
        if not changed:
            break
    return [b for b in bins if b]


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item; sizes are 0 to ``capacity``."""
    out = np.zeros(len(sizes), np.int64)
    real = np.flatnonzero(sizes > 0)
    bins = improve(best_fit(sizes[real], capacity), sizes[real], capacity) if len(real) else []
    for k, b in enumerate(bins):
        out[real[b]] = k
    return out


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", shard_items: int = 8000, once: bool = True, rounds: int = 2) -> DataFrame:
    """(key, piece, start, size, container) of all items, pieces of long ones in order.

    ``start`` is the place in the container. Tasks hold about ``shard_items``
    items; ``rounds`` times the items of underfull containers are packed anew.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    kind = dict(items.dtypes)[key]
    base = items.select(F.col(key), n.alias("_n"))
    if once:
        base = base.groupBy(key).agg(F.max("_n").alias("_n"))
    full = F.floor(F.col("_n") / capacity)
    whole = base.filter(full > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"), F.lit(capacity).cast("long").alias("n"))
    whole = whole.withColumn("container", F.concat(F.lit("full-"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("-"), F.col("piece").cast("string")))
    rest = base.withColumn("n", F.col("_n") - full * capacity).filter((F.col("n") > 0) | (F.col("_n") == 0)).select(key, full.alias("piece"), "n")
    total = max(1, rest.count())
    done = whole.withColumn("start", F.lit(0).cast("long"))
    schema = f"{key} {kind}, piece long, n long, container string, start long, room long"

    def one_shard(name: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([key, "piece"], kind="stable").reset_index(drop=True)
            sizes = pdf["n"].to_numpy(np.int64)
            bin_ = pack_sizes(sizes, capacity)
            order = np.lexsort((np.arange(len(sizes)), bin_))
            cum = np.cumsum(sizes[order]) - sizes[order]
            first = np.flatnonzero(np.diff(bin_[order], prepend=-1))
            start = np.empty(len(sizes), np.int64)
            start[order] = cum - np.repeat(cum[first], np.diff(np.append(first, len(sizes))))
            room = capacity - np.bincount(bin_, sizes, minlength=bin_.max() + 1).astype(np.int64)
            shard = int(pdf["_shard"].iloc[0])
            return pd.DataFrame({key: pdf[key], "piece": pdf["piece"], "n": sizes, "container": [f"{name}-{shard}-{b}" for b in bin_], "start": start, "room": room[bin_]})

        return run

    shards = max(1, -(-total // shard_items))
    for r in range(rounds):
        # as many tasks as shards: ids and sizes are few bytes and much work, which would else be joined into few tasks
        dealt = rest.withColumn("_shard", F.pmod(F.xxhash64(F.lit(r), key, "piece"), F.lit(shards))).repartition(shards, "_shard")
        placed = dealt.groupBy("_shard").applyInPandas(one_shard(f"r{r}"), schema)
        if r == rounds - 1 or shards == 1:
            return done.unionByName(placed.drop("room")).select(key, "piece", "start", F.col("n").alias(size), "container")
        # read again below: what is full stays, what is not is packed anew
        placed = written(placed)
        open_ = (F.col("room") > 0) & (F.col("n") > 0)
        done = done.unionByName(placed.filter(~open_).drop("room"))
        rest = placed.filter(open_).select(key, "piece", "n")
        shards = max(1, -(-rest.count() // shard_items))
    return done


def fill_report(packed: DataFrame, capacity: int, size: str = "n_tokens") -> DataFrame:
    """Containers, items and share of room used, over all rows."""
    by = packed.groupBy("container").agg(F.sum(size).alias("used"), F.count(F.lit(1)).alias("items"))
    return by.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("used"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"))
