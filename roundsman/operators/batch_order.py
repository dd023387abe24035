"""Ordering of many small tours at once inside a task.

Spark brings the matrix rows of each tour together; this module turns a stretch of them
into padded arrays (tour, point, point) and advances all its tours in step.
Only tours of a checked size come here, see ``ordering``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows gathered before a stretch is solved, and array cells solved together (so many that the
#: arrays of a step stay in a core's cache).
_ROWS, _CELLS = 200_000, 50_000

#: Tours with more stops are improved one at a time, a row of reversals after the other; the
#: shorter ones together, with all reversals of a tour at once.
LONG = 256


def solve_partition(walk: bool, improve: bool, penalty_s: float, min_gain: float, min_movable: int, max_rounds: int | None):
    """Partition function for ``mapInArrow``; see ``ordering._small_tours`` for its rows."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        points = table.filter(pc.equal(table["i"], -1))
        if points.num_rows == 0:
            return
        links = table.filter(pc.not_equal(table["i"], -1))
        tours = points["tour_id"].unique()
        at = pc.index_in(points["tour_id"], tours).to_numpy()
        # rows come sorted by tour only
        by_number = np.lexsort((points["j"].to_numpy(), at))
        points, at = points.take(by_number), at[by_number]
        ids = points["j"].to_numpy().astype(np.int64, copy=False)
        sizes = np.bincount(at, minlength=len(tours))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # rank of a point inside its tour
        wide = max(int(ids.max()), int(pc.max(links["j"]).as_py() or 0), int(pc.max(links["i"]).as_py() or 0)) + 1
        keys = at * wide + ids

        def ranks(names: str, owner: np.ndarray) -> np.ndarray:
            found = np.minimum(np.searchsorted(keys, owner * wide + links[names].to_numpy()), len(keys) - 1)
            return np.where(keys[found] == owner * wide + links[names].to_numpy(), found - starts[owner], -1)

        owner = pc.index_in(links["tour_id"], tours)
        kept = pc.is_valid(owner)
        links, owner = links.filter(kept), owner.drop_null().to_numpy()
        a, b, secs = ranks("i", owner), ranks("j", owner), links["seconds"].to_numpy()
        known = (a >= 0) & (b >= 0)
        owner, a, b, secs = owner[known], a[known], b[known], secs[known]
        link_ends = np.searchsorted(owner, np.arange(len(tours) + 1))
        columns = {name: points[name].to_numpy(zero_copy_only=False) for name in ("pos", "avant12h", "locked")}

        by_size = np.argsort(sizes, kind="stable")
        first = 0
        while first < len(by_size):
            last = first
            while last < len(by_size) and (last - first + 1) * int(sizes[by_size[last]]) ** 2 <= _CELLS:
                last += 1
            part = by_size[first : max(last, first + 1)]
            first = max(last, first + 1)
            n = int(sizes[part].max())
            cost = np.full((len(part), n, n), np.inf)
            given = {name: np.zeros((len(part), n), dtype=v.dtype) for name, v in columns.items()}
            real = np.arange(n)[None, :] < sizes[part][:, None]
            t, at_link = _runs(link_ends[part], link_ends[part + 1] - link_ends[part])
            cost[t, a[at_link], b[at_link]] = secs[at_link]
            _, at_point = _runs(starts[part], sizes[part])
            for name, v in columns.items():
                given[name][real] = v[at_point]
            yield from _order(cost, real, given, tours.take(pa.array(part)), starts[part], ids)

    def _order(cost, real, given, tours, starts, ids):
        movable = real & ~given["locked"]
        movable[:, 0] = False  # the start
        if walk:
            pos = nearest(cost, movable, real & given["locked"])
        else:
            pos = given["pos"].astype(np.int64)
            pos[~real] = -1
        pos[:, 0] = -1
        lengths = (pos >= 0).sum(axis=1)
        # given positions may leave some out
        order = np.zeros((len(pos), max(int(lengths.max()), int(pos.max()) + 1, 1)), dtype=np.int64)
        t, p = np.nonzero(pos >= 0)
        order[t, pos[t, p]] = p
        if improve and order.shape[1] > LONG:
            for k in range(len(order)):
                limit = int(movable[k].sum())
                order[k, : lengths[k]] = improve_one(
                    cost[k], order[k, : lengths[k]], limit, given["avant12h"][k], penalty_s, min_gain, min_movable, max_rounds
                )
        elif improve:
            two_opt(cost, order, lengths, movable.sum(axis=1), given["avant12h"], penalty_s, min_gain, min_movable, max_rounds)
        before = np.concatenate([np.zeros((len(order), 1), dtype=np.int64), order[:, :-1]], axis=1)
        t, k = np.nonzero(np.arange(order.shape[1])[None, :] < lengths[:, None])
        point = order[t, k]
        yield pa.RecordBatch.from_arrays(
            [
                tours.take(pa.array(t)), pa.array(k), pa.array(ids[starts[t] + point]),
                pa.array(given["avant12h"][t, point].astype(bool)), pa.array(given["locked"][t, point].astype(bool)),
                pa.array(cost[t, before[t, k], point]),
            ],
            names=["tour_id", "pos", "i", "avant12h", "locked", "seconds"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(_flat(batch))
            if sum(x.num_rows for x in held) >= _ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                whole = pc.index(table["tour_id"], table["tour_id"][-1]).as_py()  # the last tour may go on
                if whole > 0:
                    yield from solve(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if sum(x.num_rows for x in held):
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _flat(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of lists of points and seconds as a row per point."""
    if not pa.types.is_list(batch.schema.field("j").type):
        return batch
    at = pc.list_parent_indices(batch["j"])
    return pa.RecordBatch.from_arrays(
        [c.flatten() if n in ("j", "seconds") else c.take(at) for n, c in zip(batch.schema.names, batch.columns)], batch.schema.names
    )


def _runs(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of rows: each row's run and its number."""
    run = np.repeat(np.arange(len(counts)), counts)
    return run, np.arange(len(run)) + np.repeat(starts - (counts.cumsum() - counts), counts)


def nearest(cost: np.ndarray, movable: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Position of every point on a greedy walk from point 0; -1 for none."""
    tours = np.arange(len(cost))
    open_, here, going = movable.copy(), np.zeros(len(cost), dtype=np.int64), np.ones(len(cost), dtype=bool)
    pos = np.full(movable.shape, -1, dtype=np.int64)
    for step in range(int(movable.sum(axis=1).max(initial=0))):
        ahead = np.where(open_, cost[tours, here], np.inf)
        choice = ahead.argmin(axis=1)
        going &= np.isfinite(ahead[tours, choice])
        if not going.any():
            break
        t, c = tours[going], choice[going]
        pos[t, c], open_[t, c], here[t] = step, False, c
    walked = (pos >= 0).sum(axis=1)
    pos = np.where(open_, walked[:, None] + open_.cumsum(axis=1) - 1, pos)
    return np.where(fixed, movable.sum(axis=1)[:, None], pos)


def two_opt(cost, order, lengths, limits, noon, penalty_s, min_gain, min_movable, max_rounds) -> None:
    """Improve ``order`` in place: per round, every tour's next improving reversal in scan order."""
    width = order.shape[1]
    place = np.arange(width)
    going = np.nonzero(limits >= min_movable)[0]
    cursor = np.full(len(order), -1, dtype=np.int64)
    rounds = 0
    while len(going) and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        o, c, n = order[going], cost[going], lengths[going]
        rows = np.arange(len(going))[:, None]
        prev = np.concatenate([np.zeros((len(o), 1), dtype=np.int64), o[:, :-1]], axis=1)
        real = place[None, :] < n[:, None]

        def split(x, where):
            """Running totals of the finite values and of the number of infinite ones, with a leading 0."""
            bad = np.isinf(x) & where
            zero = np.zeros((len(x), 1))
            return [np.concatenate([zero, v.cumsum(axis=1)], axis=1) for v in (np.where(bad | ~where, 0.0, x), bad.astype(float))]

        fwd, fwd_inf = split(c[rows, prev, o], real)
        back, back_inf = split(c[rows, o, prev], real & (place > 0)[None, :])
        late = noon[going][rows, o].astype(float) * real
        late_n = np.concatenate([np.zeros((len(o), 1)), late.cumsum(axis=1)], axis=1)
        late_pos = np.concatenate([np.zeros((len(o), 1)), (late * place).cumsum(axis=1)], axis=1)

        into = c[rows[:, :, None], prev[:, :, None], o[:, None, :]]  # a-1 -> b
        nxt = np.concatenate([o[:, 1:], o[:, :1]], axis=1)
        out = c[rows[:, :, None], o[:, :, None], nxt[:, None, :]]  # a -> b+1
        out = np.where((place[None, :] + 1 < n[:, None])[:, None, :], out, 0.0)
        end = np.minimum(place + 2, width)[None, :].repeat(len(o), axis=0)
        end = np.minimum(end, n[:, None])

        def change(run, ahead):
            inner = run[:, None, 1:] - run[:, 1:, None]
            return inner - (np.take_along_axis(ahead, end, axis=1)[:, None, :] - ahead[:, :-1, None])

        def some(x):
            return np.where(np.isinf(x), 0.0, x)

        gain = some(into) + some(out) + change(back, fwd)
        moved_n = late_n[:, None, 1:] - late_n[:, :-1, None]
        moved_pos = late_pos[:, None, 1:] - late_pos[:, :-1, None]
        gain += penalty_s * ((place[:, None] + place[None, :])[None] * moved_n - 2 * moved_pos)
        gain_inf = np.isinf(into).astype(float) + np.isinf(out) + change(back_inf, fwd_inf)
        total_inf = fwd_inf[:, -1][:, None, None]

        allowed = (place[:, None] < place[None, :])[None] & (place[None, :] < limits[going][:, None])[:, None, :]
        better = allowed & (total_inf + gain_inf == 0) & ((total_inf > 0) | (gain < -min_gain))
        flat = better.reshape(len(o), -1)
        behind = flat & (np.arange(flat.shape[1])[None, :] > cursor[going][:, None])
        found = flat.any(axis=1)
        move = np.where(behind.any(axis=1), behind.argmax(axis=1), flat.argmax(axis=1))[found]
        going = going[found]
        a, b = move // width, move % width
        inside = (place[None, :] >= a[:, None]) & (place[None, :] <= b[:, None])
        turned = np.where(inside, (a + b)[:, None] - place[None, :], place[None, :])
        order[going] = np.take_along_axis(order[going], turned, axis=1)
        cursor[going] = move


def improve_one(cost, order, limit, noon, penalty_s, min_gain, min_movable, max_rounds) -> np.ndarray:
    """``two_opt`` of one order by the same rule, holding one row of reversals instead of all of them."""
    order, n = order.copy(), len(order)
    if limit < min_movable:
        return order
    place = np.arange(n, dtype=float)
    row, last = 0, -1
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        prev = np.concatenate([[0], order[:-1]])

        def split(x):
            bad = np.isinf(x)
            return [np.concatenate([[0.0], v.cumsum()]) for v in (np.where(bad, 0.0, x), bad.astype(float))]

        fwd, fwd_inf = split(cost[prev, order])
        against = cost[order, prev]
        against[0] = 0.0  # the link between start and first stop is never driven backwards
        back, back_inf = split(against)
        late = noon[order].astype(float)
        late_n = np.concatenate([[0.0], late.cumsum()])
        late_pos = np.concatenate([[0.0], (late * place).cumsum()])
        total_inf = fwd_inf[-1]
        found = None
        # once round all rows, the part of the first row up to the last reversal at the end
        for step in range(limit + 1):
            a = (row + step) % limit
            low = last + 1 if step == 0 else a + 1
            low, high = max(low, a + 1), min(last + 1, limit) if step == limit else limit
            if low >= high:
                continue
            b = np.arange(low, high)
            into = cost[prev[a], order[b]]
            out = np.where(b + 1 < n, cost[order[a], order[np.minimum(b + 1, n - 1)]], 0.0)
            end = np.minimum(b + 2, n)
            gain = np.where(np.isinf(into), 0.0, into) + np.where(np.isinf(out), 0.0, out)
            gain = gain + ((back[b + 1] - back[a + 1]) - (fwd[end] - fwd[a]))
            gain += penalty_s * ((a + b) * (late_n[b + 1] - late_n[a]) - 2 * (late_pos[b + 1] - late_pos[a]))
            gain_inf = np.isinf(into).astype(float) + np.isinf(out)
            gain_inf = gain_inf + ((back_inf[b + 1] - back_inf[a + 1]) - (fwd_inf[end] - fwd_inf[a]))
            better = (total_inf + gain_inf == 0) & ((total_inf > 0) | (gain < -min_gain))
            if better.any():
                found = a, int(b[better.argmax()])
                break
        if found is None:
            break
        row, last = found
        order[row : last + 1] = order[row : last + 1][::-1].copy()
    return order
