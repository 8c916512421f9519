"""Recurrences over ordered rows, computed by array operations a block at a time.

Each is a ``sequences.Recurrence``. Where what a stretch of rows does to any state before it has a small exact form, it is
the recurrence's transfer function:

* revisit intervals are shifts on a scale of doublings with a floor and a ceiling; such clamped shifts compose to one;
* a token bucket that never fills up in a stretch turns its next free time by a whole number of
  tokens into one interval of a token's length; one that has filled up whatever came before forgets it;
* the last accepted rate after a stretch follows from which of its rates is the first to be near enough.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa

from .sequences import UNKNOWN, Recurrence


def numbers(block: pa.RecordBatch, name: str) -> np.ndarray:
    return block.column(name).to_numpy(zero_copy_only=False)


def flags(block: pa.RecordBatch, name: str) -> np.ndarray:
    """A boolean column, null as false."""
    return block.column(name).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def last_true(mask: np.ndarray) -> np.ndarray:
    """For each place the last place up to it where the mask holds; -1 if none."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


# --- clamped shifts ---------------------------------------------------------------------------


class Shifts:
    """Functions x -> min(hi, max(lo, x + by)), one for each place of three arrays."""

    def __init__(self, by: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.by, self.lo, self.hi = by, lo, hi

    def __getitem__(self, at: slice) -> Shifts:
        return Shifts(self.by[at], self.lo[at], self.hi[at])

    def __len__(self) -> int:
        return len(self.by)

    def then(self, other: Shifts) -> Shifts:
        clamp = lambda x: np.minimum(other.hi, np.maximum(other.lo, x + other.by))
        return Shifts(self.by + other.by, clamp(self.lo), clamp(self.hi))

    def of(self, x: int) -> np.ndarray:
        return np.minimum(self.hi, np.maximum(self.lo, x + self.by))

    def running(self) -> Shifts:
        """For each place the functions up to it as one: twice as many are composed in each of log2(n) steps."""
        all_, d = self, 1
        while d < len(all_):
            more = all_[: len(all_) - d].then(all_[d:])
            all_ = Shifts(*(np.concatenate([a[:d], b]) for a, b in ((all_.by, more.by), (all_.lo, more.lo), (all_.hi, more.hi))))
            d *= 2
        return all_

    def whole(self) -> list[int]:
        """All functions as one, composed in pairs."""
        all_ = self
        while len(all_) > 1:
            odd = all_[-1:] if len(all_) % 2 else None
            all_ = all_[0 : len(all_) - len(all_) % 2 : 2].then(all_[1::2])
            if odd is not None:
                all_ = Shifts(*(np.concatenate([a, b]) for a, b in ((all_.by, odd.by), (all_.lo, odd.lo), (all_.hi, odd.hi))))
        return [int(all_.by[0]), int(all_.lo[0]), int(all_.hi[0])]


class RevisitInterval(Recurrence):
    """The state is (interval, unchanged visits in a row, failures in a row).

    On the scale log2(interval / least) all steps are clamped shifts: a failure adds as many doublings as there are
    failures in a row, up to ``MOST_DOUBLINGS``, a change takes one, unchanged visits add one from the ``patience``-th on, an
    unavailable offer goes to the top. An interval is the least times a power of two, or the most over one.
    """

    STEP = 1 << 20  # of the scale, a doubling
    MOST_DOUBLINGS = 5
    reads = ("outcome", "changed", "available")

    def __init__(self, start: int, least: int, most: int, patience: int) -> None:
        self.least, self.most, self.patience = least, most, patience
        self.initial = [start, 0, 0]
        whole = 0
        while least << (whole + 1) <= most:
            whole += 1
        #: Intervals by place on the scale: up from the least, and down from the most.
        up = {k * self.STEP: least << k for k in range(whole + 1)}
        self.top = whole * self.STEP + (0 if least << whole == most else self.STEP // 2)
        down = {self.top - k * self.STEP: most >> k for k in range(whole + 1)}
        if any(most >> k << k != most for k in range(whole + 1)):
            raise ValueError("the longest interval must halve without a rest down to the shortest")
        self.interval = {**down, **up}
        self.place = {v: k for k, v in self.interval.items()}

    def counts(self, ok: np.ndarray, changed: np.ndarray, unchanged: int, failures: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(len(ok))
        last_ok, last_change = last_true(ok), last_true(ok & changed)
        up = np.cumsum(ok & ~changed)
        return up - np.where(last_change >= 0, up[last_change], -unchanged), np.where(last_ok >= 0, at - last_ok, failures + at + 1)

    def shifts(self, ok: np.ndarray, changed: np.ndarray, available: np.ndarray, unchanged: np.ndarray, failures: np.ndarray) -> Shifts:
        doublings = np.where(~ok, np.minimum(failures, self.MOST_DOUBLINGS), np.where(changed, -1, np.where(unchanged >= self.patience, 1, 0)))
        away = ok & ~available
        return Shifts(np.where(away, 0, doublings * self.STEP), np.where(away, self.top, 0), np.full(len(ok), self.top))

    def columns(self, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = np.array([o == "ok" for o in block.column("outcome").dictionary_encode().dictionary.to_pylist()] + [False])
        codes = block.column("outcome").dictionary_encode().indices.fill_null(len(ok) - 1).to_numpy(zero_copy_only=False)
        return ok[codes], flags(block, "changed"), flags(block, "available")

    def run(self, state: Any, block: pa.RecordBatch) -> tuple[Any, list[pa.Array]]:
        interval, unchanged, failures = state
        ok, changed, available = self.columns(block)
        unchanged, failures = self.counts(ok, changed, unchanged, failures)
        places = self.shifts(ok, changed, available, unchanged, failures).running().of(self.place[interval])
        known = np.array(sorted(self.interval))
        intervals = np.array([self.interval[k] for k in known])[np.searchsorted(known, places)]
        return [int(intervals[-1]), int(unchanged[-1]), int(failures[-1])], [pa.array(c, pa.int64()) for c in (intervals, unchanged, failures)]

    def transfer(self) -> RevisitTransfer:
        return RevisitTransfer(self)

    def apply(self, summary: Any, state: Any) -> Any:
        interval, unchanged, failures = state
        (by, lo, hi), (more_u, u), (more_f, f) = summary[min(unchanged, self.patience)][min(failures, self.MOST_DOUBLINGS)]
        place = min(hi, max(lo, self.place[interval] + by))
        return [self.interval[place], u + (unchanged if more_u else 0), f + (failures if more_f else 0)]


class RevisitTransfer:
    """Per pair of counts before the segment (more than matters counts as the most that does): the clamped shift, and the counts after."""

    def __init__(self, of: RevisitInterval) -> None:
        self.of = of
        self.by_counts = [[[None, [True, 0], [True, 0]] for _ in range(of.MOST_DOUBLINGS + 1)] for _ in range(of.patience + 1)]

    def add(self, block: pa.RecordBatch) -> None:
        ok, changed, available = self.of.columns(block)
        u, f = self.of.counts(ok, changed, 0, 0)
        # from here on the counts before the block do not matter
        settled = np.flatnonzero((np.cumsum(ok) > 0) & ((np.cumsum(ok & changed) > 0) | (np.cumsum(ok & ~changed) >= self.of.patience)))
        head = int(settled[0]) + 1 if len(settled) else len(ok)
        tail = self.of.shifts(ok[head:], changed[head:], available[head:], u[head:], f[head:])
        for unchanged, row in enumerate(self.by_counts):
            for failures, own in enumerate(row):
                before_u, before_f = (own[1][1] + (unchanged if own[1][0] else 0)), (own[2][1] + (failures if own[2][0] else 0))
                us, fs = self.of.counts(ok[:head], changed[:head], before_u, before_f)
                first = self.of.shifts(ok[:head], changed[:head], available[:head], us, fs)
                parts = [Shifts(*(np.array([x]) for x in own[0]))] if own[0] else []
                parts += [first] if head else []
                parts += [tail] if len(tail) else []
                joined = Shifts(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("by", "lo", "hi")))
                own[0] = joined.whole()
                # a count goes on only while nothing has reset it
                own[1] = [own[1][0], own[1][1] + int(u[-1])] if not (ok & changed).any() else [False, int(u[-1])]
                own[2] = [own[2][0], own[2][1] + int(f[-1])] if not ok.any() else [False, int(f[-1])]

    def summary(self) -> list:
        return self.by_counts


# --- token bucket -----------------------------------------------------------------------------


class TokenBucket(Recurrence):
    """The state is the time from which the bucket is full again (null: full before the first request).

    Times are whole microseconds times ``limit``, so that a token takes a whole number of them, ``token``, and the
    bucket holds ``size``. A request at t is allowed if the free time v is at most t + size - token, and then moves max(t, v) on by a
    token. While the bucket is not full, v keeps its rest modulo a token: after k requests it is the lesser of
    v + k * token and the one time of that rest in (a, a + token], where a is the running minimum
    of the limits t + size - token, each moved on by a token for every later request. So all requests up to the next one that finds
    the bucket full are computed at once.
    """

    reads = ("at_us",)

    def __init__(self, limit: int, window_seconds: int) -> None:
        if limit <= 0 or window_seconds <= 0:
            raise ValueError("limit and window must be above zero")
        self.limit, self.token = limit, int(window_seconds) * 1_000_000
        self.size = self.token * limit

    def times(self, block: pa.RecordBatch) -> tuple[int, np.ndarray]:
        at = numbers(block, "at_us").astype(np.int64)
        return int(at[0]) * self.limit, (at - at[0]) * self.limit

    def free(self, v: int | None, t: np.ndarray) -> tuple[np.ndarray, int]:
        """The free time, now at least, that each request finds; and the one after the last."""
        n, token = len(t), self.token
        found = np.empty(n, np.int64)
        close = np.append(np.flatnonzero(t[1:] - t[:-1] <= token), n - 1)  # the next request may find the bucket not full
        i, most = 0, 64
        while i < n:
            if v is None or v < t[i]:
                j = int(close[np.searchsorted(close, i)])  # up to here each finds it full
                found[i : j + 1] = t[i : j + 1]
                i, v, most = j + 1, int(t[j]) + token, 64
                continue
            own = t[i : i + most]
            k = np.arange(len(own))
            a = np.minimum.accumulate(own + (self.size - token) - k * token) + k * token
            after = np.minimum(v + (k + 1) * token, v + token * ((a - v) // token + 1))
            before = np.concatenate([[v], after[:-1]])
            full = np.flatnonzero(before < own)
            end = int(full[0]) if len(full) else len(own)
            found[i : i + end] = before[:end]
            v = int(before[end]) if len(full) else int(after[-1])
            i, most = i + end, 64 if len(full) else min(2 * most, 1 << 16)
        return found, v

    def run(self, state: Any, block: pa.RecordBatch) -> tuple[Any, list[pa.Array]]:
        base, t = self.times(block)
        found, after = self.free(None if state is None else max(state - base, -1), t)
        left = t + self.size - found
        allowed = left >= self.token
        left = np.where(allowed, left - self.token, left)
        second = self.limit * 1_000_000
        wait = np.where(allowed, 0, np.maximum(1, -((left - self.token) // second)))
        return base + after, [pa.array(allowed), pa.array(left // self.token, pa.int64()), pa.array(wait, pa.int64())]

    def transfer(self) -> TokenTransfer:
        return TokenTransfer(self)

    def apply(self, summary: Any, state: Any) -> Any:
        if state is None or summary["forgets"]:
            return summary["end"]
        if summary["never_full"] and state >= summary["from"]:
            n, a = summary["n"], summary["a"]
            return min(state + n * self.token, state + self.token * ((a - state) // self.token + 1))
        return UNKNOWN


class TokenTransfer:
    """Whether a segment forgets what came before, and else its number of requests, the limit ``a`` after them, and from which free time on the bucket never fills up."""

    def __init__(self, of: TokenBucket) -> None:
        self.of, self.n, self.low, self.least, self.state = of, 0, None, None, None
        self.forgets, self.never_full = False, True

    def add(self, block: pa.RecordBatch) -> None:
        of, token = self.of, self.of.token
        base, t = of.times(block)
        self.state, _ = of.run(self.state, block)
        k = np.arange(len(t))
        # low: the running minimum of limits, less a token for each request before; absolute numbers are Python's, so nothing overflows
        shift = base - self.n * token
        own = np.minimum.accumulate(t + (of.size - token) - k * token)
        if self.low is not None:
            own = np.minimum(own, min(self.low - shift, 1 << 62))
        a = own + k * token
        before = a[:-1] if self.low is None else np.concatenate([[min(self.low - shift, 1 << 62) - token], a[:-1]])
        now = t[1:] if self.low is None else t
        self.forgets |= bool((before + token < now).any())
        self.never_full &= bool((before >= now).all())
        least = shift + int((t - k * token).max())
        self.least = least if self.least is None else max(self.least, least)
        self.low = shift + int(own[-1])
        self.n += len(t)

    def summary(self) -> dict:
        return {"n": self.n, "a": self.low + (self.n - 1) * self.of.token, "from": self.least, "forgets": self.forgets, "never_full": self.never_full, "end": self.state}


# --- last accepted rate -----------------------------------------------------------------------


class LastAccepted(Recurrence):
    """The state is the last accepted rate, as text. A sound rate is accepted unless it moved by more than ``most`` per cent against that.

    Rates between two jumps against the rate before are all accepted or refused by the first of them, so the
    steps are the jumps, not the rows. Comparisons are of doubles; those that come out close are decided by decimals.
    """

    reads = ("rate", "sound")
    PIECES = 16

    def __init__(self, most: int, kind: pa.DataType) -> None:
        self.most, self.kind = most, kind

    def far(self, last: Any, rates: np.ndarray, last_exact: Any, exact: Any) -> np.ndarray:
        """Whether rates are too far from the last ones (an array, or one for all); the exact values are given by place."""
        apart = np.abs(rates - last) * 100 - last * self.most
        found = (apart > 0) & (last > 0)
        for k in np.flatnonzero(np.abs(apart) <= 1e-9 * (np.abs(rates) + np.abs(last)) * 100):
            one, two = last_exact(int(k)), exact(int(k))
            found[k] = one > 0 and abs(two - one) * 100 > one * self.most
        return found

    def walk(self, last: Decimal | None, rates: np.ndarray, exact: pa.Array, jumps: np.ndarray, start: int = 0) -> tuple[np.ndarray, Decimal | None]:
        """Which of the sound rates from ``start`` on are accepted, and the last of them. jumps: places that jump against the place before."""
        n = len(rates)
        accepted = np.zeros(n, bool)
        i, most = start, 64
        while i < n:
            if last is not None:
                end = min(n, i + most)
                near = np.flatnonzero(~self.far(float(last), rates[i:end], lambda k: last, lambda k: exact[i + k].as_py()))
                if not len(near):
                    i, most = end, min(2 * most, 1 << 16)
                    continue
                i += int(near[0])
            at = np.searchsorted(jumps, i, "right")
            end = int(jumps[at]) if at < len(jumps) else n
            accepted[i:end] = True
            last, i, most = exact[end - 1].as_py(), end, 64
        return accepted, last

    def sound_rates(self, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        sound = np.flatnonzero(flags(block, "sound"))
        column = block.column("rate").take(pa.array(sound))
        rates = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
        jumps = 1 + np.flatnonzero(self.far(rates[:-1], rates[1:], lambda k: column[k].as_py(), lambda k: column[k + 1].as_py())) if len(rates) > 1 else np.zeros(0, int)
        return sound, rates, column, jumps

    def run(self, state: Any, block: pa.RecordBatch) -> tuple[Any, list[pa.Array]]:
        before = None if state is None else Decimal(state)
        sound, rates, exact, jumps = self.sound_rates(block)
        accepted, after = self.walk(before, rates, exact, jumps)
        taken = np.zeros(block.num_rows, bool)
        taken[sound[accepted]] = True
        place = np.concatenate([[-1], last_true(taken)[:-1]])  # the last accepted before each row
        all_ = pa.concat_arrays([block.column("rate"), pa.array([before], block.column("rate").type)])
        last = all_.take(pa.array(np.where(place < 0, block.num_rows, place)))
        lasts, own = last.cast(pa.float64()).to_numpy(zero_copy_only=False), block.column("rate").cast(pa.float64()).to_numpy(zero_copy_only=False)
        known = np.isfinite(lasts) & np.isfinite(own)
        jump = np.zeros(block.num_rows, bool)
        at = np.flatnonzero(known)
        jump[at] = self.far(lasts[at], own[at], lambda k: last[int(at[k])].as_py(), lambda k: block.column("rate")[int(at[k])].as_py())
        return (None if after is None else str(after)), [last.cast(self.kind), pa.array(jump)]

    def transfer(self) -> RateTransfer:
        return RateTransfer(self)

    def apply(self, summary: Any, state: Any) -> Any:
        if state is None:
            return summary["end"]
        last = Decimal(state)
        for rate, end in summary["first"]:
            if not (last > 0 and abs(Decimal(rate) - last) * 100 > last * self.most):
                return end
        return state if summary["whole"] else UNKNOWN


class RateTransfer:
    """The rates of a segment that can be the first accepted one, with the state after the segment if they are.

    A last rate takes an interval around it. So a rate can be left out if it lies between two earlier ones that are so near
    to each other that no interval fits between them. Rates that are equal as doubles count as equal here.
    """

    def __init__(self, of: LastAccepted) -> None:
        self.of, self.end, self.whole = of, None, True
        self.first: list[list] = []

    def add(self, block: pa.RecordBatch) -> None:
        _, rates, exact, jumps = self.of.sound_rates(block)
        if not len(rates):
            return

        def after(state: str | None, start: int = 0) -> str | None:
            last = self.of.walk(None if state is None else Decimal(state), rates, exact, jumps, start)[1]
            return None if last is None else str(last)

        self.first = [[rate, after(end)] for rate, end in self.first]
        self.end = after(self.end)
        near = (100 + self.of.most) / (100 - self.of.most) * (1 - 1e-9) if self.of.most < 100 else np.inf
        k = 0
        while self.whole and k < len(rates):
            known = np.sort([float(rate) for rate, _ in self.first])
            new = np.ones(len(rates) - k, bool)
            if len(known):
                place = np.searchsorted(known, rates[k:])
                above, below = known[np.minimum(place, len(known) - 1)], known[np.maximum(place - 1, 0)]
                new = (above != rates[k:]) & ((place == 0) | (place == len(known)) | (above > near * below))
            at = np.flatnonzero(new)
            if not len(at):
                return
            k += int(at[0])
            if len(self.first) == self.of.PIECES:
                self.whole = False
                return
            self.first.append([str(exact[k].as_py()), after(str(exact[k].as_py()), k + 1)])
            k += 1

    def summary(self) -> dict:
        return {"end": self.end, "first": self.first, "whole": self.whole}


# --- two gates --------------------------------------------------------------------------------


class Spacing(Recurrence):
    """Two gates of a host: the state is (next free time, URLs whose cooldown still runs and until when), in microseconds.

    Only admitted requests move the gates, so the steps are the admissions. The spacing bounds how many URLs can be
    in cooldown at a time. What a segment does depends on when exactly the host is free, so it has no small transfer.
    """

    reads = ("at_us", "url")
    initial = [None, {}]

    def __init__(self, url_cooldown: float, host_spacing: float) -> None:
        self.cooldown, self.spacing = round(url_cooldown * 1_000_000), round(host_spacing * 1_000_000)

    def run(self, state: Any, block: pa.RecordBatch) -> tuple[Any, list[pa.Array]]:
        free, cooling = state
        at = numbers(block, "at_us").astype(np.int64)
        coded = block.column("url").dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        names.append(None)
        never = np.iinfo(np.int64).min
        entry = np.array([cooling.get(url_key(u), never) for u in names], np.int64)
        until, n = entry.copy(), len(at)
        admitted = np.zeros(n, bool)
        i, most, gate = 0, 64, never if free is None else free
        while i < n:
            i = max(i, int(np.searchsorted(at, gate)))
            end = min(n, i + most)
            fit = np.flatnonzero(until[codes[i:end]] <= at[i:end])
            if not len(fit):
                i, most = end, min(2 * most, 1 << 16)
                continue
            i += int(fit[0])
            admitted[i] = True
            until[codes[i]], gate = at[i] + self.cooldown, int(at[i]) + self.spacing
            i, most = i + 1, 64
        # what each row found: its URL's last admission before it, and the host's
        order = np.argsort(codes, kind="stable")
        new = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        last = np.maximum.accumulate(np.where(admitted[order], np.arange(n), begin - 1))
        own = np.empty(n, np.int64)
        own[order] = np.where(last >= begin, at[order][np.maximum(last, 0)] + self.cooldown, entry[codes[order]])
        host = last_true(admitted)
        gates = np.where(host >= 0, at[np.maximum(host, 0)] + self.spacing, never if free is None else free)
        twice = ~admitted & (own > at)
        seconds = np.maximum(1, (np.where(admitted, at, np.where(twice, own, gates)) - at) // 1_000_000)
        code = np.where(admitted, None, np.where(twice, "DUPLICATE_REQUEST", "RATE_LIMITED"))
        now = int(at[-1])
        still = {u: t for u, t in cooling.items() if t > now} | {url_key(u): int(t) for u, t in zip(names, until, strict=True) if t > now}
        return [None if gate == never else gate, still], [pa.array(admitted), pa.array(code, pa.string()), pa.array(np.where(admitted, 0, seconds), pa.int64())]


def url_key(url: str | None) -> str:
    """A URL as a JSON key; null is a URL like any other."""
    return "-" if url is None else f"={url}"


class Claims(Recurrence):
    """First sight of a key, and again once its time-to-live has passed: the state is the time until which it is claimed."""

    reads = ("at_us",)

    def __init__(self, ttl: float) -> None:
        self.ttl = round(ttl * 1_000_000)

    def run(self, state: Any, block: pa.RecordBatch) -> tuple[Any, list[pa.Array]]:
        at = numbers(block, "at_us").astype(np.int64)
        n = len(at)
        claimed = np.zeros(n, bool)
        close = np.append(np.flatnonzero(at[1:] - at[:-1] < self.ttl), n - 1)  # the next row comes too soon
        i = 0 if state is None else int(np.searchsorted(at, state))
        while i < n:
            j = int(close[np.searchsorted(close, i)])  # up to here each row claims
            claimed[i : j + 1] = True
            state = int(at[j]) + self.ttl
            i = int(np.searchsorted(at, state))
        return state, [pa.array(claimed)]
