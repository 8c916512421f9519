"""Recurrences by array operations against plain loops, and transfer functions against walking the rows."""

from __future__ import annotations

import json
import math
import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricetrail import recurrences
from pricetrail.operators import candidates, monitoring
from pricetrail.sequences import UNKNOWN


def in_blocks(recurrence, state, batch, rng):
    """Outputs of a batch that is cut into blocks anywhere."""
    out, at = [], 0
    while at < batch.num_rows:
        n = rng.choice([1, 2, 7, 50, 1000])
        state, own = recurrence.run(state, batch.slice(at, n))
        state = json.loads(json.dumps(state))
        out += list(zip(*[c.to_pylist() for c in own]))
        at += n
    return state, out


def transfer_of(recurrence, batch, rng):
    account, at = recurrence.transfer(), 0
    while at < batch.num_rows:
        n = rng.choice([1, 3, 40, 1000])
        account.add(batch.slice(at, n))
        at += n
    return json.loads(json.dumps(account.summary()))


class Row:
    def __init__(self, **values):
        self.__dict__.update(values)


def test_revisit_intervals():
    rng = random.Random(1)
    own = recurrences.RevisitInterval(3600, 900, 86400, 3)
    for _ in range(60):
        n = rng.randrange(1, 300)
        rows = [Row(outcome=rng.choices(["ok", "failed", None], [rng.choice([1, 9]), 2, 0.2])[0], changed=rng.random() < rng.choice([0.1, 0.6]), available=rng.random() < 0.95) for _ in range(n)]
        batch = pa.record_batch({k: pa.array([getattr(r, k) for r in rows]) for k in ("outcome", "changed", "available")})
        entry = [rng.choice(sorted(own.place)), rng.randrange(6), rng.randrange(8)]
        state, want = entry, []
        for r in rows:
            state, out = monitoring.ttl_step(state, r)
            want.append(tuple(out))
        got_state, got = in_blocks(own, entry, batch, rng)
        assert got == want and got_state == state
        assert own.apply(transfer_of(own, batch, rng), entry) == state


def bucket_rows(rng, n, window, limit):
    at, out = 1_700_000_000_000_000 + rng.randrange(10**6), []
    for _ in range(n):
        at += int(rng.choice([0, 0.2, 0.7, 1, 1.3, 5, limit * 2]) * window * 1e6 / limit * rng.choice([rng.random(), 1, 0.5]))
        out.append(at)
    return out


def plain_bucket(times, limit, window):
    """Tokens as fractions, one request after the other."""
    rate, tokens, out = Fraction(limit, window * 10**6), Fraction(limit), []
    for before, now in zip([times[0], *times], times):
        tokens = min(Fraction(limit), tokens + (now - before) * rate)
        allowed = tokens >= 1
        tokens -= allowed
        out.append((allowed, math.floor(tokens), 0 if allowed else max(1, math.ceil((1 - tokens) / (rate * 10**6)))))
    return out


def test_token_bucket_and_its_transfer():
    rng = random.Random(2)
    known = 0
    for _ in range(150):
        limit, window = rng.choice([(1, 60), (3, 600), (4, 14400), (60, 60), (7, 1)])
        own = recurrences.TokenBucket(limit, window)
        times = bucket_rows(rng, rng.randrange(1, 400), window, limit)
        if rng.random() < 0.4:  # a saturated identity
            times = [times[0] + (t - times[0]) // 20 for t in times]
        batch = pa.record_batch({"at_us": pa.array(times)})
        end, got = in_blocks(own, None, batch, rng)
        assert got == plain_bucket(times, limit, window)
        cut = rng.randrange(len(times))
        middle, _ = in_blocks(own, None, batch.slice(0, cut), rng) if cut else (None, None)
        answer = own.apply(transfer_of(own, batch.slice(cut), rng), middle)
        if answer is not UNKNOWN:
            known += 1
            assert answer == end
    assert known > 100


def test_a_saturated_bucket_is_always_known():
    own, rng = recurrences.TokenBucket(5, 50), random.Random(3)
    times = np.cumsum([rng.randrange(1, 900_000) for _ in range(4000)]) + 1_700_000_000_000_000
    batch, state = pa.record_batch({"at_us": pa.array(times)}), None
    for at in range(0, 4000, 100):
        after, _ = own.run(state, batch.slice(at, 100))
        assert own.apply(transfer_of(own, batch.slice(at, 100), rng), state) == after
        state = after


def test_last_accepted_rate_and_its_transfer():
    rng, known = random.Random(4), 0
    own = recurrences.LastAccepted(15, pa.decimal128(24, 12))
    for _ in range(120):
        level, rows = 5.0, []
        for _ in range(rng.randrange(1, 300)):
            level *= rng.choice([1, 1, 1, 1.15, 0.85, 1.02, 0.97, rng.uniform(0.7, 1.4)])
            level = min(max(level, 0.5), 50)
            rows.append((Decimal(str(round(level, rng.choice([1, 2, 4])))), rng.random() < 0.9))
        batch = pa.record_batch({"rate": pa.array([r for r, _ in rows], pa.decimal128(24, 12)), "sound": pa.array([s for _, s in rows])})

        def plain(last, part):
            out = []
            for rate, sound in part:
                jump = bool(last is not None and last > 0 and abs(rate - last) * 100 > last * 15)
                out.append((last, jump))
                last = rate if sound and not jump else last
            return last, out

        last, want = plain(None, rows)
        end, got = in_blocks(own, None, batch, rng)
        assert got == want and (end is None) == (last is None) and (end is None or Decimal(end) == last)
        summary = transfer_of(own, batch, rng)
        for entry in ("5", "0.9", "20.5", "3.21", None):
            answer = own.apply(summary, entry)
            if answer is not UNKNOWN:
                known += 1
                after = plain(None if entry is None else Decimal(entry), rows)[0]
                assert (answer is None) == (after is None) and (answer is None or Decimal(answer) == after)
    assert known > 400


def test_spacing():
    rng = random.Random(5)
    for _ in range(80):
        cooldown, spacing = rng.choice([(300, 15.0), (900, 120.5), (10, 60.0)])
        own = recurrences.Spacing(cooldown, spacing)
        at, rows = 1_700_000_000_000_000, []
        for _ in range(rng.randrange(1, 400)):
            at += rng.choice([0, 10**5, 10**6, 2 * 10**7, 10**8])
            rows.append(Row(at_us=at, url=rng.choice(["a", "b", "c", None, "d" + str(rng.randrange(40))])))
        step, state = monitoring.spacing_step(cooldown, spacing)
        want = []
        for r in rows:
            state, out = step(state, r)
            want.append(out)
        batch = pa.record_batch({"at_us": pa.array([r.at_us for r in rows]), "url": pa.array([r.url for r in rows], pa.string())})
        end, got = in_blocks(own, own.initial, batch, rng)
        assert got == want
        assert end[0] == state[0] and end[1] == {u: t for u, t in state[1].items() if t > rows[-1].at_us}


def test_claims():
    rng = random.Random(7)
    for _ in range(60):
        own, at, times = recurrences.Claims(60), 1_700_000_000_000_000, []
        for _ in range(rng.randrange(1, 300)):
            at += rng.choice([0, 10**6, 59 * 10**6, 6 * 10**7, 10**9])
            times.append(at)
        want, until = [], None
        for t in times:
            want.append((until is None or t >= until,))
            until = t + 6 * 10**7 if want[-1][0] else until
        assert in_blocks(own, None, pa.record_batch({"at_us": pa.array(times)}), rng) == (until, want)


def test_running_barcode(spark):
    rng, rows, want = random.Random(6), [], {}
    for ref in range(40):
        known = None
        for seq in range(rng.randrange(1, 30)):
            gtin, decision = rng.choice(["036000291452", "7891991010863", "123"]), rng.choice(["auto_match", "auto_match", "review"])
            rows.append((ref, seq, f"s{seq}", decision, gtin, "acme"))
            if decision == "auto_match" and gtin != "123":
                full = gtin.zfill(13)
                known = (full, f"auto_match:s{seq}") if known is None else known if known[0] == full else None
            want[ref, seq] = known or (None, None)
    hits = spark.createDataFrame(rows, "ref_id long, seq long, store string, decision string, gtin string, brand string")
    refs = spark.createDataFrame([(r, "acme", None) for r in range(40)], "ref_id long, brand string, gtin string")
    for cut in (None, 4):
        got = {(r["ref_id"], r["seq"]): (r["learned"], r["learned_from"]) for r in candidates.running_gtin(refs, hits, cut).collect()}
        assert got == want


@pytest.mark.parametrize("pieces", [5, 50])
def test_jobs_do_not_depend_on_the_number_of_segments(spark, pieces):
    n = 6000
    requests = spark.range(n).select(F.lit("hot").alias("identity"), F.col("id").alias("request_id"), F.timestamp_micros(F.col("id") * 40_000 + F.lit(1_700_000_000_000_000)).alias("at"))
    spark.sparkContext.setJobGroup(f"pieces {pieces}", "count the jobs")
    found = monitoring.quota_audit(requests, 60, 60, cut_rows=n // pieces)
    assert found.where("allowed").count() == 60 + math.floor(5999 * 0.04)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pieces {pieces}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= JOBS, jobs


JOBS = 30  # the same bound for 5 and for 50 segments
