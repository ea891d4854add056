"""Core-sets of a stream against the plain definition, and restarts."""

import hashlib
import math

import numpy as np

from basinflow.operators.coreset import farthest_first
from basinflow.streaming import sampler

SCHEMA = "vec_id long, embedding array<float>, label int"


def files(spark, folder, pieces):
    for name, rows in pieces:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def plain_batches(arrivals, budget, pool, slots):
    """``arrivals``: lists of (id, vector), one for each micro-batch."""
    held, count, out = {}, {}, []
    for rows in arrivals:
        keyed = sorted((hashlib.md5(f"47 {i}".encode()).hexdigest(), i, v) for i, v in rows)
        for key, i, v in keyed:
            slot = int(key[:7], 16) % slots
            own = held.setdefault(slot, [])
            own.append((i, v))
            if len(own) == pool:
                picked = farthest_first(np.array([x for _, x in own]), budget)
                out += [(slot, count.get(slot, 0), p, own[k][0]) for p, k in enumerate(picked)]
                count[slot], held[slot] = count.get(slot, 0) + 1, []
    return sorted(out)


def test_a_restarted_stream_goes_on_with_its_pools(spark, tmp_path):
    rng = np.random.default_rng(51)
    arrivals = [[(1000 * part + k, np.round(rng.normal(size=3), 2).astype(np.float32).tolist()) for k in range(n)] for part, n in enumerate((30, 7, 50))]
    source, state = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    bad = [(None, [0.0] * 3, 0), (77, None, 0), (78, [math.nan, 0.0, 0.0], 0), (79, [], 0)]

    def run(target, checkpoint, steps):
        for number, rows in steps:
            files(spark, source, [(f"{number}", [(i, v, 0) for i, v in rows] + bad)])
            stream = sampler.stream_of(spark, f"{source}/*", SCHEMA)
            found = sampler.run_available(sampler.core_set_batches(stream, 3, 4, slots=2), str(tmp_path / target), checkpoint)
        return sorted(tuple(r) for r in found.collect())

    first = run("out", state, list(enumerate(arrivals))[:1])
    assert first == plain_batches(arrivals[:1], 3, 12, 2)
    whole = run("out", state, list(enumerate(arrivals))[1:])  # a new query on the old checkpoint
    assert whole == plain_batches(arrivals, 3, 12, 2) and len(whole) > len(first)
    again = sampler.run_available(sampler.core_set_batches(sampler.stream_of(spark, f"{source}/*", SCHEMA), 3, 4, slots=2), str(tmp_path / "out"), state)
    assert sorted(tuple(r) for r in again.collect()) == whole  # nothing new arrived
