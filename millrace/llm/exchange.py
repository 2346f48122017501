"""Numbers of texts, exchanged by bucket in packed rows.

An entry is a class (the number of a distinct text), a 64-bit key, and extra numbers. Entries go
to the bucket that the low bits of their key name. A task packs what it holds into one binary row
for each bucket that gets anything, so a row costs its entries and a short head for each class.

With many buckets the entries of a task would spread over as many rows with little in each. So
the bucket is resolved in rounds of TURN bits: each round sends entries to at most 2^TURN times
as many places as the one before, and the next one packs what has met there again. The number of
rows follows the volume in each round, whatever the number of buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Workspace

#: Bits of the bucket that a round resolves, and bytes of text for a task of a later round.
TURN, TASK = 8, 256 << 20
#: Packed rows: kind 0 goes to its bucket; kind 1 is settled and passes through.
SCHEMA = "kind int, bucket int, run binary"


def bits_for(volume: int, bucket: int, least: int) -> int:
    """Bits of the number of buckets, a power of two."""
    return max(least, -(-volume // bucket), 1).bit_length() - 1


def pack(cls, key, extras, bits: int, resolved: int, width: int = 8):
    """bucket, run: of entries whose equal classes stand together. With all bits resolved only ``width`` bytes of the key above the bucket's bits travel."""
    import numpy as np

    at = ((key & np.uint64((1 << bits) - 1)) >> np.uint64(bits - resolved)).astype(np.uint16 if resolved <= 16 else np.int64)
    order = np.argsort(at, kind="stable")
    at, cls, key, extras = at[order], cls[order], key[order], [x[order] for x in extras]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (cls[1:] != cls[:-1])
    first = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % 65535 == 0
    first = np.flatnonzero(new)
    count, own = np.diff(np.append(first, len(at))).astype("<u2"), cls[first].astype("<i8")
    if resolved == bits and width < 8:
        key = key >> np.uint64(bits)
    raw = np.ascontiguousarray(key.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : width if resolved == bits else 8]
    cut = np.concatenate([np.flatnonzero(at[first[1:]] != at[first[:-1]]) + 1, [len(first)]]) if len(first) else []
    buckets, runs, lo = [], [], 0
    for hi in cut:
        a, b = first[lo], first[hi] if hi < len(first) else len(at)
        buckets.append(int(at[a]))
        runs.append(b"".join([np.int32(hi - lo).tobytes(), own[lo:hi].tobytes(), count[lo:hi].tobytes(), raw[a:b].tobytes(), *[x[a:b].tobytes() for x in extras]]))
        lo = hi
    return buckets, runs


def unpack(runs, bucket: int, kinds, bits: int, width: int = 8):
    """class, key and extras (of these kinds) of packed rows; width: 8 before all bits are resolved."""
    import numpy as np

    parts = []
    for run in runs:
        raw = run.as_buffer() if hasattr(run, "as_buffer") else run
        d = int(np.frombuffer(raw, "<i4", 1)[0])
        n, at = np.frombuffer(raw, "<u2", d, 4 + 8 * d), 4 + 10 * d
        total = int(n.sum())
        key = np.zeros((total, 8), np.uint8)
        key[:, :width] = np.frombuffer(raw, np.uint8, width * total, at).reshape(-1, width)
        at += width * total
        extras = []
        for kind in kinds:
            extras.append(np.frombuffer(raw, kind, total, at))
            at += extras[-1].nbytes
        parts.append((np.repeat(np.frombuffer(raw, "<i8", d, 4), n), key.view("<u8").reshape(-1), *extras))
    cls, key, *extras = (np.concatenate([p[k] for p in parts]) for k in range(2 + len(kinds)))
    return cls, (key << np.uint64(bits)) | np.uint64(bucket) if width < 8 else key, *extras


def batch(kind0, kind1):
    """A record batch of SCHEMA from (buckets, runs) of both kinds."""
    import pyarrow as pa

    kinds = [0] * len(kind0[0]) + [1] * len(kind1[0])
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([*kind0[0], *kind1[0]], pa.int32()), pa.array([*kind0[1], *kind1[1]], pa.binary())], names=["kind", "bucket", "run"])


def resolved_runs(runs: DataFrame, bits: int, volume: int, space: Workspace, again, kinds=(), held: int = 350_000) -> DataFrame:
    """The rows of runs, which has the first round behind it, after all others.

    again(cls, key, extras, resolved) packs entries into a record batch of SCHEMA."""
    resolved = min(bits, TURN)
    while resolved < bits:
        runs, before = space.save(runs, f"round{resolved}-{uuid.uuid4().hex[:8]}"), resolved
        resolved = min(bits, resolved + TURN)

        def go(batches, resolved=resolved):
            import numpy as np

            parts, size = [], 0

            def flush():
                return again(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)), [np.concatenate([p[2 + k] for p in parts]) for k in range(len(kinds))], resolved)

            for b in batches:
                for run in b.column(2):
                    parts.append(unpack([run], 0, kinds, bits))
                    size += len(parts[-1][0])
                    if size >= held:
                        yield flush()
                        parts, size = [], 0
            if parts:
                yield flush()

        tasks = max(1, volume // TASK)
        salts = max(1, tasks >> before)
        inner = runs.filter("kind = 0").repartition(min(tasks, salts << before), "bucket", F.pmod(F.xxhash64("run"), F.lit(salts))).sortWithinPartitions("bucket")
        runs = inner.mapInArrow(go, SCHEMA).union(runs.filter("kind = 1"))
    return runs
