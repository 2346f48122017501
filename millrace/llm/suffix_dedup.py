"""Removal of long repeated strings, by a distributed merge sort of sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts somewhere else. To sort every
suffix would move hundreds of bytes for each byte of text, so the sort works on a sample that
loses nothing:

1. Every window of LENGTH bytes has an anchor: of its substrings of GRAM bytes the one with the
   least hash, the leftmost of equals. Equal windows have equal anchors at equal offsets, so a
   window can only be repeated if its anchor's gram is. The anchors of the shorter windows of
   PASSAGE bytes hold those of the long ones; their hashes are exchanged, and only the stretches
   of text around repeated grams go on.
2. The suffixes at those anchors, to LENGTH bytes, are sorted in runs, equal ones of a run
   collapsed. Runs are cut at sampled splitters and exchanged front-coded: each suffix is the
   length of the prefix it shares with the one before, and the rest. A loser tree merges them;
   every loser keeps the length of its common prefix with its winner, so no known prefix is
   compared again. Neighbours that are equal are repeated windows.
3. Between two repeated windows no more than LENGTH apart nothing is left to decide. Around the
   ends of repeated passages it is: for grams of which any occurrence is undecided, the windows
   of all occurrences are exchanged as 64-bit hashes with their positions.

Hashes are 64 bits, so two different windows agree with a chance of about n^2 / 2^65. Equal
texts, verified by a second hash, count as one in all steps and are removed whole. What a task
itself holds twice is settled there, and one of it travels on: a passage that a third of all
texts hold meets as one entry, or one suffix, for each flush of a task.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from ._common import Workspace, table, text_classes, whole

#: Bytes of a repeated string, of a gram, and of a passage that shares a gram for certain; windows looked at together; suffixes of a run; entries packed at once; different suffixes of a range, bytes of a splitter, and how many suffixes are looked at for the splitters: for each range, and at least.
LENGTH, GRAM, PASSAGE, CHUNK, RUN, PACK, RANGE, SPLITTER, SAMPLE, LEAST_SAMPLE = 400, 160, 288, 1 << 18, 30_000, 300_000, 200_000, 24, 8, 4096
#: Bytes of text for a bucket of hashes, and buckets at least.
BUCKET, LEAST_BUCKETS = 16 << 20, 32


def sliced(batches, rows: int = 128):
    """Batches of few rows, so that what is made of one stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


class Hasher:
    """Polynomial hashes of all substrings of a length, through prefix sums modulo 2^64."""

    def __init__(self):
        import numpy as np

        self.table = np.random.default_rng(400).integers(0, 1 << 64, 256, np.uint64)
        n = CHUNK + LENGTH + 1
        self.up, self.down = np.full(n, 0x9E3779B97F4A7C15, np.uint64), np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
        self.up[0] = self.down[0] = 1
        self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)

    def sums(self, data):
        import numpy as np

        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.down[: len(data)], dtype=np.uint64)])

    def hashes(self, sums, length: int):
        import numpy as np

        h = (sums[length:] - sums[:-length]) * self.up[: len(sums) - length]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def segments(self, data: bytes, window: int = LENGTH):
        """anchor, first, last, hash: for windows first to last the anchor is one, and hash that of its gram."""
        import numpy as np

        raw, out = np.frombuffer(data, np.uint8), []
        for at in range(0, len(raw) - window + 1, CHUNK):
            part = raw[at : at + CHUNK + window - 1]
            h = self.hashes(self.sums(part), GRAM)
            low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
            width, step = window - GRAM + 1, 1
            while step * 2 <= width:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            low = np.minimum(low[: len(h) - width + 1], low[width - step : len(h) - step + 1]) if width > step else low
            anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            last = np.concatenate([first[1:], [len(anchor)]]) - 1
            a = anchor[first]
            out.append((a + at, first + at, last + at, h[a].view(np.int64)))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4


def _settled(cls, h, pos):
    """Entries in order of hash, each once; sent: one of each hash, the first; met: those whose hash is at another place here; across: in another class."""
    import numpy as np

    order = np.lexsort((pos, cls, h))
    cls, h, pos = cls[order], h[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]) | (pos[1:] != pos[:-1])  # a class that several tasks had
    cls, h, pos = cls[new], h[new], pos[new]
    sent = np.ones(len(h), bool)
    sent[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(sent)
    count = np.diff(np.append(first, len(h)))
    across = cls[first] != cls[first + count - 1] if len(first) else np.empty(0, bool)
    return cls, h, pos, sent, np.repeat(count > 1, count), np.repeat(across, count)


def _places(cls, pos, across):
    """_class, _at, _across: positions by class, and how many of them are of strings that other texts hold."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((pos, cls))
    cls, pos, across = cls[order], pos[order].astype(np.int32), across[order]
    key, first = np.unique(cls, return_index=True)
    offsets = np.concatenate([first, [len(cls)]]).astype(np.int32)
    sums = np.concatenate([[0], np.cumsum(across.astype(np.int64))])
    return pa.table({"_class": pa.array(key), "_at": pa.ListArray.from_arrays(pa.array(offsets), pa.array(pos)), "_across": pa.array(sums[offsets[1:]] - sums[offsets[:-1]])})


def _batch(cls, h, pos, bits: int, resolved: int):
    """Packed rows of entries (hash, position): what is met here is settled (kind 1), and one entry of each hash goes on to its bucket."""
    import numpy as np

    cls, h, pos, sent, met, across = _settled(cls, h, pos)
    done = ([], [])
    if met.any():
        order = np.argsort(cls[met], kind="stable")
        c = cls[met][order]
        done = [int(c[0]) & 0x3FFFFFFF], exchange.pack(c, pos[met][order].astype(np.uint64), [across[met][order].astype(np.uint8)], 0, 0)[1]
    cls, h, pos = cls[sent], h[sent], pos[sent]
    order = np.argsort(cls, kind="stable")
    return exchange.batch(exchange.pack(cls[order], h[order].view(np.uint64), [pos[order].astype("<u4")], bits, resolved), done)


class Packer:
    """Collects (hash, position) by text."""

    def __init__(self, bits: int, resolved: int):
        self.bits, self.resolved, self.held, self.size = bits, resolved, [], 0

    def add(self, key: int, h, pos) -> None:
        self.held.append((key, h, pos))
        self.size += len(h) + 1

    def flush(self):
        import numpy as np

        cls = np.repeat(np.array([x[0] for x in self.held], np.int64), [len(x[1]) for x in self.held])
        h, pos = (np.concatenate([x[k] for x in self.held]) for k in (1, 2))
        self.held, self.size = [], 0
        return _batch(cls, h, pos.astype(np.int64), self.bits, self.resolved)


def meeting(packed: DataFrame, bits: int, volume: int, space: Workspace) -> DataFrame:
    """_class, _at, _across: of each text the positions whose hash occurs at another place too; _across is above 0 where another text holds one."""

    def again(cls, h, extras, resolved):
        import numpy as np

        return _batch(cls, h.view(np.int64), extras[0].astype(np.int64), bits, resolved)

    def go(group):
        import numpy as np

        if group.column("kind")[0].as_py():
            cls, pos, across = exchange.unpack(group.column("run"), 0, ("u1",), 0)
            return _places(cls, pos.astype(np.int64), across)
        cls, h, pos = exchange.unpack(group.column("run"), 0, ("<u4",), bits)
        cls, _, pos, _, met, across = _settled(cls, h, pos)
        return _places(cls[met], pos[met], across[met])

    runs = exchange.resolved_runs(packed, bits, volume, space, again, ("<u4",), PACK)
    found = runs.groupBy("kind", "bucket").applyInArrow(go, "_class long, _at array<int>, _across long")
    return found.groupBy("_class").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_at")))).alias("_at"), F.sum("_across").alias("_across"))


def _grams(texts: DataFrame, bits: int) -> DataFrame:
    resolved = min(bits, exchange.TURN)

    def go(batches):
        hasher, packer, seen = Hasher(), Packer(bits, resolved), set()
        for batch in sliced(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                anchor, _, _, h = hasher.segments(text.as_py(), PASSAGE)
                packer.add(key, h, anchor)
                if packer.size >= PACK:
                    yield packer.flush()
        if packer.held:
            yield packer.flush()

    return texts.select("_class", "_bytes").mapInArrow(go, exchange.SCHEMA)


_REGION = "_class long, _from int, _data binary, _anchor array<int>, _first array<int>, _last array<int>, _hash array<long>"


def _regions(texts: DataFrame) -> DataFrame:
    """The stretches of texts (_class, _bytes, _at) around anchors at positions _at; anchors and windows relative to _from."""

    def go(batches):
        import numpy as np
        import pyarrow as pa

        hasher, seen = Hasher(), set()
        names = [x.split(" ")[0] for x in _REGION.split(", ")]
        for batch in sliced(batches):
            rows = []
            for key, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                data = text.as_py()
                anchor, first, last, h = hasher.segments(data)
                sel = np.flatnonzero(np.isin(anchor, at.values.to_numpy()))
                for part in np.split(sel, np.flatnonzero(np.diff(sel) != 1) + 1) if len(sel) else []:
                    lo, hi = int(first[part[0]]), int(last[part[-1]])
                    rows.append((key, lo, data[lo : hi + LENGTH], anchor[part] - lo, first[part] - lo, last[part] - lo, h[part]))
            lists = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (3, 4, 5)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), *lists, pa.array([r[6] for r in rows], pa.list_(pa.int64()))], names=names)

    return texts.select("_class", "_bytes", "_at").mapInArrow(go, _REGION)


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, at bytes of which are known to be."""
    end = min(len(a), len(b))
    while at < end and a[at : at + 32] == b[at : at + 32]:
        at += 32
    while at < end and a[at] == b[at]:
        at += 1
    return min(at, end)


class FrontCoded:
    """A sorted run of (suffix, class, position, flag), each suffix as shared prefix length and rest."""

    @staticmethod
    def encode(rows: list[tuple[bytes, int, int, int]]) -> bytes:
        import struct

        out, before = [], b""
        for s, key, pos, flag in rows:
            shared = common_prefix(before, s, 0)
            out += [struct.pack("<HHqIB", shared, len(s) - shared, key, pos, flag), s[shared:]]
            before = s
        return b"".join(out)

    @staticmethod
    def decode(raw: bytes):
        """(length shared with the suffix before, suffix, class, position, flag) in order."""
        import struct

        at, before, head = 0, b"", struct.Struct("<HHqIB")
        while at < len(raw):
            shared, more, key, pos, flag = head.unpack_from(raw, at)
            at += head.size
            before = before[:shared] + raw[at : at + more]
            at += more
            yield shared, before, key, pos, flag


def merged(runs: list):
    """Merges runs as decode() gives them: (length shared with the one before, suffix, class, position, flag).

    A loser tree: node i holds the loser of its match and the loser's common prefix with the
    winner. Both contenders of a match know their common prefix with the last output: if these
    differ, the longer one wins unseen; if not, the comparison begins behind it."""
    n = 1
    while n < len(runs):
        n *= 2
    streams = [iter(r) for r in runs] + [iter(())] * (n - len(runs))
    now = [next(s, None) for s in streams]
    known = [0] * n

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        if now[a] is None or now[b] is None:
            return (b, a) if now[a] is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = now[a][1], now[b][1]
        shared = common_prefix(x, y, known[a])
        if shared == len(x) or shared < len(y) and x[shared] <= y[shared]:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    loser, winners = [0] * n, [0] * n + list(range(n))
    for i in range(n - 1, 0, -1):
        winners[i], loser[i] = match(winners[2 * i], winners[2 * i + 1])
    top = winners[1]
    while now[top] is not None:
        yield (known[top], *now[top][1:])
        now[top] = next(streams[top], None)
        known[top] = now[top][0] if now[top] is not None else 0
        i = (top + n) // 2
        while i:
            top, loser[i] = match(top, loser[i])
            i //= 2


def _runs(regions: DataFrame, splitters: list[bytes]) -> DataFrame:
    """range, run: front-coded sorted suffixes at anchors. Of equal ones of a run the first stays,
    flagged; the rest are repeated for certain and come under a negative number, any other for each run."""

    def go(batches):
        import pyarrow as pa

        held = []

        def flush():
            held.sort()
            out, sure, k = {}, [], 0
            while k < len(held):
                s, key, pos = held[k]
                j = k + 1
                while j < len(held) and held[j][0] == s:
                    j += 1
                twins = sorted(set(x[1:] for x in held[k:j]))
                out.setdefault(bisect_right(splitters, s), []).append((s, key, pos, int(len(twins) > 1)))
                sure += [(b"", c, p, 1) for c, p in twins[1:]]
                k = j
            rows = [(r, FrontCoded.encode(x)) for r, x in out.items()] + ([(-1 - (sure[0][1] & 0x3FFFFFFF), FrontCoded.encode(sure))] if sure else [])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["range", "run"])

        for batch in sliced(batches):
            for key, lo, data, anchors in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held += [(data[a : a + LENGTH], key, lo + a) for a in anchors if a + LENGTH <= len(data)]
                if len(held) >= RUN:
                    yield flush()
        if held:
            yield flush()

    return regions.select("_class", "_from", "_data", "_anchor").mapInArrow(go, "range int, run binary")


def _repeated(runs: DataFrame) -> DataFrame:
    """_class, _pos: positions of suffixes that another place has too."""

    def go(group):
        import pyarrow as pa

        runs, out, same = group.column("run").to_pylist(), [], []
        if group.column("range")[0].as_py() < 0:
            out = [(key, pos) for r in runs for _, _, key, pos, _ in FrontCoded.decode(r)]
        else:

            def close():
                places = sorted({(key, pos) for key, pos, _ in same})
                if len(places) > 1 or any(flag for _, _, flag in same):
                    out.extend(places)
                same.clear()

            for shared, s, key, pos, flag in merged([FrontCoded.decode(r) for r in runs]):
                if same and shared < len(s):
                    close()
                same.append((key, pos, flag))
            close()
        return pa.table({"_class": pa.array([k for k, _ in out], pa.int64()), "_pos": pa.array([p for _, p in out], pa.int32())})

    return runs.groupBy("range").applyInArrow(go, "_class long, _pos int").groupBy("_class").agg(F.sort_array(F.collect_set("_pos")).alias("_at"))


def _splitters(regions: DataFrame, least: int) -> list[bytes]:
    """Beginnings of suffixes that cut all of them into ranges of about RANGE different ones, ``least`` ranges at least.

    Suffixes are chosen by the hash of their gram, of equal grams one, at a rate that gives about
    SAMPLE for each range: the driver sees SAMPLE * SPLITTER bytes for RANGE suffixes of LENGTH bytes."""
    total = regions.select(F.explode("_hash").alias("_h")).agg(F.approx_count_distinct("_h").alias("n")).first()["n"]
    n = max(least, -(-total // RANGE))
    rate = max(1, total // max(SAMPLE * n, LEAST_SAMPLE))

    def go(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            rows = {h: data[a : a + SPLITTER] for data, anchors, hs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for a, h in zip(anchors, hs, strict=True) if h % rate == 0}
            yield pa.RecordBatch.from_arrays([pa.array(rows.keys(), pa.int64()), pa.array(rows.values(), pa.binary())], names=["h", "s"])

    rows = regions.select("_data", "_anchor", "_hash").mapInArrow(go, "h long, s binary").groupBy("h").agg(F.min("s").alias("s"))
    sample = sorted({bytes(r["s"]) for r in rows.toLocalIterator()})
    return sorted({sample[k * len(sample) // n] for k in range(1, n)}) if sample else []


def _ends(regions: DataFrame) -> DataFrame:
    """_class, _pos, _hash, _flag: all anchors, flagged where their windows aren't enclosed by repeated ones. regions: with _at, the repeated positions."""

    def go(batches):
        import numpy as np
        import pyarrow as pa

        for batch in sliced(batches):
            out = []
            for row in batch.to_pylist():
                known = np.array(row["_at"] or [], np.int64) - row["_from"]
                anchor, first, last, h = (np.array(row[c], np.int64) for c in ("_anchor", "_first", "_last", "_hash"))
                far = np.int64(1 << 40)
                k = np.concatenate([[-far], known, [far]])
                before, after = k[np.searchsorted(k, first, "right") - 1], k[np.searchsorted(k, last)]
                out.append((np.full(len(h), row["_class"]), (anchor + row["_from"]).astype(np.int32), h, after - before > LENGTH))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(4)], names=["_class", "_pos", "_hash", "_flag"])

    return regions.drop("_data").mapInArrow(go, "_class long, _pos int, _hash long, _flag boolean")


def _windows(regions: DataFrame, bits: int) -> DataFrame:
    """Hashes of the windows of anchors at _at."""

    resolved = min(bits, exchange.TURN)

    def go(batches):
        import numpy as np

        hasher, packer = Hasher(), Packer(bits, resolved)
        for batch in sliced(batches):
            for row in batch.to_pylist():
                anchor, first, last = (np.array(row[c], np.int64) for c in ("_anchor", "_first", "_last"))
                raw = np.frombuffer(row["_data"], np.uint8)
                for k in np.flatnonzero(np.isin(anchor + row["_from"], row["_at"])):
                    lo, hi = first[k], last[k]
                    h = hasher.hashes(hasher.sums(raw[lo : hi + LENGTH]), LENGTH).view(np.int64)
                    packer.add(row["_class"], h, np.arange(lo, hi + 1) + row["_from"])
                if packer.size >= PACK:
                    yield packer.flush()
        if packer.held:
            yield packer.flush()

    return regions.select("_class", "_from", "_data", "_anchor", "_first", "_last", "_at").mapInArrow(go, exchange.SCHEMA)


def covered(positions: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows at these ascending positions cover."""
    out: list[tuple[int, int]] = []
    for p in positions:
        if out and p <= out[-1][1]:
            out[-1] = out[-1][0], p + LENGTH
        else:
            out.append((p, p + LENGTH))
    return out


def _cut(rows: DataFrame, kind: str) -> DataFrame:
    """_id, n_bytes, spans, kept, shared of rows (_id, _bytes, _copies, _at, _across)."""

    def go(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part in sliced(batches):
            n_bytes, spans, kept, shared = [], [], [], []
            for data, copies, at, across in zip(part.column(1), part.column(2).to_pylist(), part.column(3), part.column(4).to_pylist(), strict=True):
                data = data.as_py()
                found = [(0, len(data))] if copies > 1 and len(data) >= LENGTH else covered(at.as_py() or [])
                ends = [0, *[x for s in found for x in s], len(data)]
                n_bytes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in found])
                kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                shared.append(max(across or 0, int(copies > 1 and len(data) >= GRAM)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(shared, pa.int64())], names=["_id", "n_bytes", "spans", "kept", "shared"])

    return rows.select("_id", "_bytes", "_copies", "_at", "_across").mapInArrow(go, f"_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, shared long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_bytes, spans (removed runs of bytes, end exclusive), kept
    (the other bytes), shared (content-defined strings of GRAM bytes that other rows hold too).

    Null texts count as empty; texts of fewer than LENGTH bytes keep everything. Equal texts of
    at least LENGTH bytes repeat each other whole, and so do repeated rows. Strings are judged on
    the input, not on what is left, so no occurrence stays. shared removes nothing; it is above 0
    in every text that has a passage of PASSAGE bytes with another one, which may be too short to
    be removed, and counts some but not always all of their common strings. Other columns are ignored."""
    spark = docs.sparkSession
    space = Workspace(spark, "suffix")
    base = docs.select(F.col(id_col).alias("_id"), whole(text_col).cast("binary").alias("_bytes"))
    base, known_texts = text_classes(base, "_bytes", space)
    volume = known_texts.agg(F.sum("_bytes")).first()[0] or 0
    bits = exchange.bits_for(volume, BUCKET, LEAST_BUCKETS)
    anchors = space.save(meeting(_grams(base.filter(F.octet_length("_bytes") >= PASSAGE), bits), bits, volume, space), "anchors")

    def first_of_task(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            new = []
            for key in batch.column(0).to_pylist():
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    texts = base.filter(F.octet_length("_bytes") >= LENGTH).select("_class", "_bytes").mapInArrow(first_of_task, "_class long, _bytes binary")
    regions = space.save(_regions(texts.join(anchors, "_class")), "regions")
    splitters = _splitters(regions, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = space.save(_repeated(_runs(regions, splitters)), "known")
    ends = space.save(_ends(regions.join(known, "_class", "left")), "ends")
    # Written, so that adaptive execution can split the join on a hot gram.
    undecided = space.save(ends.filter("_flag").select("_hash").distinct(), "undecided")
    open_ = ends.join(undecided, "_hash", "left_semi").groupBy("_class").agg(F.sort_array(F.collect_set("_pos")).alias("_at"))
    more = space.save(meeting(_windows(regions.join(open_, "_class"), bits), bits, volume, space), "more").select("_class", "_at")
    space.drop("regions", "ends", "undecided")
    both = known.union(more).groupBy("_class").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("_at")))).alias("_at"))
    per = known_texts.select("_class", "_copies").join(both, "_class", "left").join(anchors.select("_class", "_across"), "_class", "left").withColumnRenamed("_class", "_c")
    # Written, so that nothing but the join stands above the exchange of a hot class, and adaptive execution can split it.
    per = space.save(per, "spans")
    space.keep("spans")
    return _cut(base.join(per, F.col("_class") == F.col("_c")), base.schema["_id"].dataType.simpleString()).withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("shared").alias("n_shared"))
