"""Exact n-gram Jaccard join with signature trees.

1. Tokens are hashes of word 5-grams. Every task packs the tokens of its distinct texts into
   binary rows for the buckets of the token space (exchange.py); a bucket finds which tokens more
   than one text holds and sends only those back. What several texts of a task hold is settled
   there and travels on once, so a common token is no hot key. A text that shares fewer than 3/4 of its tokens with
   anything can't have a partner. So common passages alone, however frequent, lead nowhere.
2. Of the remaining texts those that share a token of their prefix can be similar (prefix filter
   at 3/4, exact). The texts of each such block first meet a pivot, and the links that the
   full sets confirm are joined to components: a group of near copies of any size collapses in
   time linear in its size.
3. Where texts of a block are still in different components, a signature tree finds the rest:
   leaves hold texts in order of size, nodes the OR of the token bitmaps, the AND, and the size
   range. A dual traversal drops node pairs whose maximum possible overlap is too small or which
   are one component already. The pairs that survive are compared by the sets that their texts
   carry; of the links only those that join something new leave the block, so it returns no more
   rows than it has texts. Texts too long to carry their sets leave as pairs. Full sets confirm.
4. Links are counted once the components are known, as every link lies within one: the sets of a
   component's texts come together once and not once for each prefix token, each pair is compared
   in one task, and what leaves a task is a count for each text.

Exact copies are one class from the start, verified by a second hash. A block of more than BLOCK texts is split, and the
parts meet pairwise in tasks of their own. Tokens are 48 bits within a bucket of the token
space, so two texts of a thousand tokens agree by accident in a token once in 10^8 or more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from ._common import Workspace, give_back, table, text_classes, whole
from .components import further

#: Words of an n-gram, and the least similarity in hundredths.
WORDS, LEAST = 5, 75
#: Bytes of text for a bucket of the token space, and buckets at least; pivots of a block that is spread over keys, and turns of pivots.
BUCKET, LEAST_BUCKETS, PIVOTS, TURNS = 8 << 20, 64, 4, 2
#: Node pairs of a traversal looked at together.
SLICE = 8192
#: Tokens that a task packs at once, bytes of a token within its bucket, bits of a signature, texts of a tree, children of a node.
PACK, WIDTH, BITS, BLOCK, FAN = 350_000, 6, 8192, 768, 8
#: Shared tokens up to which a text carries its set into its blocks; a longer one carries its bitmap only.
CARRIED = 1024
#: Tokens of the texts of a component that are met at once; a larger component is split.
MET = 2 << 20


class Shingler:
    """Word n-gram hashes of a text."""

    def __init__(self, n: int = WORDS):
        import numpy as np

        self.n, self.known = n, {}
        self.factor = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(n)], np.uint64)

    def tokens(self, text: str):
        """Sorted distinct tokens: all n-grams, or the whole sequence where it is shorter."""
        import numpy as np
        import xxhash

        words = text.encode("utf-8", "replace").lower().split()  # of bytes: only ASCII letters and white space
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 100_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k, m = min(self.n, len(words)), max(1, len(words) - self.n + 1)
        out = np.full(m, k, np.uint64)
        for j in range(k):
            out += h[j : j + m] * self.factor[j]
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(29)
        return np.unique(out)


def _parts(cls, size, tok, bits: int):
    """home, part: of classes at their home buckets. A part is: d class keys, set sizes (0 where not known here) and counts of tokens; the tokens, eight bytes each.

    cls and size have a row for each class, tok the sorted (place in cls, token) arrays."""
    import numpy as np

    of, token = tok
    to = cls & np.int64((1 << bits) - 1)
    lo, hi = np.searchsorted(of, np.arange(len(cls))), np.searchsorted(of, np.arange(len(cls)), "right")
    order = np.argsort(to, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(to[order])) + 1, [len(order)]]) if len(order) else []
    homes, parts = [], []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = order[a:b]
        homes.append(int(to[own[0]]))
        tokens = np.concatenate([token[lo[k] : hi[k]] for k in own])
        parts.append(np.int64(len(own)).tobytes() + cls[own].tobytes() + size[own].astype("<u4").tobytes() + (hi - lo)[own].astype("<u4").tobytes() + tokens.astype("<i8").tobytes())
    return homes, parts


def _collapsed(cls, tok):
    """sent, shared: entries that must travel, one of each token, and entries whose token another class here holds too. cls and tok have no pair twice."""
    import numpy as np

    order = np.argsort(tok, kind="stable")
    new = np.ones(len(tok), bool)
    new[1:] = tok[order][1:] != tok[order][:-1]
    of = np.cumsum(new) - 1
    sent, shared = np.zeros(len(tok), bool), np.zeros(len(tok), bool)
    sent[order[new]] = True
    shared[order[np.bincount(of)[of] > 1]] = True
    return sent, shared


def _token(tok, bits: int):
    """A token as texts keep it: the bits that buckets compare."""
    import numpy as np

    return (tok & np.uint64((1 << min(64, 48 + bits)) - 1)).view(np.int64)


def _again(bits: int):
    """Packs entries that have met in a round: a token of several classes travels on once."""

    def go(cls, tok, _, resolved: int):
        import numpy as np

        order = np.lexsort((tok, cls))
        cls, tok = cls[order], tok[order]
        new = np.ones(len(cls), bool)
        new[1:] = (cls[1:] != cls[:-1]) | (tok[1:] != tok[:-1])
        cls, tok = cls[new], tok[new]
        sent, shared = _collapsed(cls, tok)
        own, of = np.unique(cls[shared], return_inverse=True)
        return exchange.batch(exchange.pack(cls[sent], tok[sent], [], bits, resolved, WIDTH), _parts(own, np.zeros(len(own), np.int64), (of, _token(tok[shared], bits)), bits))

    return go


def packed(docs: DataFrame, bits: int) -> DataFrame:
    """kind, bucket, run: for texts of a task (each class once) the tokens that fall into the bucket (kind 0), and the sizes of their sets at home (kind 1).

    A token that several texts of one flush hold is shared for certain: the texts get it in their
    parts at once, and it travels on as one text's. So a token that a third of all texts hold
    meets in its bucket as one entry for each flush."""

    resolved = min(bits, exchange.TURN)

    def go(batches):
        import numpy as np

        shingler, seen, held, count = Shingler(), set(), [], 0

        def flush():
            key = np.array([c for c, _ in held], np.int64)
            size = np.array([len(t) for _, t in held], np.int64)
            doc = np.repeat(np.arange(len(held)), size)
            tok = np.concatenate([t for _, t in held])
            sent, shared = _collapsed(doc, tok)
            return exchange.batch(exchange.pack(key[doc[sent]], tok[sent], [], bits, resolved, WIDTH), _parts(key, size, (doc[shared], _token(tok[shared], bits)), bits))

        for batch in batches:
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if c in seen:
                    continue
                seen.add(c)
                held.append((c, t := shingler.tokens(text.as_py())))
                count += len(t) + 1
                if count >= PACK:
                    yield flush()
                    held, count = [], 0
                    give_back()
        if held:
            yield flush()
        shingler.known.clear()
        held.clear()
        give_back()

    return docs.select("_class", "_text").mapInArrow(go, exchange.SCHEMA)


def _shared(runs: DataFrame, bits: int) -> DataFrame:
    """home, part: of each bucket the classes' tokens that another class holds too, packed by home, and what came for the homes before."""

    def go(group):
        import numpy as np
        import pyarrow as pa

        if group.column("kind")[0].as_py():
            return pa.table({"home": group.column("bucket"), "part": group.column("run")})
        cls, tok = exchange.unpack(group.column("run"), group.column("bucket")[0].as_py(), (), bits, WIDTH)
        order = np.lexsort((cls, tok))
        cls, tok = cls[order], tok[order]
        del order
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])  # a class that several tasks had
        cls, tok = cls[new], tok[new]
        of = np.cumsum(np.concatenate([[True], tok[1:] != tok[:-1]])) - 1
        common = np.bincount(of)[of] > 1
        cls, tok = cls[common], tok[common]
        key, of = np.unique(cls, return_inverse=True)
        order = np.argsort(of, kind="stable")
        homes, parts = _parts(key, np.zeros(len(key), np.int64), (of[order], _token(tok[order], bits)), bits)
        give_back()
        return pa.table({"home": pa.array(homes, pa.int32()), "part": pa.array(parts, pa.binary())})

    return runs.groupBy("kind", "bucket").applyInArrow(go, "home int, part binary")


def _classes(parts: DataFrame) -> DataFrame:
    """_class, _size, _tokens: every class, with its shared tokens in order if they are enough for a partner, else null."""

    def go(group):
        import numpy as np
        import pyarrow as pa

        found = []
        for part in group.column("part"):
            raw = part.as_buffer()
            d = int(np.frombuffer(raw, "<i8", 1)[0])
            n = np.frombuffer(raw, "<u4", d, 8 + 12 * d)
            found.append((np.frombuffer(raw, "<i8", d, 8), np.frombuffer(raw, "<u4", d, 8 + 8 * d), np.repeat(np.frombuffer(raw, "<i8", d, 8), n), np.frombuffer(raw, "<i8", int(n.sum()), 8 + 16 * d)))
        key, size, cls, tok = (np.concatenate([p[k] for p in found]) for k in range(4))
        found.clear()
        order = np.lexsort((tok, cls))
        cls, tok = cls[order], tok[order]
        new = np.ones(len(cls), bool)
        new[1:] = (cls[1:] != cls[:-1]) | (tok[1:] != tok[:-1])  # known from several places
        cls, tok = cls[new], tok[new]
        order = np.lexsort((size, key))
        key, size = key[order], size[order].astype(np.int64)
        last = np.concatenate([key[1:] != key[:-1], [True]])  # the known size is the largest
        key, size = key[last], size[last]
        lo = np.searchsorted(cls, key)
        n = np.searchsorted(cls, key, "right") - lo
        keep = (size > 0) & (100 * n >= LEAST * size)
        mask = keep[np.searchsorted(key, cls)] if len(cls) else np.empty(0, bool)
        offsets = np.concatenate([[0], np.cumsum(np.where(keep, n, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tok[mask]), mask=pa.array(~keep))
        give_back()
        return pa.table({"_class": pa.array(key), "_size": pa.array(size), "_tokens": lists})

    return parts.groupBy("home").applyInArrow(go, "_class long, _size long, _tokens array<long>")


def needed(size):
    """The least overlap of a set of this size with any partner."""
    return F.ceil(size * LEAST / 100.0).cast("long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar. Tokens that no other text holds count in the sizes only."""
    side = lambda x: sets.select(F.col("_class").alias(x), F.col("_size").alias(f"{x}_n"), F.col("_tokens").alias(f"{x}_t"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("a_t", "b_t"))
    return met.select("a", "b", both.alias("_o"), "a_n", "b_n").filter(f"100 * _o >= {LEAST} * (a_n + b_n - _o)").select("a", "b")


def dual_traversal(size, bits, label):
    """Pairs of positions that may be similar and are of different labels, by a signature tree.

    size, bits (a row of bytes for each text) and label are arrays; texts are leaves in order of
    size. For nodes P and Q no text of P overlaps one of Q in more tokens than its size less the
    bits that all of P have and none of Q has; the same the other way round."""
    import numpy as np

    order = np.lexsort((label, size))
    n, label = len(order), label[order]
    levels = [(size[order], size[order], bits[order], bits[order], label, label)]
    while len(levels[-1][0]) > 1:
        lo, hi, any_, all_, first, last = levels[-1]
        cut = np.arange(0, len(lo), FAN)
        levels.append((np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.bitwise_or.reduceat(any_, cut, axis=0), np.bitwise_and.reduceat(all_, cut, axis=0), np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)))
    p = q = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        lo, hi, any_, all_, first, last = levels[depth]
        alive = []
        for at in range(0, len(p), SLICE):
            a, b = p[at : at + SLICE], q[at : at + SLICE]
            ok = ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))
            ok &= (100 * hi[a] >= LEAST * lo[b]) & (100 * hi[b] >= LEAST * lo[a])
            a, b = a[ok], b[ok]
            most = np.minimum(hi[a] - np.bitwise_count(all_[a] & ~any_[b]).sum(axis=1), hi[b] - np.bitwise_count(all_[b] & ~any_[a]).sum(axis=1))
            ok = (100 + LEAST) * most >= LEAST * (lo[a] + lo[b])
            alive.append((a[ok], b[ok]))
        p, q = (np.concatenate([x[k] for x in alive]) for k in (0, 1)) if alive else (p[:0], q[:0])
        if depth:
            width = len(levels[depth - 1][0])
            a, b = np.repeat(p, FAN * FAN) * FAN + np.tile(np.repeat(np.arange(FAN), FAN), len(p)), np.repeat(q, FAN * FAN) * FAN + np.tile(np.arange(FAN), len(p) * FAN)
            ok = (a < width) & (b < width) & (a <= b)
            p, q = a[ok], b[ok]
    ok = p != q
    return order[p[ok]], order[q[ok]]


def _forest(a, b, flat, n, size, label, key):
    """Of the candidate pairs (a, b) links that join what all links of this block would join.

    flat has the tokens of all texts in a row, n their counts. A pair with a lesser prefix token
    in common is left to the block of that token."""
    import numpy as np

    if not len(a):
        return np.empty((0, 2), np.int64)
    ids = np.unique(flat, return_inverse=True)[1]
    start = np.cumsum(n) - n
    early = (np.arange(len(flat)) - np.repeat(start, n) < np.repeat(n + (-LEAST * size // 100) + 1, n)) & (flat < key)
    holds, holds_early = np.zeros(len(ids) + 1, bool), np.zeros(len(ids) + 1, bool)
    label = np.unique(label, return_inverse=True)[1]
    order = np.argsort(a, kind="stable")
    a, b, out = a[order], b[order], []
    cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    for lo, hi in zip(cut, [*cut[1:], len(a)], strict=True):
        x, y = a[lo], b[lo:hi]
        y = y[label[y] != label[x]]
        if not len(y):
            continue
        mine = slice(start[x], start[x] + n[x])
        holds[ids[mine]] = True
        holds_early[ids[mine][early[mine]]] = True
        ends = np.cumsum(n[y])
        at = np.repeat(start[y] - (ends - n[y]), n[y]) + np.arange(ends[-1])
        both = np.add.reduceat(holds[ids[at]].astype(np.int64), ends - n[y])
        before = np.logical_or.reduceat(holds_early[ids[at]] & early[at], ends - n[y])
        holds[ids[mine]] = holds_early[ids[mine]] = False
        for z in y[(100 * both >= LEAST * (size[x] + size[y] - both)) & ~before]:
            if label[z] != label[x]:
                out.append((x, z))
                label[label == label[z]] = label[x]
    return np.array(out, np.int64).reshape(-1, 2)


def _tree_pairs(rows: DataFrame) -> DataFrame:
    """a, b: what a block's signature tree leaves. rows: _key, _i, _j, _part, _class, _size, _set, _bits, _root.

    Texts that carry their sets are compared here, and only links that join something new leave: no
    more rows than the block has texts. Pairs with a longer text leave as the tree finds them."""

    def go(group):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cls, part, size, root = (group.column(c).to_numpy() for c in ("_class", "_part", "_size", "_root"))
        sets = group.column("_set")
        n, flat = pc.fill_null(pc.list_value_length(sets), 0).to_numpy().astype(np.int64), pc.list_flatten(sets).to_numpy()
        bits = bitmaps(flat, n)
        carried = n > 0
        if not carried.all():
            bits[~carried] = np.frombuffer(b"".join(group.column("_bits").drop_null().to_pylist()), np.uint64).reshape(-1, BITS // 64)
        a, b = dual_traversal(size, bits, root)
        if group.column("_i")[0] != group.column("_j")[0]:
            across = part[a] != part[b]
            a, b = a[across], b[across]
        here = carried[a] & carried[b]
        links = _forest(a[here], b[here], flat, n, size, root, group.column("_key")[0].as_py())
        a, b = np.concatenate([links[:, 0], a[~here]]), np.concatenate([links[:, 1], b[~here]])
        return pa.table({"a": np.maximum(cls[a], cls[b]), "b": np.minimum(cls[a], cls[b])})

    return rows.groupBy("_key", "_i", "_j").applyInArrow(go, "a long, b long")


def bitmaps(flat, n):
    """A row of BITS bits for each text; flat has the tokens of all, n their counts."""
    import numpy as np

    out, ends = np.zeros((len(n), BITS // 64), np.uint64), np.cumsum(n)
    for lo in range(0, len(n), 256):
        many = n[lo : lo + 256]
        x = np.zeros((len(many), BITS), np.uint8)
        x[np.repeat(np.arange(len(many)), many), (flat[ends[lo] - n[lo] : ends[lo + len(many) - 1]] >> 11) % BITS] = 1
        out[lo : lo + 256] = np.packbits(x, axis=1).view(np.uint64)
    return out


def _signatures(sets: DataFrame) -> DataFrame:
    """_class and what it carries into its blocks: _set, or else _bits, the bitmap of a longer set."""

    def go(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            carried = [len(t.values) <= CARRIED for t in batch.column(1)]
            bits = [None if c else bitmaps(t.values.to_numpy(), np.array([len(t.values)]))[0].tobytes() for c, t in zip(carried, batch.column(1), strict=True)]
            held = [t.values.to_numpy() if c else None for c, t in zip(carried, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["_class", "_set", "_bits"])

    return sets.select("_class", "_tokens").mapInArrow(go, "_class long, _set array<long>, _bits binary")


def _roots(sets: DataFrame, space: Workspace) -> DataFrame:
    """_v, root: the component of every class that links to another; root itself has no row."""
    prefix = sets.select("_class", "_size", F.explode(F.slice("_tokens", F.lit(1), (F.size("_tokens") - needed(F.col("_size")) + 1).cast("int"))).alias("_key"))
    keys = space.save(prefix, "keys")
    # Round one: each block's texts meet its pivots.
    known, roots = None, None
    for turn in range(TURNS):
        now = keys if roots is None else keys.join(roots, F.col("_class") == F.col("_v"), "left").withColumn("_root", F.coalesce("root", "_class")).drop("_v", "root")
        rank = F.xxhash64("_class", F.pmod("_key", F.lit(PIVOTS)), F.lit(turn))
        best = F.min(F.struct(rank.alias("r"), F.col("_class").alias("c"), F.col("_size").alias("n"), (F.col("_class") if roots is None else F.col("_root")).alias("l")))
        pivot = now.groupBy("_key").agg(best.alias("_p"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_key").alias("_k"), F.col("_p.c").alias("_pivot"), F.col("_p.n").alias("_m"), F.col("_p.l").alias("_l"))
        met = now.join(pivot, F.col("_key") == F.col("_k")).filter(f"_class != _pivot AND 100 * _size >= {LEAST} * _m AND 100 * _m >= {LEAST} * _size")
        met = met if roots is None else met.filter("_root != _l")
        pairs = met.select(F.greatest("_class", "_pivot").alias("a"), F.least("_class", "_pivot").alias("b")).distinct()
        known = further(known, space.save(confirmed(pairs, sets), f"edges{turn}"), space, f"turn{turn}_")
        roots = known.withColumnRenamed("v", "_v")
    # Round two: blocks that are not one component yet.
    labelled = keys.join(roots, F.col("_class") == F.col("_v"), "left").select("_key", "_class", "_size", F.coalesce("root", "_class").alias("_root"))
    labelled = space.save(labelled, "labelled")
    mixed = labelled.groupBy("_key").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("_class")).alias("_x"), F.bit_xor(F.xxhash64("_class", F.lit(1))).alias("_y")).filter("_lo != _hi")
    mixed = mixed.groupBy("_n", "_x", "_y").agg(F.min("_key").alias("_key"))  # blocks of the same texts are one
    mixed = mixed.select(F.col("_key").alias("_k"), F.ceil(F.col("_n") / BLOCK).cast("int").alias("_parts"))
    blocks = labelled.join(mixed, F.col("_key") == F.col("_k")).drop("_k").withColumn("_part", F.pmod(F.hash("_class"), F.col("_parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    blocks = blocks.withColumn("_o", other).withColumn("_i", F.least("_part", "_o")).withColumn("_j", F.greatest("_part", "_o"))
    blocks = blocks.join(_signatures(sets), "_class").select("_key", "_i", "_j", "_part", "_class", "_size", "_set", "_bits", "_root")
    more = space.save(confirmed(_tree_pairs(blocks).distinct(), sets), "rest")
    return further(known, more, space, "last").withColumnRenamed("v", "_v")


def _met(rows: DataFrame, pairs: bool) -> DataFrame:
    """Of all pairs of a component's texts those that are similar: _class and _links, the copies of its partners met here, or the pairs a, b.

    rows: _at, _parts, _i, _j, _root, _part, _class, _size, _copies, _tokens. Texts are compared in
    order of size, each with the range of sizes that can be similar."""

    def go(group):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cls, root, part, size, copies = (group.column(c).to_numpy() for c in ("_class", "_root", "_part", "_size", "_copies"))
        sets = group.column("_tokens").combine_chunks()
        n = pc.list_value_length(sets).to_numpy().astype(np.int64)
        flat, begin, links = pc.list_flatten(sets).to_numpy(), np.cumsum(n) - n, np.zeros(len(cls), np.int64)
        i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
        order, a, b = np.lexsort((size, root)), [], []
        cut = np.flatnonzero(np.concatenate([[True], root[order][1:] != root[order][:-1], [True]]))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            own = order[lo:hi]
            left, right = (own, own) if i == j else (own[part[own] == i], own[part[own] == j])
            if not len(left) or not len(right):
                continue
            ends = np.cumsum(n[own])
            ids = np.unique(flat[np.repeat(begin[own] - (ends - n[own]), n[own]) + np.arange(ends[-1])], return_inverse=True)[1]
            holds, of = np.zeros(ids.max() + 1, bool), dict(zip(own.tolist(), (ends - n[own]).tolist(), strict=True))
            met = ids if i == j else np.concatenate([ids[of[y] : of[y] + n[y]] for y in right.tolist()])
            at, sizes = np.concatenate([[0], np.cumsum(n[right])]), size[right]
            first = np.searchsorted(100 * sizes, LEAST * size[left])
            last = np.searchsorted(LEAST * sizes, 100 * size[left], "right")
            if i == j:
                first = np.arange(1, len(own) + 1)
            for k, x in enumerate(left.tolist()):
                if first[k] >= last[k]:
                    continue
                y, mine = right[first[k] : last[k]], ids[of[x] : of[x] + n[x]]
                holds[mine] = True
                both = np.add.reduceat(holds[met[at[first[k]] : at[last[k]]]].view(np.int8), at[first[k] : last[k]] - at[first[k]], dtype=np.int64)
                holds[mine] = False
                y = y[100 * both >= LEAST * (size[x] + size[y] - both)]
                if pairs:
                    a.append(np.full(len(y), cls[x]))
                    b.append(cls[y])
                else:
                    links[x] += copies[y].sum()
                    links[y] += copies[x]
        give_back()
        if pairs:
            a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
            return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})
        return pa.table({"_class": cls[links > 0], "_links": links[links > 0]})

    return rows.groupBy("_at", "_parts", "_i", "_j").applyInArrow(go, "a long, b long" if pairs else "_class long, _links long")


class Joined:
    """The classes of equal texts of docs and their components."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.id_col, self.space = id_col, Workspace(docs.sparkSession, "ngram")
        base = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
        self.base, self.texts = text_classes(base, "_text", self.space)
        volume = self.texts.agg(F.sum("_bytes")).first()[0] or 0
        bits = exchange.bits_for(volume, BUCKET, LEAST_BUCKETS)
        self.n_buckets = 1 << bits
        runs = exchange.resolved_runs(packed(self.base, bits), bits, volume, self.space, _again(bits))
        self.classes = self.space.save(_classes(_shared(runs, bits)), "classes")
        self.sets = self.classes.filter("_tokens IS NOT NULL")
        self.roots = _roots(self.sets, self.space)
        self.copies = self.texts.select("_class", "_copies")

    def met(self, pairs: bool) -> DataFrame:
        """The links of different texts: counts or pairs, see _met. Every two parts of a component meet in one task; small components share tasks."""
        own = self.sets.select("_class", F.size("_tokens").alias("_t")).join(self.roots, F.col("_class") == F.col("_v"), "left").select("_class", "_t", F.coalesce("root", "_class").alias("_root"))
        parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("_t") / MET)).cast("int")
        groups = own.groupBy(F.col("_root").alias("_r")).agg(parts.alias("_parts"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        own = own.join(groups, F.col("_root") == F.col("_r"))
        own = own.withColumn("_at", F.when(F.col("_parts") > 1, F.col("_root")).otherwise(F.pmod(F.xxhash64("_root"), F.lit(self.n_buckets))))
        own = own.withColumn("_part", F.pmod(F.xxhash64("_class"), F.col("_parts")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        own = own.withColumn("_i", F.least("_part", "_o")).withColumn("_j", F.greatest("_part", "_o"))
        own = own.join(self.copies.withColumnRenamed("_class", "_c"), F.col("_class") == F.col("_c")).select("_at", "_parts", "_i", "_j", "_root", "_part", "_class", "_copies")
        return self.space.save(_met(own.join(self.sets, "_class"), pairs), "pairs" if pairs else "links")

    def named(self, links: bool) -> DataFrame:
        """The rows of docs with their components, and the numbers of their links if asked for."""
        of = self.classes.select(F.col("_class").alias("_c"), "_size").join(self.texts, F.col("_c") == F.col("_class")).drop("_class", "_bytes")
        if links:
            others = self.met(pairs=False).groupBy(F.col("_class").alias("_k")).agg(F.sum("_links").alias("_links"))
            count = F.when(F.col("_size") == 0, 0).otherwise(F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1)
            of = of.join(others, F.col("_c") == F.col("_k"), "left").withColumn("n_links", count.cast("long"))
        more = ["n_links"] if links else []
        of = of.join(self.roots, F.col("_c") == F.col("_v"), "left").select("_c", "_size", "_least", *more, F.coalesce("root", "_c").alias("_root"))
        of = self.space.save(of, "rooted")
        name = self.space.save(of.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("_name")), "names")
        # Written first, so that nothing but a join stands above the exchange of a hot class or component, and adaptive execution can split it.
        named = self.space.save(of.join(name, F.col("_root") == F.col("_r")).select("_c", "_size", "_name", *more), "named")
        self.space.keep("named")
        out = self.base.select("_id", "_class").join(named, F.col("_class") == F.col("_c"))
        return out.select(F.col("_id").alias(self.id_col), F.col("_size").alias("n_shingles"), F.when(F.col("_size") == 0, F.col("_id")).otherwise(F.col("_name")).alias("component_id"), *more)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the least id that links reach).

    Texts link when the Jaccard similarity of their sets of word 5-grams is LEAST hundredths or
    more; a text of fewer words is one gram. Texts without words have empty sets, link to
    nothing and are their own component. Null texts count as empty. Null ids are reached, but
    never name a component unless it has no other. Repeated rows are equal texts and so one
    component. Other columns are ignored."""
    return Joined(docs, id_col, text_col).named(links=False)


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of similar_groups with n_links: how many other rows of docs are similar to the row.

    Rows of equal text link to each other and count one by one; a text without words has no
    links. Nothing is left out: a group of n copies or near copies gives each of them n - 1."""
    return Joined(docs, id_col, text_col).named(links=True)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b: the ids of every two rows of different texts that are similar, each pair once.

    There are as many as the links between different texts; equal texts, whose number grows with
    the square of their copies, are those that exact_dedup groups."""
    j = Joined(docs, id_col, text_col)
    side = lambda x: j.base.select(F.col("_class").alias(f"_{x}"), F.col("_id").alias(x))
    return j.met(pairs=True).toDF("_a", "_b").join(side("a"), "_a").join(side("b"), "_b").select("a", "b")


def query(spark, sf_dir: str) -> DataFrame:
    return similar_links(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) < {WORDS} THEN list_filter([array_to_string(ws, ' ')], lambda x: x <> '')
             ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' ')) END) AS g FROM w),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS o FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * o >= {LEAST} * (n + m - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
k AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id),
c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, k.component_id, coalesce(c.n_links, 0) AS n_links
FROM s JOIN k ON k.doc_id = s.doc_id LEFT JOIN c ON c.a = s.doc_id
"""
