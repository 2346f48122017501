"""BPE encoding and decoding with forced-boundary splitting.

A merge can only join two neighbouring bytes if some vocabulary token holds them side by side.
Byte pairs that no token holds are therefore certain cuts: a pre-token is cut at each, the
fragments are encoded independently, and the ids are concatenated. Fragments are short even
where a text is one unbroken run, so the cost of a text follows its length.

The tokenizer file is a parameter: JSON of the tokenizers library with a BPE model with word
ends over byte-level symbols, NFC and lower case. Each task builds its own tables from it and
shuffles nothing.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import per_text, table

#: Words, pre-tokens and fragments longer than this, and more of each than this, aren't cached.
LONGEST, CACHED = 64, 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [self.names[i].encode() for i in range(max(self.names) + 1)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: The merges of a fragment inside a pre-token, and of one that closes it.
        self.inner = models.BPE(vocab=vocab, merges=merges)
        self.closing = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.suffix)
        self.symbol = byte_symbols()
        self.byte = byte = {c: b for b, c in enumerate(self.symbol)}
        held = {(byte[a], byte[b]) for t in vocab for s in [t.removesuffix(self.suffix)] for a, b in zip(s, s[1:], strict=False)}
        #: For each byte, the bytes that may follow it inside a token.
        self.follows = [frozenset(b for b in range(256) if (a, b) in held) for a in range(256)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pre = regex.compile(pattern.replace("\\s", "\\p{White_Space}"))
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.fragments: dict[tuple[bytes, bool], bytes] = {}
        self.tokens_of: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the caches; the tables stay."""
        for cache in (self.fragments, self.tokens_of, self.cache):
            cache.clear()

    def cuts(self, data: bytes) -> list[int]:
        """Where a token certainly ends inside data, with both ends."""
        follows = self.follows
        return [0, *[i + 1 for i in range(len(data) - 1) if data[i + 1] not in follows[data[i]]], len(data)]

    def pre_token(self, token: str) -> bytes:
        """Ids, four bytes each: those of the fragments, one after the other."""
        if (out := self.tokens_of.get(token)) is not None:
            return out
        data, out = token.encode("utf-8", "surrogateescape"), b""
        at = self.cuts(data)
        for lo, hi in zip(at, at[1:], strict=False):
            key = data[lo:hi], hi == len(data)
            if (ids := self.fragments.get(key)) is None:
                model = self.closing if key[1] else self.inner
                found = [x.id for x in model.tokenize("".join([self.symbol[b] for b in key[0]]))]
                ids = struct.pack(f"<{len(found)}I", *found)
                if hi - lo <= LONGEST:
                    if len(self.fragments) >= CACHED:
                        self.fragments.clear()
                    self.fragments[key] = ids
            out += ids
        if len(token) <= LONGEST:
            if len(self.tokens_of) >= CACHED:
                self.tokens_of.clear()
            self.tokens_of[token] = out
        return out

    def run(self, text: str) -> bytes:
        """Ids, four bytes each, of a text without white space or special tokens."""
        if (got := self.cache.get(text)) is not None:
            return got
        if _LATIN.fullmatch(text):
            plain = unicodedata.normalize("NFC", text).lower()
            pieces = (plain,) if plain.isalpha() else self.pre.findall(plain)
        else:  # what a character is depends on the version of Unicode: the library's own counts
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            pieces = [bytes([self.byte[c] for c in symbols]).decode("utf-8", "surrogateescape") for symbols, _ in found]
        out = b"".join([self.pre_token(t) for t in pieces])
        if len(text) <= LONGEST:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[text] = out
        return out

    def encode(self, text: str) -> bytes:
        parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        get, run, out = self.cache.get, self.run, []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            # White space never composes with what follows and is dropped, so runs without it are independent.
            runs = part.split() if not _ODD.search(part) else _SPACE.split(part)
            out += [x if (x := get(w)) is not None else run(w) for w in runs]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        import numpy as np

        tokens = self.tokens
        return b" ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode()


#: Characters that str.split() takes for white space and Unicode doesn't.
_ODD, _SPACE = re.compile("[\x1c-\x1f]"), re.compile("[^\\S\x1c-\x1f]+")
#: Characters that all versions of Unicode agree about: Basic Latin to Latin Extended-B.
_LATIN = re.compile("[\x00-\u024f]*")


@functools.lru_cache(1)
def codec(path: str) -> Codec:
    """One for each Python worker, whatever the number of its tasks."""
    return Codec(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, ids (the token ids as little-endian 32-bit integers), as the
    tokenizers library gives them with add_special_tokens=False.

    Null and empty texts, and those of white space alone, have no ids; strings of special tokens
    in a text are those tokens. Repeated rows each get their row; other columns are ignored."""

    def make():
        import pyarrow as pa

        encode = codec(path).encode
        return lambda texts: [pa.array([encode(t) for t in texts], pa.binary())]

    return per_text(docs, id_col, text_col, make, "ids binary", done=lambda: codec(path).forget())


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds text: what the library's decode(ids, skip_special_tokens=False) gives for ids of
    bpe_encode; with no decoder in the file, the tokens joined by blanks."""

    def run(batches):
        import pyarrow as pa

        decode = codec(path).decode
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([decode(x or b"") for x in part.column(1).to_pylist()], pa.string())], names=["_id", "_ids", "_text"])

    source = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    kind = source.schema["_id"].dataType.simpleString()
    out = source.mapInArrow(run, f"_id {kind}, _ids binary, _text string")
    return out.select(F.col("_id").alias(id_col), F.col("_ids").alias(ids_col), F.col("_text").alias("text"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    both = bpe_decode(bpe_encode(docs, path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
