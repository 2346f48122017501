"""Token counts under a unigram model, by trie-shared dynamic programming.

The distinct pre-tokens that a worker meets go into a trie. Each trie node is one prefix and holds
the forward (Viterbi) score of that prefix and its number of tokens, computed once however many
pre-tokens share it; terminals store the counts, and a text's count is their sum. Each worker has
its own trie, emptied when it reaches a bounded number of nodes, so nothing is shuffled.

The pieces come from a SentencePiece file (a parameter). Their log-probability follows their
rank in that file by Zipf's law; characters without a piece fall back to UTF-8 bytes.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame

from ._common import WHITE, per_text, table

#: Nodes of a worker's trie before it is emptied, terminals that outlive that, and the longest pre-token that goes into it.
NODES, TERMINALS, LONGEST = 600_000, 800_000, 96
#: Log-probability of a byte of a character that no piece holds.
BYTE_SCORE = -25.0


def pieces(path: str) -> dict[str, float]:
    """Piece to log-probability: p proportional to 1 / rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and sp.get_score(i) > -1e8]
    total = math.log(sum(1 / r for r in range(1, len(own) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(own, 1)}


class Trie:
    def __init__(self, scores: dict[str, float]):
        #: Every suffix of a piece; the score where it is itself one.
        self.ends = {p[k:]: None for p in scores for k in range(1, len(p))} | scores
        self.clear()

    def clear(self) -> None:
        """Forgets prefixes; the counts of whole pre-tokens stay until they are too many."""
        if len(getattr(self, "terminal", ())) > TERMINALS or not hasattr(self, "terminal"):
            self.terminal: dict[str, int] = {}
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def step(self, word: str, end: int, best: list[float], count: list[int]) -> tuple[float, int]:
        """Forward score and tokens of word[:end], from those of all shorter prefixes; of equal scores the fewer tokens."""
        get = self.ends.get
        s = get(word[end - 1])
        if s is not None:
            top, n = best[end - 1] + s, count[end - 1] + 1
        else:  # bytes: never better than a piece of one character
            size = len(word[end - 1].encode("utf-8", "replace"))
            top, n = best[end - 1] + size * BYTE_SCORE, count[end - 1] + size
        for start in range(end - 2, -1, -1):
            if (s := get(word[start:end], 0)) == 0:
                break  # no piece that ends here is longer
            if s is not None and ((x := best[start] + s) > top or x == top and count[start] < n - 1):
                top, n = x, count[start] + 1
        return top, n

    def tokens(self, word: str) -> int:
        """Tokens of the best segmentation of a pre-token; new prefixes become nodes."""
        if (n := self.terminal.get(word)) is not None:
            return n
        best, count, node, shared = [0.0], [0], 0, len(word) <= LONGEST
        for end in range(1, len(word) + 1):
            key = (node, word[end - 1])
            node = self.child.get(key, -1) if shared and node >= 0 else -1
            if node >= 0:
                best.append(self.best[node])
                count.append(self.count[node])
                continue
            b, c = self.step(word, end, best, count)
            best.append(b)
            count.append(c)
            if shared:
                node = self.child[key] = len(self.best)
                self.best.append(b)
                self.count.append(c)
        if shared:
            self.terminal[word] = count[-1]
        return count[-1]


@functools.lru_cache(1)
def shared_trie(path: str) -> Trie:
    """One for each Python worker, whatever the number of its tasks."""
    return Trie(pieces(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_pretokens, n_tokens.

    Pre-tokens are runs without white space, each with a leading U+2581. Null, empty and blank
    texts count 0. Repeated rows each get their row; other columns are ignored."""

    def make():
        import pyarrow as pa

        trie, blank = shared_trie(path), str.maketrans(WHITE, " " * len(WHITE))

        def count(texts):
            n_pre, n_tok = [], []
            for t in texts:
                ws = [w for w in t.translate(blank).split(" ") if w]
                if len(trie.best) > NODES:
                    trie.clear()
                known = trie.terminal
                n_pre.append(len(ws))
                n_tok.append(sum([known[w] if (w := "▁" + x) in known else trie.tokens(w) for x in ws]))
            return [pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())]

        return count

    return per_text(docs, id_col, text_col, make, "n_pretokens long; n_tokens long")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_path())
