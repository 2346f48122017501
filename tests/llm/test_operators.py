"""Operators against brute force, on odd rows and on the small test tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import bpe, components, exact_dedup, exchange, license_scan, mixing, ngram_join, pii, quality, suffix_dedup, token_counts, toxicity
from millrace.llm._common import Workspace

from .conftest import ODD

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_odd_rows_and_empty_tables(odd, none, spark):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    model, rules = toxicity.fit(odd, labels), quality.fit(odd, labels)
    empty = toxicity.fit(none, labels.limit(0))
    for f in (
        lambda x: exact_dedup.exact_dedup(x), lambda x: bpe.digests(x, bpe.default_path()), lambda x: token_counts.token_counts(x, token_counts.default_path()), lambda x: license_scan.license_scan(x),
        lambda x: pii.find_pii(x), lambda x: mixing.mix(x), lambda x: ngram_join.similar_groups(x), lambda x: suffix_dedup.remove_repeats(x), lambda x: quality.apply_rules(x, rules),
        lambda x: toxicity.score_toxicity(x, model), lambda x: toxicity.score_toxicity(x, empty),
    ):
        out = f(odd).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _, _ in ODD)
        assert f(none).collect() == []


def test_exact_groups(odd):
    out = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(odd).collect()}
    assert (1, 3, 3, False) in out and (3, 3, 3, True) in out  # the longest original stays
    assert {x for x in out if x[0] == 5} == {(5, 5, 3, False), (5, 5, 3, True)}
    assert (None, None, 1, True) in out


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "0123456789", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "".join(map(chr, range(0x4E00, 0x9FFF, 7))), "".join(map(chr, range(0xAC00, 0xD7A3, 5)))])
def test_chunks_follow_the_content(spark, letters):
    """A few characters put in front move no cut but the first ones, whatever the script."""
    text = "".join(random.Random(5).choices(letters, k=40_000))
    rows = exact_dedup.chunked(spark.createDataFrame([(1, text), (2, letters[:9] + text)], "doc_id int, text string"), "doc_id", "text").collect()
    one, two = ({p["h"] for p in r["_parts"]} for r in rows)
    assert len(one) > 20 and len(one & two) >= 0.8 * len(one)


def test_exact_clash(spark):
    rows = spark.createDataFrame([(1, b"a"), (1, b"b"), (2, b"c"), (2, b"c")], "h long, v binary")
    got = {(r["h"], bytes(r["v"])): r["ident"] for r in exact_dedup.identifiers(rows).collect()}
    assert got[2, b"c"] == 2 and len({*got.values()}) == 3


def test_bpe_like_the_library(texts):
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    random.seed(1)
    alphabet = "abcXYZ \n\t'sS09éßΣσİ中😀́\x1c\x85\xa0½<|endoftext|>"
    rows = [*texts.values(), *["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(500)], "hi<|endoftext|> yo", "qzxj" * 400, "ΑΣ ΑΣ"]
    for t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert got == b"".join(i.to_bytes(4, "little") for i in ids)
        assert codec.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_all_planes():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    rows = [f"a{chr(c)}b {chr(c)}" for c in [*range(0xD800), *range(0xE000, 0x20000, 3), *range(0x20000, 0x110000, 997)]]
    random.seed(9)
    marks = [0x300, 0x301, 0x327, 0x1AC9, 0x20E6, 0x10D27, 0x20EE, 0x5B0, 0x3A3, 0x41, 0xE9, 0x130, 0x20, 0x1100, 0x1161, 0x11A8, 0x31]
    rows += ["".join(chr(random.choice([*marks, random.randrange(0x250), random.randrange(0x3000, 0xD800), random.randrange(0x10000, 0x1F000)])) for _ in range(random.randint(1, 12))) for _ in range(3000)]
    wrong = [t for t in rows if codec.encode(t) != b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)]
    assert wrong == []


def test_token_counts_are_viterbi(texts):
    scores = token_counts.pieces(token_counts.default_path())
    longest = max(map(len, scores))

    def brute(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            n = len(word[end - 1].encode())
            options = [(best[end - 1][0] + n * token_counts.BYTE_SCORE, best[end - 1][1] - n)]
            options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    trie = token_counts.Trie(scores)
    seen = sorted({"▁" + w for t in texts.values() for w in t.split()})[:1500] + ["▁" + "ab" * 300, "▁க\U0001f9ff"]
    assert [trie.tokens(w) for w in seen] == [brute(w) for w in seen]


def brute_statistics(t):
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    found = {j for i, x in enumerate(windows) if count[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(found)


def test_quality_statistics(odd, docs, texts):
    got = {r["doc_id"]: tuple(r[k] for k in quality.BASE) for r in quality.apply_rules(docs, []).collect()}
    assert got == {i: brute_statistics(t) for i, t in texts.items()}
    got = sorted((str(r["doc_id"]), *(r[k] for k in quality.BASE)) for r in quality.apply_rules(odd, []).collect())
    assert got == sorted((str(i), *brute_statistics(t or "")) for i, t, _ in ODD)


def test_decision_list_learns_a_conjunction():
    random.seed(3)
    rows = [{f: random.random() for f in quality.FEATURES} for _ in range(600)]
    bad = [r["symbols_per_word"] > 0.7 and r["upper_share"] < 0.5 for r in rows]
    rules = quality.learn(rows, bad)
    hit = [any(all(c.holds(r) for c in rule) for rule in rules) for r in rows]
    assert sum(h == b for h, b in zip(hit, bad, strict=True)) > 580
    assert quality.learn(rows, [False] * 600) == []


def test_toxicity_index_is_exhaustive():
    random.seed(5)
    vectors = [{t: random.random() for t in random.sample(range(30), random.randint(0, 6))} for _ in range(300)]
    index = toxicity.BlockMaxIndex(vectors, 30, 16)
    for _ in range(100):
        q = {t: random.random() for t in random.sample(range(30), 4)}
        want = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors)))[:10]
        got = [(-round(s, 12), i) for s, i in index.search(q, 10)]
        assert got == [x for x in want if x[0] < 0]
    assert index.opened < 100 * index.n_blocks


def test_toxicity_nearest_with_ties():
    random.seed(6)
    vectors = [{t: random.choice([0.5, 1.0]) for t in random.sample(range(6), random.randint(0, 3))} for _ in range(200)]
    index = toxicity.BlockMaxIndex(vectors, 6, 16)
    for k in range(60):
        q = {t: random.choice([0.5, 1.0]) for t in random.sample(range(6), 2)}
        every = {i: sum(w * v.get(t, 0) for t, w in q.items()) for i, v in enumerate(vectors) if i != k}
        best = sorted((s for s in every.values() if s > 0), reverse=True)[:10]
        above = [i for i, s in every.items() if s > best[-1] + 1e-12]
        tied = [i for i, s in every.items() if abs(s - best[-1]) < 1e-12]
        at, scores, shares = index.nearest(q, 10, k)
        assert set(at.tolist()) == {*above, *tied} and all(abs(every[i] - s) < 1e-12 for i, s in zip(at.tolist(), scores, strict=True))
        got = dict(zip(at.tolist(), shares.tolist(), strict=True))
        assert all(got[i] == 1 for i in above) and all(abs(got[i] - (len(best) - len(above)) / len(tied)) < 1e-12 for i in tied)


def test_toxicity_ties_are_votes():
    for order in (1, -1):  # neither label nor id comes first
        model = toxicity.Model(["w"], [(order * k, int(k < 60), {"w": 1}) for k in range(75)], (1.0, 1.0))
        assert abs(model.score("w")[0] - 0.8) < 0.05


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(docs, model).filter(toxicity.held_out()).join(labels, "doc_id").collect()
    one, zero = [r["score"] for r in out if r["toxic"]], [r["score"] for r in out if not r["toxic"]]
    assert sum((a > b) + (a == b) / 2 for a in one for b in zero) / len(one) / len(zero) > 0.75
    assert sum(r["predicted"] for r in out if not r["toxic"]) <= 0.05 * len(zero)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_toxicity_copies_count_once(spark):
    random.seed(8)
    prose, bad, hot = [f"p{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)], ["vile", "foul", "nasty", "rotten", "cursed"], [f"h{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(195)]
    text = lambda *more: " ".join([*random.sample(prose, 30), *more])
    rows = [(k, text(bad[k % 5]), 1) for k in range(60)] + [(100 + k, " ".join(["slur", *random.sample(hot, 190)]), 1) for k in range(80)] + [(1000 + k, text(), 0) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.drop("toxic"), frame.drop("text"))
    assert set(bad) <= set(model.vocabulary) and not set(hot) & set(model.vocabulary)
    assert all(model.score(text(w))[0] > toxicity.LIMIT > model.score(text())[0] for w in bad)


def test_mixing_targets(spark, docs):
    out = mixing.mix(docs)
    rows = out.join(docs.select("doc_id", "source"), "doc_id").collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rows)
    total, by = sum(r["size"] for r in rows), defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    want, open_ = {}, {s: 1 + k % 3 for k, s in enumerate(sorted(by))}
    cap = {s: 3 * sum(r["size"] for r in x) for s, x in by.items()}
    left = total
    while over := [s for s in open_ if left * open_[s] / sum(open_.values()) > cap[s]]:
        for s in over:
            want[s] = cap[s]
        left -= sum(cap[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for s, x in by.items():
        assert abs(x[0]["target"] - want[s]) < 1e-6 * total
        assert abs(sum(r["taken"] for r in x) - want[s]) <= max(r["size"] for r in x)
    again = mixing.mix(docs.repartition(7))
    assert sorted((r["doc_id"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_flight_keeps_totals():
    random.seed(7)
    size = [random.randint(0, 500) for _ in range(400)]
    p = [0.37] * 400
    mixing.flight(p, size, random.random)
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - 148) < 1e-6 and abs(sum(x * s for x, s in zip(p, size, strict=True)) - 0.37 * sum(size)) < 1e-4


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_pii_base(texts):
    random.seed(2)
    rows = list(texts.values())
    for alphabet in ("ab.@-+ %", "1234567890. -+()", "01.@a+ ", "123456789 -"):
        rows += ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(500)]
    for t in rows:
        assert pii.plain_spans(t) == brute_pii(t)
        assert set(brute_pii(t)) <= set(pii.all_spans(t)[1])


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("write jane at mail dot example dot com please", "email", "jane at mail dot example dot com"),
        ("to jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
        ("a 4111​111111111111 b", "card", "4111​111111111111"),
        ("one nine two dot one six eight dot one dot two five", "ip", "one nine two dot one six eight dot one dot two five"),
        ("call plus four nine one five one two three four five six now", "phone", "plus four nine one five one two three four five six"),
        ("call +1 five 5 five 0 one 2 three 4 now", "phone", "+1 five 5 five 0 one 2 three 4"),
        ("call plus vier neun eins fünf eins zwei drei vier fünf sechs jetzt", "phone", "plus vier neun eins fünf eins zwei drei vier fünf sechs"),
        ("write john at example [dot] com", "email", "john at example [dot] com"),
        ("write john at mail (dot) example dot com", "email", "john at mail (dot) example dot com"),
        ("write john at example(dot)com", "email", "john at example(dot)com"),
        ("a john arroba ejemplo punto com", "email", "john arroba ejemplo punto com"),
    ],
)
def test_pii_disguises(text, kind, found):
    assert (kind, text.index(found), text.index(found) + len(found)) in pii.all_spans(text)[1]


@pytest.mark.parametrize("text", ["meet at two dot", "one of the two at home. dot", "five six", "naïve café", "at the dot of ten", "meet me at example.com", "arrived at one point in time", "un peu de neuf, un point de vue"])
def test_pii_leaves_clean_text(text):
    assert pii.all_spans(text) == ([], [])


def brute_components(rows):
    low, sets = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(n, edits, seed):
    random.seed(seed)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(random.randint(0, edits)):
            w[random.randrange(len(w))] = f"e{random.randint(0, 10**6)}"
        out.append((1000 * seed + k, " ".join(w)))
    return out


@pytest.mark.parametrize("carried", [1024, 100, 0])
def test_ngram_join(spark, docs, texts, monkeypatch, carried):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(exchange, "TURN", {1024: 8, 100: 2, 0: 3}[carried])  # one round, and several
    monkeypatch.setattr(ngram_join, "CARRIED", carried)
    rows = [*texts.items(), *near_copies(40, 6, 1), *near_copies(30, 9, 2), (7001, "A b\tc D e"), (7002, "a B c d E"), (7003, "a b"), (7004, "A  B")]
    got = {r[0]: tuple(r[1:]) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def brute_set(t):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("block", [2048, 16])
def test_ngram_links(spark, texts, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = [*list(texts.items())[:60], *near_copies(40, 6, 1), *near_copies(30, 20, 2), (7001, "A b\tc D e"), (7002, "a B c d E"), (7003, "a b"), (7004, ""), (7005, "")]
    rows += [(8000 + k, t) for k, (_, t) in enumerate(rows[60:64])]
    frame, sets = spark.createDataFrame(rows, "doc_id long, text string"), {i: brute_set(t) for i, t in rows}
    want = {frozenset((a, b)) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    count = Counter(i for x in want for i in x)
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.similar_links(frame).collect()} == {i: count[i] for i in sets}
    text, got = dict(rows), [frozenset(r) for r in ngram_join.similar_pairs(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == {x for x in want if len({text[i] for i in x}) == 2}


def test_dual_traversal_loses_no_pair():
    import numpy as np

    random.seed(4)
    sets = [set(random.sample(range(400), 40)) for _ in range(12)]
    sets = [s if k % 3 else (s - set(random.sample(sorted(s), 3))) for s in sets for k in range(6)]
    bits = np.zeros((len(sets), 2048), np.uint8)
    for k, s in enumerate(sets):
        bits[k, [x * 5 % 2048 for x in s]] = 1
    a, b = ngram_join.dual_traversal(np.array([len(s) for s in sets]), np.packbits(bits, axis=1).view(np.uint64), np.arange(len(sets)))
    got = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
    want = {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert want <= got and len(got) < len(sets) * (len(sets) - 1) / 4


def test_components(spark):
    edges = [(k + 1, k) for k in range(50)] + [(200, 100), (300, 200), (400, 100), (400, 999)]
    out = components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "c").collect()
    assert {r["v"]: r["root"] for r in out} == {k: 0 for k in range(1, 51)} | {200: 100, 300: 100, 400: 100, 999: 100}


def brute_repeats(rows):
    n, count = suffix_dedup.LENGTH, Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        count.update(b[p : p + n] for p in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if count[b[p : p + n]] > 1:
                gone[p : p + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("turn", [8, 2])
def test_suffix_dedup(spark, monkeypatch, turn):
    random.seed(6)
    noise = lambda n: "".join(random.choice("abcdeé ") for _ in range(n))
    passage = noise(1500)
    rows = [(k, noise(300) + passage[random.randint(0, 300) : random.randint(600, 1500)] + noise(300)) for k in range(25)]
    rows += [(50, passage[100:499] + noise(5)), (51, noise(9) + passage[200:600]), (52, "a" * 900), (53, ("xyz" * 400)[:1100]), (54, rows[0][1]), (54, rows[0][1]), (None, passage), (55, None), (56, "short"), (57, noise(700) * 2)]
    monkeypatch.setattr(suffix_dedup, "RUN", 40)
    monkeypatch.setattr(exchange, "TURN", turn)
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out)
    assert got == brute_repeats(rows)


def test_loser_tree_merges_with_prefixes():
    random.seed(8)
    runs = [sorted((bytes(random.choice(b"ab") for _ in range(random.randint(0, 8))), r, k, 0) for k in range(20)) for r in range(5)]
    coded = [suffix_dedup.FrontCoded.encode(r) for r in runs]
    assert [[x[1:] for x in suffix_dedup.FrontCoded.decode(c)] for c in coded] == runs
    out = list(suffix_dedup.merged([suffix_dedup.FrontCoded.decode(c) for c in coded]))
    assert [x[1] for x in out] == sorted(s for r in runs for s, *_ in r)
    before = b""
    for shared, s, *_ in out:
        assert shared == suffix_dedup.common_prefix(before, s, 0)
        before = s


def test_licenses(spark):
    mit = next(t for n, t in license_scan.KNOWN if n == "MIT")
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (2, "x\n Licensed under the Apache Licence, version 2.0 \ny"), (3, mit + " more"), (4, None)]
    out = {r["doc_id"]: (r["license"], r["n_notices"], r["notices"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: ("MIT", 1, "MIT"), 2: (None, 1, "Apache-2.0"), 3: (None, 0, ""), 4: (None, 0, "")}


def test_license_forms(spark):
    import os

    isc = next(t for n, t in license_scan.KNOWN if n == "ISC")
    want = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the GNU General Public License v3.0": "GPL-3.0-only",
        "Distributed under the Apache License v2.0": "Apache-2.0", "# Licensed under the LGPL, version 2.1 or later": "LGPL-2.1-or-later", "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0-only", isc: "ISC",
        "Licensed under the GNU General Public License, version 35.": "", "Licensed for fun.": "",
    }
    rows = [(k, f"x\n{t}\ny") for k, t in enumerate(want)]
    got = {r["doc_id"]: r["notices"] for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == [*want.values()]
    import textwrap

    wrapped = [(w, "Copyright (c) 2020 Someone\n© 2021 Another\nCopyright by A. Holder\n\n" + textwrap.fill(isc, w)) for w in range(30, 110)]
    assert any(line.startswith("copyright notice") for _, t in wrapped for line in t.split("\n"))
    got = license_scan.license_scan(spark.createDataFrame(wrapped, "doc_id long, text string")).collect()
    assert {r["license"] for r in got} == {"ISC"}
    files = {n: f for n, f in (("GPL-3.0", "GPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")) if os.path.exists(f"/usr/share/common-licenses/{f}")}
    whole = [(n, open(f"/usr/share/common-licenses/{f}").read()) for n, f in files.items()]
    if whole:
        got = license_scan.license_scan(spark.createDataFrame(whole, "doc_id string, text string")).collect()
        assert {r["doc_id"]: r["license"] for r in got} == {n: n for n in files}


@pytest.mark.parametrize("name", ["op8_license_scan", "op9_ngram_join", "op10_exact_dedup"])
def test_against_sql(spark, name):
    import duckdb

    from millrace.llm import queries as q

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = q.QUERIES[name](spark, SF), c.sql(q.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == sorted(repr([r[k] for k in at]) for r in want.fetchall())


def test_further_components(spark):
    space, frame = Workspace(spark, "t"), lambda e: spark.createDataFrame(e, "a long, b long")
    one = components.further(None, frame([(2, 1), (3, 2), (11, 10), (21, 20)]), space, "x")
    two = components.further(one, frame([(11, 3), (30, 21), (2, 1)]), space, "y")
    assert {r["v"]: r["root"] for r in two.collect()} == {2: 1, 3: 1, 10: 1, 11: 1, 21: 20, 30: 20}


def test_suffix_shared_passages(spark):
    random.seed(12)
    noise = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = noise(300)
    rows = [(1, noise(900) + passage + noise(500)), (2, noise(40) + passage + noise(2000)), (3, noise(1500)), (4, noise(170) * 2), (5, "short"), (6, "short")]
    got = {r["doc_id"]: (r["shared"] > 0, len(r["spans"])) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (False, 0), 4: (False, 0), 5: (False, 0), 6: (False, 0)}


def test_text_classes_tell_clashes_apart(spark, monkeypatch):
    from millrace.llm import _common

    real = _common.F.xxhash64
    monkeypatch.setattr(_common.F, "xxhash64", lambda *c: _common.F.length(c[0]).cast("long") if len(c) == 1 else real(*c))
    base = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "x")], "_id long, _text string")
    rows, known = _common.text_classes(base, "_text", Workspace(spark, "t"))
    got = {r["_id"]: r["_class"] for r in rows.collect()}
    assert got[1] == got[3] and len({*got.values()}) == 3
    assert sorted((r["_copies"], r["_least"]) for r in known.collect()) == [(1, 2), (1, 4), (2, 1)]


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 50 + [(k, "w " * (k % 7 + 1), "t") for k in range(2, 60)] + [(2, None, None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    same = [r["copies"] for r in out if r["doc_id"] == 1]
    assert max(same) - min(same) <= 1 and abs(3 * sum(same) - out[0]["target"] if out[0]["doc_id"] == 1 else 0) <= 3 * 50
    assert all(r["copies"] <= 3 for r in out)


@pytest.mark.parametrize("k", range(5))
def test_pipeline_odd_rows(odd, none, spark, k):
    import corpus_pipeline as p

    name, stage = p.STAGES[k]
    rows, empty = stage(spark, odd, SF).collect(), stage(spark, none, SF)
    assert empty.collect() == []
    given = Counter(str(i) for i, _, _ in ODD)
    if name != "encoding":
        assert empty.columns == odd.columns
    got = Counter(str(r["doc_id"]) for r in rows)
    if name in ("toxicity", "encoding"):
        assert got == given
    elif name == "exact dedup":
        assert got == Counter(str(i) for i in (3, 5, None, 6, 7, 8, 9, 10))
    elif name == "near duplicates":
        assert got["5"] + got["4"] + got["10"] == 1 and got["1"] == got["2"] == got["3"] == 1 and max(got.values()) == 1
    else:
        assert set(got) <= set(given) and all(n <= 3 * given[i] for i, n in got.items())


def test_pipeline(spark, docs, texts):
    import corpus_pipeline as p

    got, df = [], docs
    for _, stage in p.STAGES:
        df = stage(spark, df, SF)
        df = df.persist()
        got.append(df.collect())
    columns = docs.columns
    assert all(list(r.asDict()) == columns for rows in got[:4] for r in rows[:1])
    ids = [[r["doc_id"] for r in rows] for rows in got]
    assert set(ids[0]) <= set(texts) and len(ids[0]) > 0.8 * len(texts)
    plain = {i: re.sub(r"[\x20\x09-\x0D]", "", texts[i]) for i in ids[0]}
    assert len(ids[1]) == len({plain[i] for i in ids[1]}) == len({*plain.values()})
    roots = brute_components([(i, texts[i]) for i in ids[1]])
    assert sorted(ids[2]) == sorted(i for i in ids[1] if roots[i][1] == i)
    copies = Counter(ids[3])
    assert set(copies) <= set(ids[2]) and max(copies.values()) <= 3
    assert Counter(ids[4]) == copies
    codec = p.bpe.Codec(p.bpe.default_path())
    for r in got[4]:
        assert r["ids_sha256"] == hashlib.sha256(codec.encode(texts[r["doc_id"]])).hexdigest()


def test_written_tables_leave_settings_alone(spark):
    from pyspark.sql import functions as F

    from millrace.llm._common import CLEANUP

    for before in (None, "false"):
        if before:
            spark.conf.set(CLEANUP, before)
        rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        assert Workspace(spark, "test").save(rows, "rows").agg(F.sum("n").alias("n")).first()["n"] == 1000
        assert spark.conf.get(CLEANUP, None) == before
        assert rows.count() == 7  # what was written can be asked for again
        spark.conf.unset(CLEANUP)
