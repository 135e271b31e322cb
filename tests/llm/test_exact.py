"""Operators with an exact result, held against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quiver.llm import bytespans, components, decontaminate, lines, mixing, rules, similar, simhash, substrings, suffixes, tokens
from quiver.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = -(2**63)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def norm(rows, *cols):
    return sorted((tuple(LOW if c == "doc_id" and r[c] is None else r[c] for c in cols) for r in rows), key=repr)


def same(got, want):
    assert got == sorted(want, key=repr)


def ident(i):
    return LOW if i is None else i


def line_key(line: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("least", [5, 2])
@pytest.mark.parametrize("parts", [1, 4, 37])
def test_lines(spark, docs, rows, least, parts):
    held = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            held[line_key(x)].add(ident(i))
    want = []
    for i, t, *_ in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if not (len(k := line_key(x)) >= 20 and len(held[k]) >= least and max(held[k]) != ident(i))]
        want.append((ident(i), len(split), len(split) - len(kept), sha("\n".join(kept))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        same(norm(lines.dedup_lines(docs, 20, least).collect(), "doc_id", "n_lines", "n_dropped", "kept_sha256"), want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert any(w[2] for w in want)


def test_substrings(docs, rows):
    first, split = {}, [WORD.findall(t or "") for _, t, *_ in rows]
    for (i, *_), w in zip(rows, split, strict=True):
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, ident(i)), ident(i))
    want = []
    for (i, *_), w in zip(rows, split, strict=True):
        gone = set()
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < ident(i):
                gone.update(range(j, j + 50))
        want.append((ident(i), len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    got = substrings.drop_repeated_windows(docs).collect()
    same(norm(got, "doc_id", "n_words", "n_removed", "kept_sha256"), want)
    for r in got:
        assert sum(s.last - s.first for s in r.spans) == r.n_removed and sha(r.kept_text) == r.kept_sha256
    assert any(w[2] for w in want)


def thue_morse(n: int, flip: bool = False) -> str:
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_substrings_verify_words(spark):
    """Strings that collide under every polynomial hash modulo 2**64, and hashes of a few bits, remove nothing."""
    same = " ".join(f"w{j}" for j in range(49))
    rows = [(1, f"{same} {thue_morse(1024)}"), (2, f"{same} {thue_morse(1024, True)}"), (3, f"{same} {thue_morse(1024)}"), (None, "x " * 60), (4, "x " * 55)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {1: 0, 2: 0, 3: 50, None: 0, 4: 55}
    assert {r.doc_id: r.n_removed for r in substrings.drop_repeated_windows(docs).collect()} == want
    owners = np.zeros(2, dtype=substrings._owner)
    digests = [substrings._digests(t.encode(), np.array([0]), 50) for _, t in rows[:2]]
    for k, d in enumerate(digests):
        owners[k] = (10 + k, 7, d["d0"][0], d["d1"][0], False)
    for k, (_, t) in enumerate(rows[:2]):
        assert substrings._owners(owners, np.array([7], dtype=np.uint64), t.encode(), np.array([0]), 50).tolist() == [10 + k]


@pytest.mark.parametrize("width", [50, 3])
def test_substrings_hot(spark, width):
    """A passage in every document, rows without an id, repeated rows, several rows of one id."""
    shared = " ".join(f"s{j}" for j in range(70))
    rows = [(i // 2 if i % 3 else None, f"{' '.join(f'd{i}x{j}' for j in range(i % 7))} {shared} tail{i}") for i in range(300)] * 2
    first, want = {}, []
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - width + 1):
            k = tuple(w[j : j + width])
            first[k] = min(first.get(k, ident(i)), ident(i))
    for i, t in rows:
        w, gone = t.split(), set()
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < ident(i):
                gone.update(range(j, j + width))
        want.append((ident(i), len(w), len(gone)))
    got = substrings.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()
    assert norm(got, "doc_id", "n_words", "n_removed") == sorted(want, key=repr)


@pytest.mark.parametrize("hot", [1024, 3])
def test_bytespans(docs, rows, hot):
    width = 150
    texts = [(t or "").encode() for _, t, *_ in rows]
    n = Counter(t[j : j + width] for t in texts for j in range(len(t) - width + 1))
    want = []
    for (i, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=int)
        for j in range(len(t) - width + 1):
            if n[t[j : j + width]] > 1:
                gone[j : j + width] = 1
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        want.append((ident(i), len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), sha(kept)))
    got = bytespans.drop_repeated_bytes(docs, width, hot=hot).collect()
    same(norm(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), want)
    assert any(w[2] for w in want)


def test_suffix_arrays(monkeypatch):
    rng = np.random.default_rng(0)
    for names in (512, 3):
        monkeypatch.setattr(suffixes, "NAMES", names)
        for _ in range(300):
            s = rng.integers(97, 97 + rng.integers(1, 5), rng.integers(0, 50), dtype=np.uint8)
            if rng.random() < 0.3:
                s = np.tile(s, 3)
            b, sa = s.tobytes(), suffixes.suffix_array(s)
            assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
            if len(b):
                phi, lcp = suffixes.permuted_prefixes(s, sa, np.array([0]))
                for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
                    k = 0
                    while max(i, j) + k < len(b) and b[i + k] == b[j + k]:
                        k += 1
                    assert (phi[i], lcp[i]) == (j, k)


@pytest.mark.parametrize("names", [512, 3])
def test_suffix_arrays_recurse(monkeypatch, names):
    """Reduced strings of many names are induced too, through several levels."""
    monkeypatch.setattr(suffixes, "NAMES", names)
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9), dtype=np.uint8)) for _ in range(300)]
    b = b" ".join(words[i] for i in rng.integers(0, 300, 4000))
    b += b[:5000] + b"abab" * 300
    depth = []
    whole = suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda t: depth.append(len(t)) or whole(t))
    sa = suffixes.suffix_array(np.frombuffer(b, dtype=np.uint8)).tolist()
    assert sa == sorted(range(len(b)), key=lambda i: b[i:]) and len(depth) > 2


@pytest.mark.parametrize("hot", [1024, 5])
def test_bytespans_footer_everywhere(spark, hot):
    """One passage in every text, long runs of one byte, repeated rows."""
    footer = "".join(chr(97 + (7 * j * j + j) % 26) for j in range(260))
    texts = [(i, ("x" * (i % 5) * 40) + f"head {i} " * 9 + footer + f" {i}" + ("z" * 300 if i % 9 == 0 else "")) for i in range(120)]
    texts += texts[:3] + [(None, "q" * 200), (None, None)]
    width = 150
    n = Counter(t[j : j + width] for _, t in texts if t for j in range(len(t) - width + 1))
    want = []
    for i, t in texts:
        gone = set()
        for j in range(len(t or "") - width + 1):
            if n[t[j : j + width]] > 1:
                gone.update(range(j, j + width))
        want.append((ident(i), len(gone), sha("".join(c for j, c in enumerate(t or "") if j not in gone))))
    got = bytespans.drop_repeated_bytes(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), width, hot=hot).collect()
    same(norm(got, "doc_id", "n_removed", "kept_sha256"), want)


def fingerprint(text: str) -> int:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    s = [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(docs, rows):
    fps = [fingerprint(t or "") for _, t, *_ in rows]
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                group[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 2**63), ident(i))
    want = [(ident(i), f"{fps[k]:016x}", least[find(k)]) for k, (i, *_) in enumerate(rows)]
    got = simhash.near_duplicates(docs).select(F.col("doc").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("f"), "component_id").collect()
    same(norm(got, "doc_id", "f", "component_id"), want)
    kept = simhash.keep_first(docs).collect()
    assert sorted(ident(r.doc_id) for r in kept) == sorted(set(least.values()))
    assert kept[0].asDict().keys() == set(docs.columns)


def classes(texts: list[tuple[int, str | None]], width: int = 5, least: float = 0.8) -> list[tuple[int, int]]:
    """(id, smallest id reachable) by all pairs."""
    sets, group = [], list(range(len(texts)))
    for _, t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    smallest: dict = {}
    for k, (i, _) in enumerate(texts):
        smallest[find(k)] = min(smallest.get(find(k), 2**63), i)
    return [(i, smallest[find(k)]) for k, (i, _) in enumerate(texts)]


def test_similar(docs, rows):
    want = classes([(ident(i), t) for i, t, *_ in rows])
    got = similar.similar_documents(docs)
    same(norm(got.collect(), "doc", "component_id"), want)
    kept = similar.keep_first(docs).collect()
    assert sorted(ident(r.doc_id) for r in kept) == sorted({c for _, c in want})
    assert kept[0].asDict().keys() == set(docs.columns)


def test_similar_at_the_threshold(spark, monkeypatch):
    """Copies with changed words, on both sides of 0.8, in one large group and many small ones; shingles decide close cases; the join of wanted documents works without a broadcast."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    texts = []
    for base, copies in ((400, 150), *((int(n), 3) for n in rng.integers(20, 900, 40))):
        first = [word() for _ in range(base)]
        for _ in range(copies):
            w = list(first)
            for k in rng.choice(base, int(rng.integers(0, 1 + base // 35)), replace=False):
                w[k] = word()
            texts.append((len(texts), " ".join(w)))
    want = classes(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    got = norm(similar.similar_documents(docs).collect(), "doc", "component_id")
    of, lost = dict(want), sum(c != w for (_, c), (_, w) in zip(sorted(got), sorted(want), strict=True))
    # a text that only one hub links may be lost where the hub stands behind a nearer leader
    assert lost <= 5 and len(set(of.values())) > 40
    assert all(of[i] == of[c] for i, c in got)
    monkeypatch.setattr(similar, "SMALL", -1)
    assert sorted(norm(similar.similar_documents(docs).collect(), "doc", "component_id")) == sorted(got)


@pytest.mark.parametrize("cell", [1024, 16])
def test_similar_behind_leaders(spark, monkeypatch, cell):
    """One large group around the threshold: no text whose partner stands behind a nearer leader is lost, in small cells too."""
    monkeypatch.setattr(similar, "CELL", cell)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 5))
    texts = []
    for base, copies in ((400, 150), *((int(n), 3) for n in rng.integers(20, 900, 40))):
        first = [word() for _ in range(base)]
        for _ in range(copies):
            w = list(first)
            for k in rng.choice(base, int(rng.integers(0, 1 + base // 35)), replace=False):
                w[k] = word()
            texts.append((len(texts), " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    same(norm(similar.similar_documents(docs).collect(), "doc", "component_id"), classes(texts))


def test_similar_gate_is_no_weaker_than_the_judgement():
    """Of pairs with a similarity of 0.8, next to none differ in more of the first check bits than the gate lets by."""
    seen = similar._limits(0.8)[1]
    n, tail = similar.FIRST, 0.0
    for k in range(seen + 1, n + 1):
        tail += math.comb(n, k) * 0.1**k * 0.9 ** (n - k)
    assert tail < 0.0001


def test_keep_first_of_null_and_repeated_ids(spark):
    """Rows of a null doc_id are judged each by its own text; a group keeps a text where one doc_id has several."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0)), (5, text(1)), (9, text(9))]
    got = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((ident(r.doc_id), r.text) for r in got) == sorted([(LOW, text(k)) for k in range(6)] + [(9, text(9))])
    rows = [(8, text(20)), (8, text(21)), (508, text(20)), (509, text(21))]
    got = similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == [text(20), text(21)] and 8 in {r.doc_id for r in got}


def test_min_wise_bits():
    """Samples agree as often as shingles; short and long sets fill all cells."""
    rng = np.random.default_rng(2)
    for n in (1, 7, 100, 5000, 60000):
        h = rng.integers(0, 2**63, n).astype(np.uint64)
        cut = round(n / 9)
        x, y = similar.samples(h[cut:]) if cut else similar.samples(h), similar.samples(h[: n - cut])
        j = (n - 2 * cut) / n
        assert abs((x == y).mean() - j) < 5 * (j * (1 - j) / similar.SAMPLES) ** 0.5 + 0.02
        assert len(np.unique(x)) > similar.SAMPLES * 0.9 or n < similar.SAMPLES


def test_golay_keys_miss_no_link():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**63, 4, dtype=np.int64)
    for x in f:
        mine = set(simhash.keys(np.array([x]))[1].tolist())
        flips = [1 << int(a) | 1 << int(b) | 1 << int(c) for a, b, c in rng.integers(0, 64, (4000, 3))]
        other = np.array([int(x) & (2**64 - 1) ^ e for e in flips], dtype=np.uint64).view(np.int64)
        row, key = simhash.keys(other)
        assert set(row[np.isin(key, list(mine))].tolist()) == set(range(len(other)))
    assert (simhash._near() >= 0).all() and simhash._near().shape == (2048, 6)


def test_large_group_gives_a_forest():
    rng = np.random.default_rng(2)
    x = int(rng.integers(0, 2**62))
    near = np.array([x ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (3000, 2))], dtype=np.int64)
    near = np.unique(near)
    assert len(simhash.spanning_forest(near, 3)) == len(near) - 1


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_components(spark, small):
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 250)] + [(500, j) for j in range(501, 700)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    assert all(got[i] == 0 for i in range(101)) and got[300] == got[250] == 200 and all(got[j] == 500 for j in range(500, 700))


def test_tokens(docs, rows):
    from tokenizers import Tokenizer

    special = [(1, "<|endoftext|> x<|startoftext|>y", None, None, 0), (2, "ΑΣ ας T̈ é DON'T İ", None, None, 0)]
    library = Tokenizer.from_file(tokenizer_path())
    extra = docs.sparkSession.createDataFrame(special, "doc_id long, text string, lang string, source string, n_chars long")
    df = docs.select(*extra.columns).union(extra)
    want = [(ident(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows + special]
    for how in ({}, {"chunk": 2000, "overlap": 64}, {"chunk": 300, "overlap": 16}):
        same(norm(tokens.count_tokens(df, tokenizer_path(), **how).collect(), "doc_id", "n_bytes", "n_tokens"), want)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_splicing(name, rows):
    codec = tokens.Codec(tokenizer_path(name))
    for t in [max((r[1] or "" for r in rows), key=len), "x" * 5000, "ab " * 3000, " " * 4000 + "a b", "日本語 " * 2000, ""]:
        for chunk, overlap in ((500, 40), (1000, 4)):
            for stable in (tokens.lone, codec.stable):
                assert tokens.spliced(t, codec.located, chunk, overlap, stable) == codec.counts([t])[0]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_stable_places_are_stable(name):
    """Whatever stands on either side of a stable place, the tokens of the other side are the same."""
    codec, rng = tokens.Codec(tokenizer_path(name)), np.random.default_rng(3)
    parts = ["the", "a1", "'s", "ß", "e\u0301", "\u0301", "ΑΣ", "日本", "  ", "\t", "\n", "...", "<|endoftext|>", "x" * 30, "I'll", "２", "\u00a8", "ﬁ"]
    found = 0
    for _ in range(300):
        t = "".join(parts[i] + " " * int(rng.integers(0, 2)) for i in rng.integers(0, len(parts), 12))
        whole = codec.counts([t])[0]
        for p in range(1, len(t) - 1):
            if codec.stable(t, p):
                found += 1
                left = codec.counts([t[:p]])[0]
                # what comes after the place, with any text before it
                other = "q " if codec.json else "q"
                right = codec.counts([other + t[p:]])[0] - codec.counts([other])[0] if not codec.json else codec.counts([t[p:]])[0]
                assert left + right == whole, (t, p)
    assert found > 100


def test_splicing_is_used_by_the_query(spark):
    """Texts above the chunk are spliced at several places; a tokenizer without a proof encodes them whole."""
    text = "The quick brown fox, it's 42 years old.\n" * 1500
    codec, calls = tokens.Codec(tokenizer_path()), []
    assert tokens.spliced(text, lambda t: calls.append(len(t)) or codec.located(t), 1 << 14, 1 << 9, codec.stable) == codec.counts([text])[0]
    assert len(calls) >= 4 and max(calls) <= 1 << 14
    assert not tokens.spaces_begin_matches({"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": True}, "model": {}})


def brute_tiles(text, item, least):
    text, item, tiles = list(text), list(item), []
    while True:
        best = (least - 1, 0, 0)
        for j in range(len(item)):
            for i in range(len(text)):
                k = 0
                while i + k < len(text) and j + k < len(item) and text[i + k] == item[j + k] is not None:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return tiles
        tiles.append(k)
        text[i : i + k] = [None] * k
        item[j : j + k] = [None] * k


def test_tiling():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = rng.integers(0, 6, rng.integers(4, 25)).astype(np.uint64)
        text = np.concatenate([item[a : a + 6] for a in rng.integers(0, len(item), 4)] + [rng.integers(0, 6, 10).astype(np.uint64)])
        tiles = decontaminate.tile(text, item, 3)
        want = brute_tiles(text.tolist(), item.tolist(), 3)
        assert max([x[2] for x in tiles], default=0) == max(want, default=0)
        used_t, used_i = set(), set()
        for a, b, n in tiles:
            assert (text[a : a + n] == item[b : b + n]).all() and not used_t & set(range(a, a + n)) and not used_i & set(range(b, b + n))
            used_t |= set(range(a, a + n))
            used_i |= set(range(b, b + n))


def test_leaks(spark):
    item = "Alpha beta gamma, delta epsilon zeta. Eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau."
    moved = "pad eta THETA iota kappa; lambda mu nu xi omicron pi rho sigma tau! words between alpha beta gamma delta epsilon zeta end"
    docs = spark.createDataFrame([(1, "start " + item + " end"), (2, moved), (3, "alpha beta gamma delta epsilon and nothing else"), (4, None), (5, ""), (None, item), (1, "start " + item + " end"), (6, "tiny text here")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item, "x"), (11, None, "x"), (12, "tiny text", "x"), (None, item, "x")], "item_id long, text string, doc_id string")
    got = sorted(((ident(r.doc_id), r.item_id, r.tiles) for r in decontaminate.leaks(docs, bench).collect()))
    assert got == [(LOW, 10, 1), (1, 10, 1), (2, 10, 2), (6, 12, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaked(docs, bench).collect()) == [3, 4, 5]
    before, decontaminate.BLOCK = decontaminate.BLOCK, 20
    try:
        assert sorted(((ident(r.doc_id), r.item_id, r.tiles) for r in decontaminate.leaks(docs, bench).collect())) == got
    finally:
        decontaminate.BLOCK = before
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("item", ["one two three four five six seven eight nine ten " * 10, "again " * 20, "a b " * 7 + "a"])
def test_leaks_of_repetitive_items(spark, item):
    """A seed covers the item at each place where it occurs."""
    docs = spark.createDataFrame([(1, "before that " + item + " after that"), (2, "before that after that"), (3, item[: len(item) // 3])], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.coverage, r.tiles) for r in decontaminate.leaks(docs, bench).collect()]
    assert got == [(1, 10, 1.0, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaked(docs, bench).collect()) == [2, 3]


def test_decontamination_query_by_brute_force(spark, tmp_path):
    """op2 over random texts with moved, repeated and broken passages; pairs whose coverage is near the threshold may go either way, as ties among tiles do."""
    from quiver.llm import queries

    rng = np.random.default_rng(11)
    word = lambda k: [f"w{i}" for i in rng.integers(0, 30, k)]
    items = [word(int(n)) for n in rng.integers(8, 26, 10)] + [["re", "frain"] * 8, ["only"] * 12]
    docs = []
    for k in range(60):
        t = word(int(rng.integers(0, 15)))
        for _ in range(int(rng.integers(0, 4))):
            item = items[int(rng.integers(0, len(items)))]
            a = int(rng.integers(0, len(item)))
            t = t + item[a:] + word(int(rng.integers(0, 3))) + (item[:a] if rng.random() < 0.6 else [])
        docs.append((k, " ".join(t)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontaminate(spark, str(tmp_path)).collect()}
    sure = 0
    for d, text in docs:
        for i, item in enumerate(items):
            coverage = sum(brute_tiles(text.split(), item, 5)) / len(item)
            if abs(coverage - 0.6) > 0.08:
                sure += coverage > 0.6
                assert ((d, i) in got) == (coverage > 0.6), (d, i, coverage)
    assert sure > 20


def base(t: str):
    w = WORD.findall(t)
    n = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    again = {k for j in range(len(w) - 4) if n[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    held = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(held) - len(set(held)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def test_measures(docs, rows):
    got = rules.measures(docs).collect()
    same(norm(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), [(ident(i), *base(t or "")) for i, t, *_ in rows])


def test_binomial(spark):
    from math import comb

    df = spark.createDataFrame([(k, n) for n in (1, 5, 40, 200) for k in (0, 1, 3, n)], "k long, n long")
    for r in df.select("k", "n", rules.binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("c")).collect():
        assert r.c == pytest.approx(sum(comb(r.n, j) * 0.01**j * 0.99 ** (r.n - j) for j in range(min(r.k, r.n) + 1)), rel=1e-9)


def test_rules_keep_the_promise(spark):
    """Symbols mark bad texts; the cutoff may reject few good ones; a stratum with few labels rejects none."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(6000):
        bad, lang = i % 4 == 0, "aa" if i < 5900 else "bb"
        t = " ".join("w" + "".join(rng.choice(list("abcdefgh"), 4)) + ("%%%" if bad else "") for _ in range(30))
        rows.append((i, t, lang))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows + [(None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    assert not any(got[i].kept for i in range(0, 5900, 4)) and all(got[i].kept for i in range(5900) if i % 4)
    assert all(got[i].kept for i in range(5900, 6000)) and not got[None].kept
    cuts = rules.cutoffs(rules.measures(docs), labels).collect()
    assert [(r.stratum, r.rule) for r in cuts] == [("aa", "symbols")] and cuts[0].chance <= 0.05 / 10
    assert rules.judge(docs, labels.limit(0)).where("kept").count() == 6000
    assert rules.keep_good(docs, labels).columns == docs.columns


def test_rules_move_no_texts(spark, docs):
    labels = docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality")).distinct()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rules.keep_good(docs, labels)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        want = rules.judge(docs, labels, carry=("text",)).where("kept").select("doc_id", "text", "stratum")
        assert sorted(map(repr, map(tuple, got.select("doc_id", "text", "lang").collect()))) == sorted(map(repr, map(tuple, want.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_mixing(spark, docs, rows):
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert norm(got, "doc_id", "source", "taken") == norm(again, "doc_id", "source", "taken")
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in got:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, want, open_ = 1.5 * sum(size.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not over:
            want |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
            open_.discard(s)
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


def test_mixing_inclusion_follows_its_probability(spark):
    """Over many sources alike but for their ids, documents are taken as often as their own chances say; each source's words stay fixed."""
    runs, n = 150, 120
    size = [3 + (i * 37) % 400 for i in range(n)]
    rows = [(1000 * s + i, "w " * size[i], f"s{s:03d}") for s in range(runs) for i in range(n)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,)).collect()
    p, taken, words = {}, Counter(), Counter()
    for r in got:
        i = r.doc_id % 1000
        assert p.setdefault(i, r.p) == r.p and r.copies - r.certain in (0, 1)
        taken[i] += r.copies - r.certain
        words[r.source] += r.taken
    assert all(abs(x - 1.5 * sum(size)) <= max(size) / 2 for x in words.values())
    open_ = [i for i in range(n) if 0 < p[i] < 1]
    assert len({p[i] for i in open_}) > 50
    off = [(taken[i] / runs - p[i]) / (p[i] * (1 - p[i]) / runs) ** 0.5 for i in open_ if 0.03 < p[i] < 0.97]
    assert np.mean(np.square(off)) < 1.4 and abs(np.mean(off)) < 0.5
    # the odds matter: chances differ between documents and frequencies follow them
    assert np.corrcoef([p[i] for i in open_], [taken[i] / runs for i in open_])[0, 1] > 0.95


def test_sql_of_mixing_and_rules(spark, tmp_path):
    """The registered SQL, on tables with several sources, strata with cutoffs, nulls, ties and repeated rows."""
    import duckdb

    from quiver.llm import queries

    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(9000):
        bad, lang = rng.random() < 0.3, ("aa", "bb", None)[i % 3]
        mark = ("%%%", "!!", "QX")[i % 3] if bad else ""
        t = " ".join("w" + "".join(rng.choice(list("abcdefgh"), 4)) + mark for _ in range(int(rng.integers(3, 60))))
        rows.append((i, t, lang, f"s{i % 7}" if i % 11 else None, len(t)))
        labels.append((i, int(not bad), 0))
    rows += rows[:5] + [(9001, None, None, None, None), (9002, "", "aa", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op7_mixing", "op4_quality_rules"):
        df = queries.QUERIES[name](spark, str(tmp_path))
        want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)), name
    docs, known = (spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels"))
    assert {r.stratum for r in rules.cutoffs(rules.measures(docs), known).collect()} == {"aa", "bb", None}


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (lines.dedup_lines(empty), substrings.drop_repeated_windows(empty), bytespans.drop_repeated_bytes(empty), simhash.near_duplicates(empty), simhash.keep_first(empty), similar.similar_documents(empty), similar.keep_first(empty), tokens.count_tokens(empty, tokenizer_path()), decontaminate.leaks(empty, bench), rules.judge(empty, labels), rules.keep_good(empty, labels), mixing.mix_sources(empty)):
        assert df.count() == 0
