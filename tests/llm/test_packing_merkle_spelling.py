"""Packing, manifest and spelling groups against plain Python, with every odd case."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tallymark.llm import merkle, packing, queries, spelling

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, word string, n int, ids string, pos int, size int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, "Hello, WORLD!! it's 'show 12ab", "J̌ İ İ Å Å 　x\u0085y", "a<|endoftext|>b", "﻿ ​ c\u0000d", "word " * 3_000, "x" * 5_000,
       "end. é, ü! ×. ÷? É: a.. b.c, 1, x2; ,. . it's, 's. l'é. ﻿. Ǆ, ĳ. ñ̃, ’. «a», don't!", "İ. ß, ÿ"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"colour harbour number{i} " * (i + 1), ("en", "fr", None, "", "é")[i % 5], "s", i) for i in range(60)]
    rows += [(100 + i, text, "en", None, None) for i, text in enumerate(ODD)] + [(None, "harbour", "en", "s", 1)] * 3 + [(None, None, None, None, None), (7, "seven", "en", "s", 2), (7, "seven", "en", "s", 2), (3, "THREE", "en", "s", None)]
    return spark.createDataFrame([(*r, "t", "w", 1, "i", 2, 3) for r in rows], SCHEMA)


def rows_of(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def test_encoder_equals_the_tokenizer_on_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "AT_ONCE", 30)
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    texts = [t or "" for t in ODD] + [" ".join(f"w{i}é{i % 7}" for i in range(k * 13)) for k in range(20)]
    with open(packing.TOKENIZER, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    for _ in range(2):
        for got, text in zip(encoder.encode([t.encode() for t in texts]), texts):
            assert list(got) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark, docs, tmp_path):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = Counter()
    for doc_id, text, *_ in rows_of(docs):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        start = 0
        while start < len(ids):
            length = min(2048, 1 << (len(ids) - start).bit_length() - 1)
            want[doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)] += 1
            start += length
    got = packing.packing_report(docs.repartition(3)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got))) and {r["offset"] for r in got} == {0}
    assert [r["bucket"] for r in sorted(got, key=lambda r: r["sequence_id"])] == sorted((r["length"] for r in got), reverse=True)
    again = packing.packing_report(docs.repartition(7, "n_chars")).collect()
    assert Counter(got) == Counter(again)
    packing.write_buckets(packing.pack(docs), str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.count() == len(got) and back.filter("octet_length(ids) <> 4 * bucket").count() == 0


def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha256("".join(levels[-1][i : i + 8]).encode()).hexdigest() for i in range(0, len(levels[-1]), 8)])
    return levels


def path_of(levels, place):
    for level in levels[:-1]:
        first = place // 8 * 8
        yield level[first : place], level[place + 1 : first + 8]
        place //= 8


def plain_manifest(rows):
    def leaf(row):
        return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode()).hexdigest()

    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        shown = text if doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 3 else text.translate(LOWER)
        trees[lang].append((doc_id, leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, n_chars, shown))))
    langs = sorted(trees, key=lambda x: b"" if x is None else b"=" + x.encode())
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    levels = {lang: tree_of([r[1] for r in trees[lang]]) for lang in langs}
    top = tree_of([levels[lang][-1][0] for lang in langs])
    root = top[-1][0]
    for k, lang in enumerate(langs):
        for pos, (doc_id, own, shown) in enumerate(trees[lang]):
            steps = [*path_of(levels[lang], pos), *path_of(top, k)]
            fold = shown
            for left, right in steps:
                fold = sha256("".join([*left, fold, *right]).encode()).hexdigest()
            proof = sha256("".join(x for left, right in steps for x in left + right).encode()).hexdigest()
            yield doc_id, own, levels[lang][-1][0], root, proof, fold, fold == root


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_merkle(docs, depth):
    """Leaf partitions of 8 and 64 leaves need nodes of several levels from others."""
    assert Counter(map(tuple, merkle.merkle_report(docs, depth).collect())) == Counter(plain_manifest(rows_of(docs)))


def test_merkle_of_many_rows_and_languages(spark):
    rows = [(i, "T" * (i % 5), f"l{i % 11}" if i % 3 else "en", "s", i) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert Counter(map(tuple, merkle.merkle_report(docs, 2).collect())) == Counter(plain_manifest(rows))


def test_missing_nodes_are_the_least_that_the_paths_need():
    rng = np.random.default_rng(3)
    for size in (1, 2, 8, 9, 70, 700):
        for many in (1, 3, size):
            known = np.unique(rng.integers(0, size, many))
            have, want, at, here = {(0, int(i)) for i in known}, set(), known, size
            for level, lacking in enumerate(merkle.missing(known, size)):
                want |= {(level, int(i)) for i in lacking}
                have |= {(level + 1, int(i)) for i in np.unique(at // 8)}
                at, here = np.unique(at // 8), -(-here // 8)
            beside, n, level = set(), size, 0
            paths = set(map(int, known))
            while n > 1:
                beside |= {(level, c) for p in paths for c in range(p // 8 * 8, min(p // 8 * 8 + 8, n))}
                paths, n, level = {p // 8 for p in paths}, -(-n // 8), level + 1
            assert want == beside - have


def plain_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if run and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(words):
    forms, out = {}, []
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
        out.append((w, n, len(others)))
    for w, n, many in out:
        root = w
        while forms[root]:
            root = forms[root]
        yield w, forms[w], root, n, many, words[forms[w]] if forms[w] else None


def test_spelling(spark, docs):
    base = ["harbour", "harbours", "hárbour", "hörbour", "arbours", "harbxur", "hharbour", "colourful", "colorful", "colourfull", "banananana", "bananananana", "banananan", "ÀÉÎÕÜÇÑ", "àÉÎÕÜÇÑ", "x×÷yzabc", "zzzzzzz", "zzzzzzzz", "zzzzzzzzz"]
    rows = [(200 + k, " ".join([w] * (1 + 13 ** (k % 4) // 2)) + "!1" + w.upper(), "en", "s", 1) for k, w in enumerate(base)]
    rows += [(300 + k, f"{'harbxxr ' * 2}{'harbxur ' * 60}", "en", "s", 1) for k in range(2)] + [(302, "harbour " * 2_000, "en", "s", 1)]
    rows += [(None, "Harbour harbour " * 400, "en", "s", 1), (1000, " ".join(f"lettera{chr(97 + i % 26)}{chr(97 + i // 26)} " * 2 for i in range(300)), "en", "s", 1)]
    more = spark.createDataFrame([(*r, "t", "w", 1, "i", 2, 3) for r in rows], SCHEMA)
    everything = docs.unionAll(more)
    want = Counter(plain_groups(plain_words(rows_of(everything))))
    assert any(root != form for _, form, root, *_ in want if form) and Counter(map(tuple, spelling.spelling_groups(everything).collect())) == want


def test_pivots_are_the_cheapest_disjoint_grams():
    rng = np.random.default_rng(5)
    for _ in range(200):
        places = sorted(rng.choice(12, 5, replace=False).tolist())
        cost = rng.integers(1, 20, 5).tolist()
        best = min(cost[i] + cost[j] for i in range(5) for j in range(5) if places[j] >= places[i] + 2)
        left, right = spelling.pivots(places, cost)
        assert right >= left + 2 and cost[places.index(left)] + cost[places.index(right)] == best


def test_every_near_pair_meets_over_a_key():
    """Random words over two letters, where grams tie and repeat most."""
    rng = np.random.default_rng(7)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(7, 10))) for _ in range(150)})
    counts = Counter(g for w in words for g in {w[i : i + 2] for i in range(len(w) - 1)})
    order = {g: (rank, counts[g]) for rank, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    signed = {w: spelling.signature(w, order) for w in words}
    under = {w: spelling.postings(w, signed[w][1]) for w in words}
    for a in words:
        for b in words:
            if near(a, b):
                met = any(signed[x][0] <= signed[y][0] and set(spelling.probes(x, *signed[x][2])) & under[y] for x, y in ((a, b), (b, a)))
                assert met, (a, b)


def test_empty_tables(docs):
    none = docs.limit(0)
    for df in (packing.packing_report(none), merkle.merkle_report(none), spelling.spelling_groups(none)):
        assert df.collect() == []


def test_checksum_of_the_sql():
    sql = "select xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(said))), lambda i: ('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) from (select '12:hêllo' as said)"
    assert duckdb.connect().execute(sql).fetchone()[0] == zlib.crc32("12:hêllo".encode()) and "op13_spelling" in queries.SQL
