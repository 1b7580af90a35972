"""The corpus operators on small tables with every odd case, against plain Python."""

import base64
import hashlib
import math
import uuid
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallymark.llm import chat, curriculum, decontaminate, line_quality, lines, materialise, near_duplicates, quality, queries, substrings, toxicity
from tallymark.llm.words import Chunk
from tallymark.session import checkpoint_dir, cut_lineage
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "a line that many documents share and that has more than forty characters"
BASE = " ".join(f"w{i}" for i in range(60))


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{LONG}\nown{i} {BASE} x{i}", "en", "src0", 1) for i in range(7)]
    rows += [(10, None, None, None, None), (11, "", "en", "src1", 0), (12, " \t\n ", "en", "src1", 4), (13, "one two", "en", "src1", 7), (14, "ONE two", "en", "src2", 7)]
    rows += [(15, "One two", "en", None, 7), (15, "One two", "en", None, 7), (16, "é " * 40 + "ÀB <|x|> # a\\b [c]", "fr", "src2", 60), (17, "go go go " * 30, "en", "src2", 270)]
    rows += [(18, BASE + " " + " ".join(f"z{i}" for i in range(40_000)), "en", "src3", 1), (None, f"{LONG}\n{BASE}", "en", "src0", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"n_words": F.lit(-1), "score": F.lit("x"), "hits": F.lit(2), "kept": F.lit(3), "id": F.lit(4), "row": F.lit(5)})


def collected(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, collected(df)) == rows_of(columns, cur.fetchall())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    talks = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    for df in (decontaminate.leak_report(none, bench), substrings.substring_report(none), quality.quality_report(none, labels), lines.line_report(none), toxicity.toxicity_report(none, labels),
               chat.chat_report(talks), materialise.in_training_order(none), curriculum.mix_report(none), near_duplicates.near_report(none), line_quality.quality_rules(none)):
        assert df.collect() == []


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "w3 W4 w5, w6 w7 w8 w9 w10 w11 w12 w13"), (2, "One, TWO!"), (10, "w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"), (3, None), (4, "..."), (2, "One, TWO!")], "item_id bigint, text string")
    got = {(r["doc_id"], r["n_hit"], r["items_sha256"], r["contaminated"]) for r in decontaminate.leak_report(docs, bench).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (0, 11, sha("1,10"), True) in got and (13, 2, sha("2"), True) in got and (15, 2, sha("2"), True) in got and (10, 0, sha(""), False) in got and (14, 0, sha(""), False) in got
    spans = {r["row"]["doc_id"]: r["hits"]["char_spans"] for r in decontaminate.find_leaks(docs, bench).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    low, high = spans[0][0]
    assert text[0][low:high] == "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"
    blocks = decontaminate.find_leaks(docs, bench, block_bytes=60).select("row.doc_id", "hits.*")
    assert sorted(map(str, collected(blocks))) == sorted(map(str, collected(decontaminate.find_leaks(docs, bench).select("row.doc_id", "hits.*"))))
    assert decontaminate.without_leaks(docs, bench).columns == docs.columns


def brute_substrings(rows):
    first = {}
    order = lambda d: math.inf if d is None else d
    for d, text in rows:
        w = words(text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, math.inf), order(d))
    out = []
    for d, text in rows:
        w = words(text)
        gone = {i + o for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < order(d) for o in range(13)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_substrings(spark, docs):
    want = brute_substrings([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(str, collected(substrings.substring_report(docs)))) == sorted(map(str, want))


def test_substring_groups_stay_small_and_whole(spark, docs):
    groups, many = substrings.prefix_groups(substrings._keyed(docs), group_bytes=2_000)
    assert many > 10 and (groups[0] < 0).any() and (groups[-1] >= 0).all()


def test_substrings_of_many_texts_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(1, passage)] + [(None, " ".join(f"k{k}x{i}" for i in range(k % 40)) + f" {passage if k % 3 else k}") for k in range(1_200)]
    got = collected(substrings.substring_report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert Counter(got) == Counter(brute_substrings(rows))


def test_line_dedup(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    want = []
    for d, text in rows:
        own = (text or "").split("\n")
        left = [line for line in own if len(holders[key(line)]) < 5 or max(x for x in holders[key(line)] if x is not None) == d]
        want.append((d, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    assert sorted(map(str, collected(lines.line_report(docs)))) == sorted(map(str, want))


def test_near_duplicates(spark):
    near = BASE.replace("w30", "changed")
    far = " ".join(f"w{i}" if i % 9 else f"q{i}" for i in range(60))
    rows = [(5, BASE), (3, near), (9, BASE), (1, far), (2, None), (4, ""), (7, "a b"), (8, "A  B"), (6, "b a"), (9, BASE), (None, near)]
    edited = [(100 + k, " ".join(f"e{i}" if i != k else f"e{i}x{k}" for i in range(50))) for k in range(40)]
    docs = spark.createDataFrame(rows + edited, "doc_id bigint, text string")
    sets = {}
    for d, text in rows + edited:
        w = words((text or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in sets}
    order = lambda d: math.inf if d is None else d
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and order(root[b]) < order(root[a]):
                    root[a], changed = root[b], True
    want = Counter((d, len(sets[d]), root[d], d == root[d]) for d, _ in rows + edited)
    assert Counter(collected(near_duplicates.near_report(docs))) == want


def test_table_keys_pair_all_values_of_each_text(spark):
    """Twenty pairs of texts without an id, of one size: all 120 keys of each, shared with its copy alone."""
    rows = [(near_duplicates.NO_ID, k, 40, [k % 20 * 100 + g for g in range(16)]) for k in range(40)]
    keys = near_duplicates.table_keys(spark.createDataFrame(rows, "id bigint, node bigint, n bigint, signature array<bigint>"))
    assert Counter(keys.groupBy("key").count().select("count").toPandas()["count"]) == {2: 20 * 120}


def test_near_duplicates_of_rows_without_an_own_id(spark):
    text = lambda name, at=-1: " ".join(f"{name}{i}" if i != at else "changed" for i in range(60))
    rows = [(5, text("a")), (900, text("b")), (None, text("a", 30)), (None, text("b", 30)), (7, text("e")), (7, text("f")), (7, text("e", 30)), (8, text("f", 30))]
    rows += [(None, text(f"own{k}x")) for k in range(30)] + [(None, text("own0x")), (None, text("own1x", 30)), (None, None), (None, " "), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    report = collected(near_duplicates.near_report(docs).select("doc_id", "component_id", "kept"))
    want = {(5, 5, True): 1, (900, 900, True): 1, (None, 5, False): 1, (None, 900, False): 1, (7, 7, True): 2, (7, 7, False): 1, (8, 7, False): 1, (None, None, True): 34, (None, None, False): 1}
    assert Counter(report) == want
    left = Counter(collected(near_duplicates.one_of_each(docs, ["doc_id", "text"])))
    named = [r for r in left if r[0] is not None]
    assert len(named) == 4 and {(5, text("a")), (900, text("b"))} < set(named) and {d for d, _ in named} == {5, 7, 900}
    assert left[None, None] == 1 and left[None, " "] == 2 and sum(left.values()) == 4 + 30 + 3 and left[None, text("own0x")] == 1


def test_chat_round_trip_and_parts(spark):
    for text in ("</s>[INST] ok [/INST]", "\\", "<\\<[[\\]", "", "a\nb"):
        assert chat.unescape(chat.escape(text)) == text and "</s>" not in chat.escape(text) and "[INST]" not in chat.escape(text)
    parts = [("text", "see <this>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    first, second = chat.format_turns(df).orderBy("turn").collect()
    assert [a["tokens"] for a in first["attachments"]] == [4, 50, 3072, 1] and first["expanded_tokens"] == 3127
    assert "<image:1><audio:2><document:3><other:4>" in first["formatted"] and second["loss_end"] == 0
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, None, None, None)]
    got = {r["conv_id"]: r for r in chat.chat_report(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"xx").hexdigest() and got[None]["n_turns"] == 1


def test_blocks_are_written_between_scans(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 10))) for i in range(40)], "item_id bigint, text string")
    cuts = []
    monkeypatch.setattr(decontaminate, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    want = sorted(map(str, collected(decontaminate.leak_report(docs, bench))))
    assert not cuts
    found = decontaminate.find_leaks(docs, bench, block_bytes=600)
    assert len(cuts) > 3 and sum(len(r["hits"]["word_spans"]) > 0 for r in found.collect()) == sum("True" in w for w in want)


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(materialise.permute(np.arange(n), n)) == list(range(n))
    assert list(materialise.permute(np.arange(1000), 1000, 1)) != list(materialise.permute(np.arange(1000), 1000, 2))


def tokens_of():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(materialise.TOKENIZER, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=materialise.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: [*coder.encode_ordinary(text or ""), materialise.END]


def test_token_shards(spark, docs, tmp_path):
    """Every payload, in the shard files and in the rows read back, is the tokens of its document."""
    index = materialise.write_shards(materialise.in_training_order(docs, shard=16), str(tmp_path / "out"))
    rows = materialise.read_shards(index).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    encode = tokens_of()
    want = Counter()
    for r in docs.collect():
        tokens = encode(r["text"])
        for k in range(0, len(tokens), 512):
            own = tokens[k : k + 512]
            want[r["doc_id"], k // 512, len(own), np.array(own + [materialise.END] * (512 - len(own)), dtype="<u2").tobytes()] += 1
    assert Counter((r["doc_id"], r["seq_no"], r["n_tokens"], bytes(r["payload"])) for r in rows) == want
    files = {r["path"]: r["shard"] for r in index.collect()}
    assert sorted(files.values()) == list(range(-(-len(rows) // 16)))
    by_slot = {r["slot"]: bytes(r["payload"]) for r in rows}
    for path, shard in files.items():
        data = open(path, "rb").read()
        assert data == b"".join(by_slot[k] for k in range(16 * shard, min(16 * shard + 16, len(rows))))
    for slot in (0, 17, len(rows) - 1):
        assert materialise.read_slot(index, slot).tobytes() == by_slot[slot]


def test_shards_are_written_in_passes_that_leave_no_shuffle(spark, docs, tmp_path, monkeypatch):
    """The passes write what one would; no pass takes much more than its part, and its shuffle files are gone when it ends."""
    want = Counter(map(str, materialise.in_training_order(docs, shard=16).collect()))
    made, held, write = [], [], materialise.write_shards
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in map(str, blocks.getAllBlocks().mkString(" ").split()) if b.startswith("shuffle_")}

    def watched(ordered, *given):
        made.append(ordered.count())
        before = shuffles()
        out = write(ordered, *given)
        held.append(shuffles() - before)
        return out

    monkeypatch.setattr(materialise, "write_shards", watched)
    folder = str(tmp_path / "out")
    rows = materialise.token_shards(docs, folder=folder, shard=16).collect()
    assert Counter(map(str, rows)) == want and len(made) == materialise.PASSES and sum(made) == len(rows)
    assert max(made) <= len(rows) / materialise.PASSES + 16 and not any(held)
    index = spark.read.parquet(f"{folder}/index")
    assert index.select("path").distinct().count() == index.select("shard").distinct().count() == -(-len(rows) // 16)
    assert spark.conf.get(materialise.CLEANUP) == "false" and materialise.token_shards(docs.limit(0)).count() == 0


def test_slots_do_not_depend_on_splits(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    source.withColumn("text", F.concat("text", F.repeat(F.lit(" more words"), 400))).repartition(5).write.option("parquet.block.size", 20_000).parquet(str(tmp_path / "d"))
    found, settings = [], ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for size in ("134217728", "40000"):
        for name in settings:
            spark.conf.set(name, size)
        try:
            docs = spark.read.parquet(str(tmp_path / "d"))
            found.append((docs.rdd.getNumPartitions(), {(r["doc_id"], r["seq_no"]): r["slot"] for r in materialise.in_training_order(docs).collect()}))
        finally:
            for name in settings:
                spark.conf.unset(name)
    assert found[0][0] != found[1][0] and found[0][1] == found[1][1]


def test_windows_of_slots():
    for n, window in ((0, 4), (3, 4), (4, 4), (103, 10), (1000, 64)):
        index = np.random.default_rng(n).permutation(n)
        got = materialise.slots(index, n, window)
        assert sorted(got) == list(range(n)) and (got // window == index // window).all()
    first, second = materialise.slots(np.arange(128), 128, 64)[:64], materialise.slots(np.arange(128), 128, 64)[64:] - 64
    assert list(first) != list(second)


def test_slots_follow_the_ramps(spark):
    """Of two sources of one size, the one whose weight falls has the greater part of the first tenth of slots, and the lesser of the last."""
    rows = [(k, f"words {k} of a short text", "en", f"s{k % 2 * 2}", 1) for k in range(4_000)] + [(9_000, "one", "en", "s1", 1)]
    mixed = curriculum.materialise(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), ["doc_id", "text", "source"])
    folder = f"{checkpoint_dir(spark)}/mixed-{uuid.uuid4().hex}"
    mixed.write.parquet(folder)
    slots = {r["slot"]: "s2" if r["doc_id"] % 2 else "s0" for r in materialise.in_training_order(spark.read.parquet(folder), window=64).collect()}
    part = lambda ks: sum(slots[k] == "s2" for k in ks) / len(ks)
    tenth = len(slots) // 10
    early, late = part(range(tenth)), part(range(len(slots) - tenth, len(slots)))
    assert early < part(range(len(slots))) < late and late > 2 * early


def test_mixing(spark, docs):
    rows = curriculum.mix_report(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {r["source_size"]: r["target"] for r in rows}
    assert all(t <= 2 * s + 1e-6 for s, t in by.items())
    assert sorted(map(str, rows)) == sorted(map(str, curriculum.mix_report(docs).collect()))
    out = curriculum.materialise(docs, ["doc_id", "text", "lang", "source", "n_chars"])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.filter("doc_id = 18").count() <= 2


def test_mixing_of_equal_rows_and_rows_without_an_id(spark, monkeypatch):
    """Against plain sums: positions, shares of equal rows, and pieces smaller than a group of copies."""
    monkeypatch.setattr(curriculum, "PIECE", 7)
    rows = [(None, None, "b")] * 50 + [(None, f"t{k} u", "b") for k in range(40)] + [(3, f"v{k}", "a") for k in range(30)] + [(4, "w x y", None)] * 20 + [(k, "z " * (k % 5), "a") for k in range(10, 30)]
    got = curriculum.mix_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    size = lambda text: len(words(text))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    weights, want, left = {"a": 5, "b": 2, None: 1}, {}, dict(total)
    goal = 1.5 * sum(total.values())
    while left:
        level = (goal - sum(want.values())) / sum(weights[s] for s in left)
        full = [s for s in left if level * weights[s] > 2 * left[s]]
        for s in full or list(left):
            want[s] = 2.0 * left.pop(s) if full else level * weights[s] + 0 * left.pop(s)
    by_size = {total[s]: want[s] for s in total}
    taken = Counter()
    for r in got:
        assert abs(r["target"] - by_size[r["source_size"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[r["source_size"]] += r["taken"]
    assert all(by_size[n] - 30 <= t <= by_size[n] + 1e-6 for n, t in taken.items())
    positions = [r["position"] for r in got if r["position"] is not None]
    assert positions == sorted(positions) and all(r["position"] is None for r in got[len(positions):])


def brute_quality(rows):
    holders, out = defaultdict(set), []
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for d, text, host in rows:
        for line in (text or "").split("\n"):
            holders[host, key(line)].add(d)
    for d, text, host in rows:
        w, own = words(text), [line for line in (text or "").split("\n") if words(line)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = Counter(grams)
        repeated = len({i + o for i, g in enumerate(grams) if count[g] > 1 for o in range(3)})
        lost = sum(len(words(line)) for line in own if len(holders[host, key(line)]) > 10)
        failed = len(w) < 50 or 100 * repeated > 50 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), repeated, lost, failed, not failed and (len(w) - lost) * 2 >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("sent", [100_000, 0])
def test_quality_rules(spark, docs, monkeypatch, sent):
    """The limit is a number of documents however large a host is; beyond the broadcast bound the rows are the same."""
    monkeypatch.setattr(line_quality, "SENT_ROWS", sent)
    filler = lambda k: " ".join(f"f{k}x{i}" for i in range(20))
    more = [(100 + k, f"\tShared LINE {' '.join(map(str, range(60)))} \n{filler(k)}" if k < 11 else f"ten only\n{filler(k)} {BASE}" if k < 21 else f"{filler(k)} {BASE}\nrow", "en", "big", 1) for k in range(600)]
    more += [(800 + k, f"shared line {' '.join(map(str, range(60)))}\n{filler(k)}", "en", None, 1) for k in range(12)] + [(None, "row\nrow", "en", None, 1)] * 15
    every = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    want = brute_quality([(r["doc_id"], r["text"], r["source"]) for r in every.collect()])
    assert Counter(collected(line_quality.quality_rules(every.withColumns({"host": F.lit(1), "line": F.lit(2), "t1": F.lit(3), "windows": F.lit(4)})))) == want
    assert {r[0] for r in want if not r[7] and not r[8]} == {*range(100, 111), *range(800, 812)}


def test_toxicity_keeps_the_base_rate(spark):
    """Nine of ten labels are clean and half of the sample is toxic: a text without any known word is scored at the rate of the labels."""
    rows = [(k, f"plain{k % 7} words here" if k % 10 else "vile nasty words", int(k % 10 == 0)) for k in range(3_000)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    assert toxicity.base_rate_shift({0: 900, 1: 100}, {0: 50, 1: 50}) == pytest.approx(math.log(1 / 9)) and toxicity.base_rate_shift({0: 9}, {0: 5}) == 0
    even, model = toxicity.fit(toxicity.labelled_sample(docs, labels, F.col("toxic"), 300, classes=(0, 1)), toxicity.learn), toxicity.train(docs, labels, 300)
    assert {k: v for k, v in model.items() if k != toxicity.BIAS} == {k: v for k, v in even.items() if k != toxicity.BIAS}
    assert model[toxicity.BIAS] - even.get(toxicity.BIAS, 0.0) == pytest.approx(math.log(1 / 9), abs=0.2)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (None, "vile nasty words"), (4, "x " * 300_000), (4, "x " * 300_000)], "doc_id bigint, text string").withColumns({"score": F.lit("s"), "held_out": F.lit(0), "target": F.lit(1)})
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(odd, model).collect()]
    assert len(got) == 6 and len({s for d, s in got if d in (1, 2, 3)}) == 1 and dict(got)[None] > max(s for d, s in got if d is not None)


def test_classifiers_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    toxic = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").filter("held_out").selectExpr("avg(cast(predicted = toxic as int)) as right", "sum(case when predicted = 1 and toxic = 0 then 1 else 0 end) / count(*) as wrong").first()
    assert toxic["right"] > 0.95 and toxic["wrong"] < 0.01
    good = quality.quality_report(docs, labels).join(labels, "doc_id").filter("held_out").selectExpr("avg(case when quality = 1 then cast(kept as int) end) as kept", "avg(case when quality = 0 then cast(kept as int) end) as passed").first()
    assert good["kept"] > 0.99 and good["passed"] < 0.05


def test_word_hashes_do_not_depend_on_place():
    a, b = Chunk([b"x alpha beta"]), Chunk([b"alpha", b"  beta gamma"])
    assert list(a.hash[1:]) == list(b.hash[:2]) and list(b.counts) == [1, 2]


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        assert name == "mixing" or docs.count() <= before
        before = docs.count()
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
