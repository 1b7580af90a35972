"""Merkle manifest of a dataset, with octopus multiproofs for its leaf partitions.

Rows of one language are the leaves of a tree of eight children a node, in the
order of their ids; the roots of these trees are the leaves of a last tree.
Positions come from a range sort and one count for each partition, so a
language may hold all rows.

Leaves are dealt to partitions of 4,096 neighbours.  A partition hashes its own
part of the tree and names the nodes that it lacks: level by level, the children
of its known parents that it does not have, each once.  Levels above the
partitions are built 4,096 nodes a task.  The wanted nodes are fetched by one
join on their coordinates; each partition then derives the nodes that its leaves
share and expands every leaf's own proof, without more data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.lines import LOWER, UPPER
from tallymark.session import checkpoint_dir

FAN = 8
#: Levels within a leaf partition, which so has 4,096 leaves at most.
DEPTH = 4
#: Name of the tree over the roots; the others are called "" (null) or "=" and their value.
TOP = "^"
TAMPERED_EVERY = 3
NODE = "tree string, level int, idx bigint, digest binary"


def digest(text: str) -> bytes:
    return sha256(text.encode()).digest()


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, whose size Spark knows when it plans joins."""
    folder = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, doc_id, leaf, ...) with pos, their place within the tree by doc_id and leaf, size, the tree's rows, top_pos, the tree's place, and top_size.

    Only counts by partition and tree meet in a window over one tree, and only
    one row for each language in the window over all trees.  Rows that tie in
    everything are interchangeable and may be split over partitions.
    """
    order = ["tree", "doc_id", "leaf", "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    place = F.monotonically_increasing_id()
    placed = written(dealt.select("*", F.shiftright(place, 33).cast("int").alias("_part"), place.bitwiseAND(F.lit(2**33 - 1)).alias("_at")), "leaves")
    counts = placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_many"), F.min("_at").alias("_first"))
    own = Window.partitionBy("tree")
    starts = counts.select("tree", "_part", (F.sum("_many").over(own.orderBy("_part")) - F.col("_many") - F.col("_first")).alias("_shift"), F.sum("_many").over(own).alias("size"))
    starts = written(starts, "starts")
    trees = starts.select("tree").distinct()
    trees = trees.select("tree", (F.row_number().over(Window.orderBy("tree")) - 1).cast("bigint").alias("top_pos"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("top_size"))
    return placed.join(starts.join(trees, "tree"), ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def lift(digests: list[bytes], size: int, levels: int) -> Iterator[list[bytes]]:
    """The levels above neighbours that start at a multiple of ``FAN ** levels``; ``size`` counts the whole tree's nodes beside them."""
    while size > 1 and levels > 0:
        digests = [digest("".join(d.hex() for d in digests[i : i + FAN])) for i in range(0, len(digests), FAN)]
        size, levels = -(-size // FAN), levels - 1
        yield digests


def missing(known: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Level by level, the nodes beside the paths of the ``known`` leaves that these do not give, each once."""
    while size > 1:
        parents = np.unique(known // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        yield np.setdiff1d(children[children < size], known)
        known, size = parents, -(-size // FAN)


def _survey(block: pa.Table, depth: int) -> pa.Table:
    """Of one leaf partition: the root of its part (as a node) and the nodes that it lacks."""
    block = block.sort_by("pos")
    tree, number, size, top_pos, top_size = (block.column(c)[0].as_py() for c in ("tree", "block", "size", "top_pos", "top_size"))
    levels = [block.column("leaf").to_pylist(), *lift(block.column("leaf").to_pylist(), size, depth)]
    rows = [(tree, None, len(levels) - 1, number, levels[-1][0], -(-size // FAN**depth), top_pos, top_size)]
    for name, known, many in ((tree, block.column("pos").to_numpy(), size), (TOP, np.array([top_pos]), top_size)):
        rows += [(name, f"{number} {tree}", level, int(idx), *[None] * 4) for level, lacking in enumerate(missing(known, many)) for idx in lacking]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 3))], ["tree", "wanted_by", "level", "idx", "digest", "here", "top_pos", "top_size"])


def _raise(block: pa.Table, depth: int) -> pa.Table:
    """The nodes above one run of neighbours."""
    block = block.sort_by("idx")
    tree, level, first, size = (block.column(c)[0].as_py() for c in ("tree", "level", "idx", "here"))
    rows = []
    for up, digests in enumerate(lift(block.column("digest").to_pylist(), size, depth), start=1):
        rows += [(tree, level + up, first // FAN**up + i, d, -(-size // FAN**up)) for i, d in enumerate(digests)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))], ["tree", "level", "idx", "digest", "here"])


def grown(base: DataFrame, level: int, most: int, depth: int) -> DataFrame:
    """``base`` and all nodes above it: tree, level, idx, digest and here (number of nodes of that level of the tree).

    Trees that go on have their nodes at ``level``, ``most`` of them at most.
    """
    out, at = base, base
    while most > 1:
        runs = at.filter("here > 1").withColumn("run", F.expr(f"idx div {FAN**depth}")).groupBy("tree", "run")
        tier = written(runs.applyInArrow(lambda run: _raise(run, depth), f"{NODE}, here bigint"), "tier")
        level, most = level + depth, -(-most // FAN**depth)
        out, at = out.unionByName(tier), tier.filter(F.col("level") == level)
    return out


def _expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    """Every leaf's root, proof and fold, from the leaves of a partition and what it fetched."""
    leaves = leaves.sort_by("pos")
    size, top_pos, top_size = (leaves.column(c)[0].as_py() for c in ("size", "top_pos", "top_size"))
    pos, own = leaves.column("pos").to_pylist(), leaves.column("leaf").to_pylist()
    given: dict[tuple[bool, int], dict[int, bytes]] = {}
    for tree, level, idx, value in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
        given.setdefault((tree == TOP, level), {})[idx] = value

    def climb(known: dict[int, bytes], many: int, top: bool) -> tuple[list[dict[int, str]], bytes]:
        """The joined children of every parent on the way, by level, and the root."""
        groups, level = [], 0
        while many > 1:
            known = known | given.get((top, level), {})
            joined = {}
            for parent in {i // FAN for i in known}:
                joined[parent] = "".join(known[i].hex() for i in range(parent * FAN, min(parent * FAN + FAN, many)))
            groups.append(joined)
            known, many, level = {parent: digest(text) for parent, text in joined.items()}, -(-many // FAN), level + 1
        return groups, known[0]

    inner, subroot = climb(dict(zip(pos, own)), size, False)
    outer, root = climb({top_pos: subroot}, top_size, True)
    proofs, folds = [], []
    for start, leaf, shown in zip(pos, own, leaves.column("presented").to_pylist()):
        said, fold = sha256(), (leaf if shown is None else shown).hex()
        for place, groups in ((start, inner), (top_pos, outer)):
            for joined in groups:
                low = place % FAN * 64
                place //= FAN
                left, right = joined[place][:low], joined[place][low + 64 :]
                said.update((left + right).encode())
                fold = digest(left + fold + right).hex()
        proofs.append(said.hexdigest())
        folds.append(fold)
    n = len(pos)
    return pa.table([leaves.column("doc_id"), pa.array([d.hex() for d in own]), pa.array([subroot.hex()] * n), pa.array([root.hex()] * n), pa.array(proofs), pa.array(folds), pa.array([f == root.hex() for f in folds])],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, presented_text: Column | None = None, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Leaf partitions and nodes of ``docs`` (doc_id, source, lang, n_chars and text are read).

    Leaves: tree, pos, size, top_pos, top_size, block, doc_id, leaf, presented.
    Nodes: tree, wanted_by, level, idx, digest, here, top_pos, top_size; where
    wanted_by is null, the root of a partition, else a node that the partition
    so called lacks.

    ``presented_text`` stands for the text that is to be verified, where it is
    not null and differs; ``presented`` is its leaf.
    """
    key = F.when(docs["lang"].isNull(), "").otherwise(F.concat(F.lit("="), docs["lang"]))
    columns = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = leaf_hash(*columns, docs["text"])
    presented = F.lit(None).cast("binary") if presented_text is None else F.when(presented_text.isNotNull(), leaf_hash(*columns, presented_text))
    # Hashed once: the range sort reads its input twice.
    hashed = written(docs.select(key.alias("tree"), "doc_id", leaf.alias("leaf"), presented.alias("presented")), "hashed")
    leaves = numbered(hashed).withColumn("block", F.expr(f"pos div {FAN**depth}"))
    nodes = leaves.groupBy("tree", "block").applyInArrow(lambda block: _survey(block, depth), "tree string, wanted_by string, level int, idx bigint, digest binary, here bigint, top_pos bigint, top_size bigint")
    return leaves, written(nodes, "nodes")


def verified(leaves: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Every leaf with its roots, the digest of its proof, and the root that the presented leaf folds to."""
    parts, wanted = nodes.filter("wanted_by is null"), nodes.filter("wanted_by is not null").select("tree", "wanted_by", "level", "idx")
    most, trees = parts.agg(F.coalesce(F.max("here"), F.lit(0)), F.coalesce(F.max("top_size"), F.lit(0))).first()
    inner = grown(parts.select("tree", "level", "idx", "digest", "here"), depth, most, depth)
    tops = parts.select("tree", "top_pos", "top_size").distinct()
    outer = grown(inner.filter("here = 1").join(tops, "tree").select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.col("top_pos").alias("idx"), "digest", F.col("top_size").alias("here")), 0, trees, depth)
    by = F.split("wanted_by", " ", 2)
    fetched = wanted.join(inner.unionByName(outer), ["tree", "level", "idx"]).select(by[1].alias("tree"), by[0].cast("bigint").alias("block"), F.col("tree").alias("of"), "level", "idx", "digest")
    kind = leaves.schema["doc_id"].dataType.simpleString()

    def expand(own: pa.Table, other: pa.Table) -> pa.Table:
        return _expand(own, other.drop_columns(["tree", "block"]).rename_columns(["tree", "level", "idx", "digest"]))

    return leaves.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(
        expand, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def merkle_report(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The manifest of ``docs``, each leaf proved; where 3 divides the checksum of the id, the text shown is lower-cased.

    Nulls are ``-`` in a leaf, rows with a null id come first in their tree and
    are never tampered with, rows of one id are ordered by their leaves, and
    repeated rows are leaves of their own.  A null language is a tree of its
    own, apart from an empty one.  Texts are hashed whole.  An empty table has
    no rows.  Other columns are not read.
    """
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % TAMPERED_EVERY == 0
    return verified(*manifest(docs, F.when(tampered, F.translate(docs["text"], UPPER, LOWER)), depth), depth)


def _sql(levels: int = 8, top_levels: int = 3) -> str:
    """The same tree with one CTE for each level, enough for 8^8 rows of a language and 512 languages."""

    def said(columns: list[str]) -> str:
        return "sha256(" + " || ".join(f"case when {c} is null then '-' else octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar end" for c in columns) + ")"

    shown = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(doc_id::varchar)), lambda i: ascii(substr(doc_id::varchar, i::int + 1, 1))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    parts = [
        f"hashed as (select doc_id, lang, {said(['doc_id', 'source', 'lang', 'n_chars', 'text'])} as leaf, case when {crc} % 3 = 0 then {said(['doc_id', 'source', 'lang', 'n_chars', shown])} end as changed from documents)",
        "leaves as (select *, case when lang is null then '' else '=' || lang end as tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from hashed)",
        "n0 as (select tree, pos as idx, leaf as digest, count(*) over (partition by tree) as here from leaves)",
        "f0 as (select doc_id, tree, pos, leaf, coalesce(changed, leaf) as fold, '' as proof from leaves)",
    ]

    def climb(prefix: str, fold: str, count: int, place: str) -> str:
        for k in range(count):
            parts.append(f"{prefix}g{k} as (select tree, idx // 8 as parent, list(digest order by idx) as kids from {prefix}n{k} where here > 1 group by tree, idx // 8)".replace("nn", "n"))
            parts.append(f"{prefix}n{k + 1} as (select tree, parent as idx, sha256(array_to_string(kids, '')) as digest, count(*) over (partition by tree) as here from {prefix}g{k})")
            at = f"(({place} // {8**k}) % 8)::int"
            left, right = f"array_to_string(g.kids[1:{at}], '')", f"array_to_string(g.kids[{at} + 2:], '')"
            nxt = f"{prefix}f{k + 1}"
            parts.append(f"{nxt} as (select f.* replace (case when g.kids is null then fold else sha256({left} || fold || {right}) end as fold, case when g.kids is null then proof else proof || {left} || {right} end as proof) "
                         f"from {fold} f left join {prefix}g{k} g on g.tree = {'f.tree' if not prefix else chr(39) + TOP + chr(39)} and g.parent = {place} // {8 ** (k + 1)})")
            fold = nxt
        return fold

    fold = climb("", "f0", levels, "pos")
    parts.append("subroots as (" + " union all ".join(f"select tree, digest from n{k} where here = 1" for k in range(levels + 1)) + ")")
    parts.append(f"tn0 as (select '{TOP}' as tree, row_number() over (order by tree) - 1 as idx, digest, count(*) over () as here, tree as name from subroots)")
    parts.append(f"tf0 as (select f.*, t.digest as subroot, t.idx as top from {fold} f join tn0 t on t.name = f.tree)")
    fold = climb("t", "tf0", top_levels, "top")
    parts.append("roots as (" + " union all ".join(f"select digest as root from tn{k} where here = 1" for k in range(top_levels + 1)) + ")")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, fold as folded_root, fold = root as verified from {fold}, roots"


SQL = _sql()
