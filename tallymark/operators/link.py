"""Same-product linkage: pair score, leader clusters, party links, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators import carry
from tallymark.operators.filters import clean_sentinel
from tallymark.session import cut_lineage

# fixed values: reward and penalty per attribute of an identity
WEIGHTS = {
    "model": (0.55, 0.35), "sku": (0.50, 0.30), "category": (0.15, 0.50), "brand": (0.30, 0.45), "name": (0.35, 0.40),
    "variant": (0.15, 0.35), "maker": (0.15, 0.0), "pack": (0.10, 0.35), "batch": (0.05, 0.0),
}
CONTAINS = ("name", "maker")
MATCHED, REVIEW = 0.70, 0.45
ALL_PANELS = ("FRONT", "BACK", "LEFT", "RIGHT", "TOP", "BOTTOM", "SIDE")


def identity(df: DataFrame, columns: dict[str, Column], out: str = "ident") -> DataFrame:
    """Add the cleaned identity struct; attributes that are absent are null."""
    parts = [F.lower(clean_sentinel(columns[n])).alias(n) if n in columns else F.lit(None).cast("string").alias(n) for n in WEIGHTS]
    return df.withColumn(out, F.struct(*parts))


def pair_score(a: Column, b: Column) -> Column:
    """Confidence in [0, 1] that two identities are the same product."""
    score = F.lit(0.0)
    for name, (gain, loss) in WEIGHTS.items():
        x, y = a[name], b[name]
        same = x == y
        if name in CONTAINS:
            same = same | F.contains(x, y) | F.contains(y, x)
        score = score + F.when(same, gain).when(x.isNotNull() & y.isNotNull(), -loss).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def match_status(score: Column) -> Column:
    return F.when(score >= MATCHED, "MATCHED").when(score >= REVIEW, "NEEDS_REVIEW").otherwise("NOT_MATCHED")


def anchor_matches(images: DataFrame, session: str, ord_col: str) -> DataFrame:
    """Score of every image against the first image of its session.

    One anchor row per session joins the images, so the work is linear in the
    images however large a session is.
    """
    first = images.groupBy(session).agg(F.min_by(F.struct(F.col(ord_col).alias("anchor_ord"), F.col("ident")), F.col(ord_col)).alias("a"))
    both = images.join(first, session).filter(F.col(ord_col) > F.col("a.anchor_ord"))
    both = both.withColumn("score", pair_score(F.col("a.ident"), F.col("ident")))
    return both.withColumn("anchor", F.col("a.anchor_ord")).withColumn("status", match_status(F.col("score"))).drop("a")


GRAM = 3


def _block_keys(nodes: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """Keys that every two matching identities share: (asking rows, answering rows).

    By the weights above a score of 0.70 is out of reach unless one of these
    holds: equal models; equal SKUs; equal brands with two of category, variant
    and pack; or one name inside the other with an equal brand, category or
    variant.  For the last a name asks by its rarest three letters and answers
    by all of its letter triples; names of one or two letters ask by the
    attribute alone.
    """
    ident = lambda n: F.col(f"ident.{n}")

    def key(kind: str, *parts: Column) -> Column:
        whole = parts[0].isNotNull()
        for p in parts[1:]:
            whole = whole & p.isNotNull()
        return F.when(whole, F.xxhash64(F.lit(kind), *parts))

    equal = [key("model", ident("model")), key("sku", ident("sku"))]
    equal += [key("".join(two), ident("brand"), *[ident(n) for n in two]) for two in (("category", "variant"), ("category", "pack"), ("variant", "pack"))]
    equal_rows = nodes.select(session, "o", "ident", F.explode(F.array_compact(F.array(*equal))).alias("key"))
    name = ident("name")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - (GRAM - 1)), lambda i: F.substring(name, i, F.lit(GRAM))))
    kinds = F.filter(F.array(*[F.struct(F.lit(n).alias("kind"), ident(n).alias("value")) for n in ("brand", "category", "variant")]), lambda k: k["value"].isNotNull())
    named = nodes.filter(name.isNotNull()).select(session, "o", "ident", F.explode(kinds).alias("k"), F.when(F.length(name) >= GRAM, grams).otherwise(F.array().cast("array<string>")).alias("grams"))
    short = F.size("grams") == 0
    parts = named.select(session, "o", "ident", "k.kind", short.alias("short"), F.col("k.value").alias("value"), F.explode(F.concat("grams", F.array(F.lit("")))).alias("gram"))
    answers = cut_lineage(parts.select(session, "o", "ident", "kind", "short", (F.col("gram") == "").alias("bare"), F.xxhash64("kind", "value", "gram").alias("key")))
    often = answers.groupBy(session, "key").agg(F.count(F.lit(1)).alias("many"))
    rarest = F.min_by("key", F.struct(F.col("bare") != F.col("short"), "many", "key"))
    asks = answers.join(often, [session, "key"]).groupBy(session, "o", "kind").agg(F.first("ident").alias("ident"), rarest.alias("key")).select(session, "o", "ident", "key", F.lit(False).alias("equal"))
    return (equal_rows.withColumn("equal", F.lit(True)).unionByName(asks),
            equal_rows.withColumn("equal", F.lit(True)).unionByName(answers.select(session, "o", "ident", "key", F.lit(False).alias("equal"))))


def match_edges(nodes: DataFrame, session: str) -> DataFrame:
    """(session, a, b) of all distinct identities a < b of a session that match; only pairs of a common key are scored."""
    asks, answers = _block_keys(nodes, session)
    other = answers.select(session, "key", "equal", F.col("o").alias("o2"), F.col("ident").alias("ident2"))
    met = asks.join(other, [session, "key", "equal"]).filter((F.col("o") < F.col("o2")) | (~F.col("equal") & (F.col("o") != F.col("o2"))))
    return met.filter(pair_score(F.col("ident"), F.col("ident2")) >= MATCHED).select(session, F.least("o", "o2").alias("a"), F.greatest("o", "o2").alias("b")).distinct()


def leader_clusters(images: DataFrame, session: str, ord_col: str) -> DataFrame:
    """Cluster of each image: the first earlier leader that matches it, else itself.

    Exact, without comparing all pairs.  Equal identities are collapsed first.
    An identity whose match with itself stays below the cut-off can match
    nothing (no partner scores higher than it does), so it is a cluster of its
    own.  The others meet by keys (:func:`match_edges`).  On the sparse list of
    matches, an identity without an open earlier match leads and those it
    matches follow; both leave, until no match is open.  That takes as many
    rounds as the longest chain of leaders that wait for one another.  Returns
    (session, ord, cluster_ord).
    """
    keyed = images.select(session, ord_col, "ident").withColumn("_self", pair_score(F.col("ident"), F.col("ident")))
    alone = keyed.filter(F.col("_self") < MATCHED).select(session, ord_col, F.col(ord_col).alias("cluster_ord"))
    able = keyed.filter(F.col("_self") >= MATCHED)
    unique = cut_lineage(able.groupBy(session, "ident").agg(F.min(ord_col).alias("o")))
    edges = cut_lineage(match_edges(unique, session))
    open_, followers = edges, None
    while not open_.isEmpty():
        leading = open_.select(session, "a").join(open_.select(session, F.col("b").alias("a")), [session, "a"], "left_anti").distinct()
        led = cut_lineage(open_.join(leading, [session, "a"], "left_semi").select(session, "b").distinct())
        followers = led if followers is None else followers.unionByName(led)
        open_ = cut_lineage(open_.join(led, [session, "b"], "left_anti").join(led.withColumnRenamed("b", "a"), [session, "a"], "left_anti"))
    own = unique.select(session, "ident", "o")
    if followers is not None:
        first = edges.join(followers.withColumnRenamed("b", "a"), [session, "a"], "left_anti").join(followers, [session, "b"], "left_semi")
        first = first.groupBy(session, F.col("b").alias("o")).agg(F.min("a").alias("leader"))
        own = own.join(first, [session, "o"], "left")
    else:
        own = own.withColumn("leader", F.lit(None).cast(unique.schema["o"].dataType))
    done = own.select(session, "ident", F.coalesce("leader", "o").alias("cluster_ord"))
    joined = able.alias("i").join(done.alias("d"), (F.col(f"i.{session}") == F.col(f"d.{session}")) & F.col("i.ident").eqNullSafe(F.col("d.ident")))
    return joined.select(F.col(f"i.{session}").alias(session), F.col(f"i.{ord_col}").alias(ord_col), "cluster_ord").unionByName(alone)


# Parties of a product up to which one task links them.
MOST_PARTIES = 1_000


def _party() -> Column:
    return F.struct(F.col("_ord").alias("ord"), "image_id", "name", "address", "confidence", "role")


def _by_key(parties: DataFrame, product: str) -> DataFrame:
    """Each party under its role and under its name: the chains differ in their key only."""
    keys = F.array(F.concat(F.lit("r:"), F.upper("role")), F.concat(F.lit("n:"), F.lower(F.trim("name"))))
    return parties.select(product, F.explode(F.array_compact(keys)).alias("_key"), "image_id", _party().alias("party"))


def _links_in_place(parties: DataFrame, product: str, rows: int) -> DataFrame:
    """Distinct linked parties (product, a, b) of products of few parties; these are sent once, and all else is done where they are."""
    e = _by_key(carry.together(parties, product, rows), product)
    shown = e.groupBy(product, "_key", "image_id").agg(F.sort_array(F.collect_set("party")).alias("own")).withColumn("first", F.get("own", F.lit(0)))
    chain = Window.partitionBy(product, "_key").orderBy("first.ord", "image_id")
    image = F.struct("image_id", "first")
    step = shown.withColumn("_before", F.lag(image).over(chain)).withColumn("_after", F.lead(image).over(chain))
    none = F.filter(F.transform("own", lambda p: F.struct(p.alias("a"), p.alias("b"))), lambda p: F.lit(False))
    # The first parties of two images are linked from the later one, if it is a known image.
    ahead = F.when(F.col("_after.image_id").isNull(), F.col("own")).otherwise(F.slice("own", F.lit(2), F.size("own")))
    both = F.concat(
        F.when(F.col("image_id").isNotNull() & F.col("_before.image_id").isNotNull(), F.transform("own", lambda p: F.struct(F.col("_before.first").alias("a"), p.alias("b")))).otherwise(none),
        F.when(F.col("image_id").isNotNull() & F.col("_after").isNotNull(), F.transform(ahead, lambda p: F.struct(p.alias("a"), F.col("_after.first").alias("b")))).otherwise(none))
    return step.select(product, F.inline(both)).dropDuplicates([product, "a", "b"])


def _links_across(parties: DataFrame, product: str, segment_size: int) -> DataFrame:
    """The same for products of any number of parties, whose chains are cut into segments."""
    e = _by_key(parties, product)
    shown = e.groupBy(product, "_key", "image_id").agg(F.min("party").alias("first")).withColumn("at", F.col("first.ord")).withColumn("_seg", F.floor(F.col("at") / segment_size))
    before = carry.lag_across(shown, [product, "_key"], "_seg", ["at"], ["image_id", "first"], prefix="p_").filter("p_image_id is not null")
    # Both ends of a step look for the parties of an image: one join finds them.
    ends = before.select(product, "_key", F.explode(F.array(
        F.struct(F.col("image_id"), F.col("p_first").alias("other"), F.lit(False).alias("later")),
        F.struct(F.col("p_image_id").alias("image_id"), F.col("first").alias("other"), F.lit(True).alias("later")))).alias("s")).select(product, "_key", "s.*")
    met = e.join(ends, [product, "_key", "image_id"])
    return met.select(product, F.when(F.col("later"), F.col("party")).otherwise(F.col("other")).alias("a"), F.when(F.col("later"), F.col("other")).otherwise(F.col("party")).alias("b")).dropDuplicates([product, "a", "b"])


def entity_links(entities: DataFrame, product: str = "product_id", ord_col: str = "ord", segment_size: int = 10_000) -> DataFrame:
    """Links of parties across panels: same role or same name.

    The images of a product that show a role (or a name) follow one another.
    The first party of each image is linked with every party of the image
    before, and every party with the first one of the image before.  That
    connects exactly the parties that a list of all pairs of different images
    would connect, with two rows a party at most instead of one a pair; address
    parts of both ends are joined.  A product of few parties is linked by one
    task, the chains of others are cut into segments.
    """
    e = entities.filter(F.col(product).isNotNull() & F.col("name").isNotNull() & (F.col("name") != "NOT_VISIBLE")).withColumn("_ord", F.col(ord_col))
    large, rows = carry.crowded(e, product, MOST_PARTIES)
    if large is None:
        both = _links_in_place(e, product, rows)
    else:
        both = _links_in_place(e.join(large, product, "left_anti"), product, rows).unionByName(_links_across(e.join(large, product, "left_semi"), product, segment_size))
    one, other = F.col("a.address"), F.col("b.address")
    address = F.when(one == other, other).otherwise(F.concat_ws(", ", one, other))
    lead = F.when(one.isNull() & other.isNotNull(), F.col("b.name")).otherwise(F.col("a.name"))
    return both.select(
        product, F.concat(F.upper("a.role"), F.lit("_LINK")).alias("entity_type"), F.col("a.image_id").alias("source_image_id"), F.col("b.image_id").alias("target_image_id"),
        F.round(F.least("a.confidence", "b.confidence"), 2).alias("confidence"), F.concat_ws(" — ", lead, F.nullif(address, F.lit(""))).alias("linked_value"))


def panel_completeness(images: DataFrame, product: str = "product_id") -> DataFrame:
    """Available and missing panels; the set is bounded by the panel vocabulary."""
    panel = F.upper(F.coalesce("panel", F.lit("UNKNOWN")))
    known = images.withColumn("_p", panel).withColumn("_p", F.when(F.col("_p").isin(*ALL_PANELS), F.col("_p")))
    sets = known.groupBy(product).agg(F.sort_array(F.collect_set("_p")).alias("available_panels"))
    return sets.withColumn("missing_panels", F.array_except(F.array(*[F.lit(p) for p in ALL_PANELS]), "available_panels"))


def merged_entities(entities: DataFrame, product: str = "product_id", ord_col: str = "ord") -> DataFrame:
    """Distinct (role, name) of a product; the first report wins."""
    keys = [product, F.upper("role").alias("role_key"), F.lower(F.trim("name")).alias("name_key")]
    body = F.struct(*[F.col(c) for c in entities.columns if c != product])
    return entities.filter("name is not null").groupBy(*keys).agg(F.min_by(body, F.col(ord_col)).alias("e")).select(product, "e.*")


def panel_graph(images: DataFrame, fields: DataFrame, sources: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of product, panels, fields and links."""
    pid = lambda: F.concat(F.lit("prod:"), F.col("product_id"))
    panel = lambda c: F.concat(F.lit("panel:"), F.col("product_id"), F.lit(":"), F.col(c))
    field = lambda: F.concat(F.lit("field:"), F.col("product_id"), F.lit(":"), F.col("field_name"))
    shown = fields.filter((F.coalesce(F.col("value"), F.lit("")) != "") | F.col("status").isin("CONFIRMED", "NEEDS_REVIEW", "CONFLICT"))
    node = lambda df, nid, kind, label: df.select("product_id", nid.alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"))
    nodes = (
        node(images.select("product_id").distinct(), pid(), "PRODUCT", F.col("product_id"))
        .unionByName(node(images, panel("image_id"), "PANEL", F.col("panel")))
        .unionByName(node(shown, field(), "FIELD", F.concat_ws(": ", "field_name", F.coalesce("value", F.lit("CONFLICT")))))
    )
    edge = lambda df, s, t, rel: df.select("product_id", s.alias("source"), t.alias("target"), F.lit(rel).alias("relation"))
    edges = (
        edge(images, pid(), panel("image_id"), "HAS_PANEL").unionByName(edge(shown, pid(), field(), "HAS_FIELD"))
        .unionByName(edge(sources, panel("image_id"), field(), "OWNS"))
        .unionByName(edge(links, panel("source_image_id"), panel("target_image_id"), "LINKED_TO"))
    )
    return nodes, edges


def identity_graph(entities: DataFrame, product: str = "product_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges brand -> product and role -> name -> address -> PIN (or model)."""
    nid = lambda kind, label: F.concat_ws(":", F.lit(kind), F.col(product), F.coalesce(label, F.lit("")))
    node = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(nid(kind, F.col(c)).alias("node_id"), F.lit(kind).alias("node_type"), F.col(c).alias("label")))
    nodes = entities.select(product, F.inline(F.array_compact(F.array(
        node("BRAND", "brand"), node("PRODUCT", "product_name"), node("ROLE", "role"), node("ENTITY_NAME", "name"), node("ADDRESS", "address"), node("PIN", "pin")))))
    edge = lambda a, ac, b, bc, rel, cond=None: F.when(
        F.col(ac).isNotNull() & F.col(bc).isNotNull() & (cond if cond is not None else F.lit(True)),
        F.struct(nid(a, F.col(ac)).alias("source"), nid(b, F.col(bc)).alias("target"), F.lit(rel).alias("relation")))
    edges = entities.select(product, F.inline(F.array_compact(F.array(
        edge("BRAND", "brand", "PRODUCT", "product_name", "OWNS_BRAND"), edge("ROLE", "role", "ENTITY_NAME", "name", "HAS_NAME"),
        edge("ENTITY_NAME", "name", "ADDRESS", "address", "LOCATED_AT"), edge("ADDRESS", "address", "PIN", "pin", "HAS_PIN"),
        edge("ENTITY_NAME", "name", "MODEL", "model_number", "HAS_MODEL", F.col("role") == "IMPORTER")))))
    return nodes.distinct(), edges.distinct()
