"""N-gram Jaccard join of whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import block_pairs, deal, jaccard_need, join_groups, large_groups
from .common import discard, lookup_join, mix64, slices, stash, table, utf8
from .components import connected_components, group_edges, shared_only
from .shingles import shingle_sets

WIDTH = 5
PERCENT = 80
#: The commonest shingles go last in the order of tokens; it is an order only and leaves nothing out.
COMMON_LIMIT = 200_000
#: One more than a set's size divided by this is how many tokens two sets that link must share among their first ones.
SHARED = 10
#: Rounds of dropping nodes that cannot reach that number. The second drops few, but these tie groups together.
PRUNING = 2
#: Tasks into which a common token's nodes are split before their smallest nodes meet.
SALTS = 64
#: Nodes of a token up to which its pairs are counted one by one; the nodes of a longer list are tied through the smallest.
LISTED = 32
_COUNTED = 4_000_000


def _node(s: np.ndarray) -> int:
    """Order-free hash of a set: equal sets are one node."""
    return int(mix64(np.array([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, shingle_sets(*utf8(part.column("text")), width)


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, node, n) for the documents, and (null, token, n) with the count of tokens that a task meets often."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["common", "doc_id", "node", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        seen: set[int] = set()

        def often(like: pa.RecordBatch) -> pa.RecordBatch:
            met = np.concatenate(pending)
            pending.clear()
            met.sort()
            tokens = np.unique(met[2:][met[2:] == met[:-2]])
            n = np.searchsorted(met, tokens, "right") - np.searchsorted(met, tokens)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), bool)), pa.nulls(len(tokens), like.schema.field("doc_id").type), pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], names)

        for part, sets in _sets(batches, width):
            n = np.array([len(s) for s in sets], np.int64)
            node = pa.array([_node(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), part.column("doc_id"), node, pa.array(n)], names)
            for s, name in zip(sets, node.to_pylist()):
                if name is not None and name not in seen:
                    seen.add(name)
                    pending.append(s)
            if sum(map(len, pending)) > _COUNTED:
                yield often(part)
        if pending:
            yield often(part)

    return docs.mapInArrow(run, f"common boolean, doc_id {kind}, node long, n long")


def _prefixes(docs: DataFrame, width: int, percent: int, common) -> DataFrame:
    """(key, node, salt, lead): the first tokens of each set in the global order; salt splits common tokens.

    Of a set of n tokens there are n - ceil(n * percent / 100) + l with l = 1 + n // SHARED: two sets that link have the
    smaller l of the two in common among them, and one at least among those that l = 1 would give, marked lead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = common.value
        done: set[int] = set()
        for _, sets in _sets(batches, width):
            found, nodes, salts, leads = [], [], [], []
            for s in sets:
                if not len(s) or (node := _node(s)) in done:
                    continue
                done.add(node)
                lead = len(s) - -(-len(s) * percent // 100) + 1
                n = min(lead + len(s) // SHARED, len(s))
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    often = np.where(tokens[at] == s, counts[at], 0)
                    order = np.argsort(often, kind="stable")[:n]
                    s, often = s[order], often[order]
                else:
                    often = np.zeros(n, np.int64)
                salts.append(np.where(often > 0, 1 + node % SALTS, 0).astype(np.int32))
                found.append(s[:n].view(np.int64))
                nodes.append(np.full(n, node, np.int64))
                leads.append(np.arange(n) < lead)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, nodes, salts, leads)], ["key", "node", "salt", "lead"])

    return docs.select("text").mapInArrow(run, "key long, node long, salt int, lead boolean")


def _split(members: DataFrame, large: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """The members(node, grp, size, ...), those of the large(grp) groups in smaller groups of nodes that may link with one another; others of these are left out.

    Nodes that share a token or two with each of several others, as happens by chance, are one group that grows with the corpus. Here the first tokens that two
    nodes share are counted pair by pair, of shared(key, node), and held against the number that a link takes. Pairs of a list of more than LISTED nodes are not
    made: such tokens count as if both nodes had them in common, and tie the nodes of like size that have as many of them as a link takes.
    """
    own = stash(lookup_join(members, large.select("grp"), "grp", "inner", salt="node").select(*members.columns))
    # Tokens that two groups share are told apart; a clash of hashes adds pairs to compare and loses none.
    met = lookup_join(shared.select("key", "node"), own.select("node", "grp", "size"), "node")
    met = stash(met.select(F.xxhash64("grp", "key").alias("key"), "node", F.col("size").cast("int").alias("size")))
    long = stash(met.groupBy("key").count().where(F.col("count") > LISTED).select("key"))
    tied = stash(lookup_join(met, long, "key", salt="node"))
    heat = stash(tied.groupBy("node").agg(F.count("*").cast("int").alias("heat"), F.first("size").alias("size")))
    listed = lookup_join(met, long.withColumn("long", F.lit(True)), "key", "left", salt="node").where(F.col("long").isNull())
    listed = lookup_join(listed, heat.select("node", "heat"), "node", "left")
    lists = listed.groupBy("key").agg(F.collect_list(F.struct("node", "size", F.coalesce("heat", F.lit(0)).alias("heat"))).alias("l"))
    a, size = F.col("a"), lambda x: x["size"]
    like = lambda b: (a["node"] < b["node"]) & (100 * F.least(size(a), size(b)) >= percent * F.greatest(size(a), size(b)))
    pairs = lists.where(F.size("l") > 1).select("l", F.explode("l").alias("a")).select("a", F.explode(F.filter("l", like)).alias("b"))
    need = 1 + F.floor(F.least("a.size", "b.size") / SHARED) - F.least("a.heat", "b.heat")
    pairs = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), need.cast("int").alias("need"))
    found = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).where(F.col("n") >= F.col("need")).select("a", "b")
    # Sizes of two nodes that link are in one band or in two that follow one another; bands are a little wider than that takes.
    band = F.floor(F.log("size") / F.log(F.lit(100.1 / percent)))
    able = stash(heat.where(F.col("heat") >= _least_shared(F.col("size"), percent)).select("node", band.alias("band")))
    tied = lookup_join(tied.select("key", "node"), able, "node").withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    tied = stash(tied.select(F.xxhash64("key", "band").alias("key"), "node"))
    low = stash(tied.groupBy("key").agg(F.min("node").alias("low")))
    across = lookup_join(tied, low, "key", salt="node").where(F.col("node") != F.col("low")).select(F.col("node").alias("a"), F.col("low").alias("b"))
    parts = connected_components(found.unionByName(across)).withColumnRenamed("component", "grp")
    rest = lookup_join(members, large.select("grp", F.lit(True).alias("cut")), "grp", "left", salt="node").where(F.col("cut").isNull())
    out = stash(rest.select(*members.columns).unionByName(own.drop("grp").join(parts, "node").select(*members.columns)))
    discard(own, met, long, heat, able, tied, low)
    return out


def _least_shared(size, percent: int):
    """How many of its first tokens a node of this size shares with each partner at least, as these have percent of its size or more."""
    return 1 + F.floor(F.ceil(size * percent / 100) / SHARED)


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Documents whose sets of word shingles have a Jaccard similarity of at least percent / 100, as classes.

    Equal sets are one node. Tokens have one global order, rare ones first, and two sets that link share a number of their
    first tokens that follows from their sizes; nodes that cannot reach it are dropped, those left that share a leading token, the rarest of the first ones, are connected, and the sets of each
    connected group are shipped once and joined exactly over a trie, in blocks of bounded size (``blocks``, ``trie``).
    The links found make the classes by distributed union-find.

    Returns (doc_id, n_shingles, component_id, n_links), one row per input row: the smallest id of the class, and the number of
    other documents linked with. Words are split at ASCII white space, A-Z lower-cased. A text of fewer words than the
    width is one shingle; a null or wordless text has none, links with nothing and is its own component. A null id is
    kept, and does not become a component id while its class has another. Repeated rows link with each other. Ids are of any type
    with an order; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    profile = stash(_profile(d, width))
    names = profile.where(~F.col("common")).select("doc_id", "node", "n")
    often = profile.where("common").groupBy(F.col("node").alias("token")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON_LIMIT).toPandas()
    tokens, counts = often["token"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    common = docs.sparkSession.sparkContext.broadcast((tokens[order], counts[order]))
    nodes = stash(names.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight"), F.max("n").alias("size")))
    shared = stash(shared_only(_prefixes(d, width, percent, common)))
    least = _least_shared(F.col("size"), percent)
    for left in reversed(range(PRUNING)):
        able = shared.groupBy("node").agg(F.count("*").alias("met")).join(nodes, "node").where(F.col("met") >= least).select("node")
        kept = shared.drop("low").join(able, "node")
        # The other tokens count; only the leading ones, the rarest, are needed to connect what links.
        last, shared = shared, stash(shared_only(kept if left else kept.where("lead")))
        if left:
            discard(last)
    edges = stash(group_edges(shared))
    groups = connected_components(edges).withColumnRenamed("component", "grp")
    discard(shared, edges)
    members = stash(groups.join(nodes, "node"))
    large = large_groups(members)
    if not large.isEmpty():
        members = _split(members, large, last, percent)
    discard(last)
    members = deal(members)
    wanted = stash(members.select("node", "weight", "grp", "blocks", "part", F.col("first").alias("doc_id")))
    rows = lookup_join(d, wanted, "doc_id")
    kept = ["node", "weight", "grp", "blocks", "part"]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, width):
            # Rows that share an id may have another text; only the node's own set goes on.
            own = [i for i, (w, s) in enumerate(zip(part.column("node").to_pylist(), sets)) if len(s) and _node(s) == w]
            tokens = pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(own, pa.int64())) for c in kept), tokens], [*kept, "tokens"])

    sets = rows.select(*kept, "text").mapInArrow(tokenize, "node long, weight long, grp long, blocks int, part int, tokens array<long>")
    links = stash(join_groups(block_pairs(sets), jaccard_need(percent)))
    classes = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = links.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.join(classes, "node", "left").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first", "weight", F.coalesce("links", F.lit(0)).alias("links"))
    info = stash(info)
    least = info.groupBy("component").agg(F.min("first").alias("component_id"))
    info = info.join(least, "component").select("node", "component_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))
    out = names.join(info, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
