"""From groups of candidates to components, the part that the joins on word shingles share.

``linked_components`` takes for each text its set's size, digest (128 bits) and sketch, and key rows (key, id);
sets that can link share a key, as the caller's scheme guarantees. A node is the smallest id of the documents with one set
(equal digests), so copies are one node and a component's smallest node is its id.

Keys of one node alone go (least and greatest id by an aggregate). Groups of the same documents are one group from
the start, and groups of the same nodes are one group. Then:
1. each node is checked with the smallest fitting node among those of its groups;
2. each node with every such node still in another component;
3. groups that still have two components: those of one family, which have mostly the same nodes, become one
   where that saves pairs; then all pairs across components in blocks, bounded
   in bytes, inside tasks; first on sketches, then on the sets of the nodes that found a
   partner, each pair only in the first group that it shares; no pair is written but the links found.
Pairs meet the rule of the sketches first and then their whole sets. So no link between different
texts is lost, and a group of copies or near copies costs a row for each member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_texts, quoted, ship_package, small_batches, stage, text_slices, without
from .components import components
from .shingle_sets import Rule, Sketches, linked, pairs_may_link, set_digest, shingles, sketch

BLOCK = 256
BLOCK_BYTES = 4 << 20
#: Blocks on a side of a group whose payloads fit in as many; a member is copied twice as often at most.
SIDE = 8


class SetsOfTexts:
    """Size, digest and sketch of each text's set. ``heads(sets)``: what the sketches begin with."""

    def __init__(self, n: int, heads: Callable):
        self.n, self.heads = n, heads

    def __call__(self, texts):
        sets = [shingles(t, self.n) for t in texts]
        heads = iter(self.heads([s for s in sets if len(s)]))
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(heads) + sketch(s) if len(s) else None for s in sets], pa.binary())]


def key_rows(ids: pa.Array, digests: list, keys: Callable, given: set) -> pa.RecordBatch | None:
    """(sig, node) of rows whose set's digest isn't ``given`` yet; ``keys(places)``: the keys of the sets at these places."""
    new = []
    for i, d in enumerate(digests):
        if d is not None and d not in given:
            given.add(d)
            new.append(i)
    own = keys(new)
    if not new:
        return None
    nodes = np.repeat(ids.take(pa.array(new)).to_numpy(), [len(k) for k in own])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(nodes)], ["sig", "node"])


def keys_from_texts(n: int, keys: Callable) -> Callable:
    """Key rows made from the texts: ``keys(set)`` of each set, which a task gives once."""
    def rows(docs: DataFrame, keyed: DataFrame) -> DataFrame:
        def run(batches):
            given: set[bytes] = set()
            for batch in batches:
                done = 0
                for texts in text_slices(batch.column(1)):
                    ids = batch.column(0).slice(done, len(texts))
                    done += len(texts)
                    sets = [shingles(t, n) for t in texts]
                    made = key_rows(ids, [set_digest(s) if len(s) else None for s in sets], lambda new, sets=sets: [keys(sets[i]) for i in new], given)
                    if made is not None:
                        yield made

        return docs.mapInArrow(run, "sig long, node long")

    return rows


def keys_from_heads(head: int, keys: Callable) -> Callable:
    """Key rows made from the heads of stored sketches: ``keys(matrix of heads)``, a row of keys for each."""
    def rows(docs: DataFrame, keyed: DataFrame) -> DataFrame:
        def run(batches):
            given: set[bytes] = set()
            for batch in batches:
                sketches = batch.column(2).to_pylist()

                def of(new, sketches=sketches):
                    return list(keys(np.frombuffer(b"".join(sketches[i][:head] for i in new), np.uint8).reshape(-1, head))) if new else []

                made = key_rows(batch.column(0), batch.column(1).to_pylist(), of, given)
                if made is not None:
                    yield made

        return keyed.where("id is not null").select("id", "digest", "sketch").mapInArrow(run, "sig long, node long")

    return rows


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(node, shingles binary) of documents (node, text)."""
    def run(batches):
        for batch in batches:
            done = 0
            for texts in text_slices(batch.column(1)):
                nodes = batch.column(0).slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([nodes, pa.array([shingles(t, n).tobytes() for t in texts], pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary")


def filter_pairs(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link. ``nodes``: (node, n, sketch)."""
    def run(batches):
        for batch in batches:
            na, x, nb, y = (batch.column(c) for c in ("na", "x", "nb", "y"))
            keep = pa.array(pairs_may_link(na.to_numpy(), x.to_pylist(), nb.to_numpy(), y.to_pylist(), rule), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "x", "nb", "y").mapInArrow(run, "a long, b long")


def check_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, checked on their sets."""
    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [linked(np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64), num, den) for i in range(batch.num_rows)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sized(members: DataFrame, payloads: DataFrame, payload: str) -> DataFrame:
    """``members`` (sig, node, label) with ``size``: bytes of the node's payloads, joined once for each node."""
    each = members.groupBy("node").agg(F.collect_list(F.struct("sig", "label")).alias("__in"))  # a set has a bounded number of keys
    each = each.join(payloads.groupBy("node").agg(F.sum(F.octet_length(payload)).alias("size")), "node")
    return each.withColumn("__in", F.explode("__in")).select("__in.sig", "node", "__in.label", "size")


def _blocks(members: DataFrame, payloads: DataFrame, block: int) -> DataFrame:
    """``members`` (sig, node, label, size) dealt out with their ``payloads`` (by node): a group's nodes outside its
    commonest component are queries; queries and all nodes go into blocks by hash, and
    each (sig, i, j) meets one block of queries with one of nodes, about two blocks of ``BLOCK_BYTES`` of
    payload at most whatever the group's size. Blocks have ``block`` rows while there are up to ``SIDE`` on a side
    and grow from then on, so rows dealt out grow with the members, not with their square, until
    ``SIDE`` blocks don't hold the payloads. Payloads are joined once for
    each node, whatever the number of its groups, before its rows go to their blocks."""
    each = members.groupBy("sig", "label").agg(F.count("*").alias("c"), F.sum("size").alias("size"))
    sizes = each.groupBy("sig").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.sum("size").alias("size"),
                                    F.max(F.struct("c", "label", "size")).alias("left"))

    def parts(rows, size):
        return F.greatest(F.least(F.ceil(rows / block), F.lit(SIDE)), F.ceil(size / BLOCK_BYTES)).cast("int")

    counts = sizes.where("n > top.c").select(
        "sig", F.col("top.label").alias("main"), parts(F.col("n"), F.col("size")).alias("nb"),
        parts(F.col("n") - F.col("top.c"), F.col("size") - F.col("left.size")).alias("qb"))
    i, j = F.pmod(F.xxhash64("node", F.lit(1)), F.col("qb")).cast("int"), F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")

    def place(i, j, query):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(query).alias("query"))

    as_node = F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda x: place(x, F.col("__j"), False))
    as_query = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: place(F.col("__i"), x, True))
    dealt = members.join(counts, "sig").groupBy("node").agg(F.collect_list(F.struct("sig", "label", "main", "nb", "qb")).alias("__in"))
    dealt = dealt.join(payloads, "node").withColumn("__in", F.explode("__in")).select("*", "__in.*").drop("__in").withColumns({"__i": i, "__j": j})
    places = F.when(F.col("label") != F.col("main"), F.concat(as_node, as_query)).otherwise(as_node)
    dealt = dealt.withColumn("__at", F.explode(places)).drop("main", "nb", "qb", "__i", "__j")
    return dealt.select("*", "__at.i", "__at.j", "__at.query").drop("__at")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows with equal first ``keys`` columns, from rows sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in range(keys):
            column = table.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        start = 0
        for end in np.flatnonzero(change) + 1:
            yield table.slice(start, end - start)
            start = int(end)
        rest = table.slice(start)
    if rest is not None and rest.num_rows:
        yield rest


def _by_block(dealt: DataFrame, columns: list[str], fn: Callable, schema: str) -> DataFrame:
    """``fn(table)`` for the rows of each (sig, i, j), streamed from sorted partitions."""
    keys = ["sig", "i", "j"]
    target = arrow_schema(schema)

    def run(batches):
        for table in _runs(batches, len(keys)):
            found = fn(table)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=target)

    return dealt.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def promising(members: DataFrame, nodes: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """(sig, node) of the members that have a partner in another component whose sketch
    allows a link. ``members``: (sig, node, label, size), the size that of the node's sketch."""
    def run(table):
        sig, query = table.column("sig")[0].as_py(), table.column("query").to_numpy()
        node, label, size = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        raw = table.column("sketch").to_pylist()
        mine = np.flatnonzero(~query)
        stored = Sketches([raw[i] for i in mine], rule.head)
        label_of, size_of = label[mine], size[mine]
        found = set()
        for q in np.flatnonzero(query):
            hits = stored.hits(int(size[q]), raw[q], size_of, rule, np.flatnonzero(label_of != label[q]))
            if len(hits):
                found.add(int(node[q]))
                found.update(node[mine[hits]].tolist())
        return [(sig, x) for x in sorted(found)]

    dealt = _blocks(members, nodes, block)
    return _by_block(dealt, ["node", "label", "n", "sketch", "query"], run, "sig long, node long").distinct()


def check_groups(members: DataFrame, sets: DataFrame, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Links across components inside groups, each pair compared in the first group that
    both are members of. ``members``: (sig, node, label)."""
    rule = Rule(num, den)

    def run(table):
        sig, query = table.column("sig")[0].as_py(), table.column("query").to_numpy()
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        sets_here = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles").combine_chunks()]
        groups = [np.asarray(g) for g in table.column("sigs").to_pylist()]
        size = np.array([len(s) for s in sets_here], np.int64)
        mine = np.flatnonzero(~query)
        sketches = [sketch(s) for s in sets_here]
        stored = Sketches([sketches[i] for i in mine], 0)
        up, found = {}, []

        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for q in np.flatnonzero(query):
            for hit in stored.hits(int(size[q]), sketches[q], size[mine], rule, np.arange(len(mine))):
                x = mine[hit]
                if root(label[q]) != root(label[x]) and np.intersect1d(groups[q], groups[x], assume_unique=True)[0] == sig \
                        and linked(sets_here[q], sets_here[x], num, den):
                    up[root(label[q])] = root(label[x])
                    found.append((node[q], node[x]))
        return found

    every = members.groupBy("node").agg(F.sort_array(F.collect_set("sig")).alias("sigs"))  # a set has a bounded number of keys
    dealt = _blocks(_sized(members.select("sig", "node", "label"), sets, "shingles"), sets.join(every, "node"), block)
    return _by_block(dealt, ["node", "label", "query", "sigs", "shingles"], run, "a long, b long")


def candidate_groups(rows: DataFrame) -> DataFrame:
    """Of (sig, node) those of signatures with two nodes or more, one of the signatures that have the same rows.

    Rows move once, narrow, and aggregate and join read the same shuffle. Nothing is sorted: both
    are hashed, on signatures for the aggregate and on those that stay, few beside the rows, for
    the join, so rows of a hot signature only stream by and take no memory. Texts that share many
    signatures go on with one of them: later steps move rows that grow with the texts, not with
    their signatures. A node may come twice under a signature, so its rows are told by count, ends
    and sums (of 32 bits each, which a long holds), where equal nodes don't cancel out."""
    # both uses need the same rows, nulls told apart from the start, or their shuffles would differ
    dealt = rows.where("sig is not null and node is not null").repartition("sig")
    value = F.xxhash64("node")
    shape = dealt.groupBy("sig").agg(F.min("node").alias("rep"), F.max("node").alias("last"), F.count("*").alias("c"),
                                     F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF))).alias("x"), F.sum(F.shiftrightunsigned(value, 32)).alias("y"))
    told = shape.where("rep != last").select("sig", "rep", "last", F.xxhash64("c", "x", "y").alias("rows"))
    first = told.groupBy("rep", "last", "rows").agg(F.min("sig").alias("sig")).select("sig")
    return dealt.join(first.hint("shuffle_hash"), "sig")


def distinct_groups(groups: DataFrame) -> DataFrame:
    """One of the groups that have the same nodes, told by count and 128 bits over the nodes."""
    shape = groups.groupBy("sig").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    first = shape.groupBy("c", "x", "y").agg(F.min("sig").alias("sig")).select("sig")
    return groups.join(first, "sig", "left_semi")


def open_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (sig, node, label and what else ``labels`` says of a node) of the groups of three nodes or more
    with two components or more."""
    labelled = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_sigs = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"))
    return labelled.join(open_sigs.where("lo != hi and members > 2").select("sig"), "sig", "left_semi").select("sig", "node", *without(labels, ["node"]))


def united_groups(members: DataFrame) -> DataFrame:
    """``members`` (sig, node, label, ...) with groups of one family as one group.

    The nodes of a family of near copies meet again under most of their signatures. Groups of about the same
    size (same power of two) with the same commonest component are replaced by their union, which holds all
    their pairs, if it has no more pairs to compare than they have together; others stay as they are."""
    each = members.groupBy("sig", "label").agg(F.count("*").alias("c"))
    shape = each.groupBy("sig").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"))
    shape = shape.select("sig", F.col("top.label").alias("main"), F.floor(F.log2("n")).alias("scale"),
                         (F.col("n").cast("double") * (F.col("n") - F.col("top.c"))).alias("pairs"))
    alike = shape.groupBy("main", "scale").agg(F.min("sig").alias("first"), F.sum("pairs").alias("pairs"), F.count("*").alias("c")).where("c > 1")
    family = shape.select("sig", "main", "scale").join(alike, ["main", "scale"]).select("sig", "first", "main", "pairs")
    union = members.select("sig", "node", "label").join(family, "sig").select("first", "node", F.col("label") != F.col("main"), "pairs").toDF("first", "node", "query", "pairs")
    saves = union.distinct().groupBy("first", "pairs").agg(F.count("*").cast("double").alias("n"), F.count_if("query").alias("q")).where("n * q <= pairs")
    to = family.select("sig", "first").join(saves.select("first"), "first", "left_semi")
    return members.join(to, "sig", "left").withColumn("sig", F.coalesce("first", "sig")).drop("first").distinct()


def linked_components(docs: DataFrame, n: int, heads: Callable, key_rows_of: Callable, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, component_id): one row for each row of ``docs``.

    ``heads``: see ``SetsOfTexts``; ``key_rows_of``: from ``keys_from_texts`` or ``keys_from_heads``."""
    spark = docs.sparkSession
    ship_package(spark)
    with small_batches(spark):
        return _linked_components(docs, n, heads, key_rows_of, rule, id_col, text_col)


def _linked_components(docs: DataFrame, n: int, heads: Callable, key_rows_of: Callable, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    described = map_texts(docs, "n_shingles long, digest binary, sketch binary", SetsOfTexts(n, heads), text_col, keep=[id_col])
    keyed = stage(described.select(quoted(id_col).cast("long").alias("id"), "n_shingles", "digest", "sketch"), "join-keyed")
    has_id = docs.where(quoted(id_col).isNotNull()).select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    of_set = keyed.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("node"))
    nodes_of = stage(keyed.select("id", "n_shingles", "digest").join(of_set, "digest", "left").select("id", "n_shingles", "node"), "join-nodes")

    # stored by itself: a condition of a later join, pushed below one use of the shuffle, would make it two
    by_doc = stage(candidate_groups(key_rows_of(has_id, keyed)), "join-candidates")
    # keys hang on documents so far: one document for each set and task
    of_doc = nodes_of.where("id is not null and node is not null").select("id", "node").distinct()
    moved = stage(by_doc.select("sig", F.col("node").alias("id")).join(of_doc, "id").select("sig", "node").distinct(), "join-moved")
    least = moved.groupBy("sig").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("rep != last").drop("last")
    groups = stage(distinct_groups(moved.join(least, "sig")), "join-groups")

    wanted = groups.select("node").distinct()
    nodes = stage(keyed.where("id is not null and digest is not null").select(F.col("id").alias("node"), F.col("n_shingles").alias("n"), "sketch")
                  .join(wanted, "node", "left_semi").distinct(), "join-sketches")

    def sets_for(some: DataFrame, name: str) -> DataFrame:
        """The sets of some nodes, from the texts of the documents with that id."""
        texts = docs.select(quoted(id_col).cast("long").alias("node"), quoted(text_col).cast("string").alias("text")).join(some, "node", "left_semi")
        return stage(sets_of(texts, n).where(F.octet_length("shingles") > 0).distinct(), name)

    # 0: an id given to several sets links them
    several = nodes_of.where("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    same_id = nodes_of.join(several.select("id", "a"), "id").where("node is not null").select("a", F.col("node").alias("b"))
    # 1: each node with the smallest fitting node of its groups
    pairs = groups.where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stage(filter_pairs(pairs, nodes, rule), "join-pairs")
    sets = sets_for(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "join-sets")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stage(check_pairs(first, sets, rule.num, rule.den).union(same_id), "join-links")
    labels = stage(components(links), "join-labels")
    # 2: each node with every fitting one

    def label_of(name):
        return labels.select(F.col("node").alias(name), F.col("label").alias(f"label_{name}"))

    apart = pairs.join(first, ["a", "b"], "left_anti").join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    apart = apart.where("coalesce(label_a, a) != coalesce(label_b, b)").select("a", "b")
    links = stage(links.union(check_pairs(apart, sets, rule.num, rule.den)), "join-links")
    labels = stage(components(links), "join-labels")
    # 3: what is left, in blocks; groups of two nodes are settled by now
    # the sketches' bytes come along: they deal out the blocks
    sizes = nodes.groupBy("node").agg(F.sum(F.octet_length("sketch")).alias("size"))
    rest = stage(open_groups(groups.select("sig", "node"), sizes.join(labels, "node", "left")), "join-rest")
    rest = stage(united_groups(rest), "join-united")
    hopeful = stage(promising(rest, nodes, rule), "join-hopeful")
    if hopeful.take(1):
        sets = sets_for(hopeful.select("node").distinct(), "join-sets")
        members = stage(rest.join(hopeful, ["sig", "node"], "left_semi"), "join-members")
        links = stage(links.union(check_groups(members, sets, rule.num, rule.den)), "join-links")
        labels = stage(components(links), "join-labels")

    found = nodes_of.join(labels, "node", "left")
    known = F.col("id").isNotNull()
    # a component's label is its smallest node, the smallest id of its documents
    return found.select(F.col("id").alias(id_col), "n_shingles", F.when(known, F.coalesce("label", "node", "id")).alias("component_id"))
