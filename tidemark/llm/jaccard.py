"""Jaccard self-join of shingle sets by a grouped prefix join, and the components of its links.

Two sets of similarity 0.8 or more share a member among the first |set| - ceil(0.8 |set|) + 1 of each, whatever the
order of members, as long as it is the same for all. Rare members come first here, so that passages which many
documents share hardly ever get into a prefix.

1. Refuted at once: a document can only link if at most a fifth of its members are its own. Members whose hash lies in
   the lowest PART of the range are sorted, and their owners counted; documents with more than a fifth of all members
   found to be their own there are done. This is exact, and settles most documents at a part of the cost.
2. The members of the others are counted over all of them. The order is (documents with the member, hash); members of
   one document only come first, and in no posting list.
3. Documents of equal size and equal prefix are one group. Group pairs that share a prefix member are filtered by size,
   by place in the prefix, and by whether they can still join components; what is left is expanded to members, and
   verified on the whole sets.
4. Each member is verified against its group's first and each group against the next in its posting lists at first. Their
   components take most pairs off the table: pairs within a component are never formed. Lists of up to SMALL groups then
   yield pairs; the groups of larger ones are compared family by family in blocks of neighbouring sizes, which yields
   links only.
5. Connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.textblocks import blocks, lean, shingles, words
from tidemark.session import pin, unpin

SHINGLE = 5  # words
PER_CENT = 80
PART = 0.3  # of the range of hashes
SMALL = 32  # groups in a posting list whose pairs are formed
BLOCK, BLOCK_MEMBERS = 512, 1 << 20  # sets, and set members, in a block of a family
FEW = 1 << 20  # row ids of eight bytes that are broadcast
CLASS = 1.12  # ratio of sizes in a class of a family: a set and its partner are two classes apart at most

_PLAIN = np.ones(256, bool)
_PLAIN[[0x20, *range(0x09, 0x0E)]] = False
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 32
NO_ID = -(1 << 63)
_LOW = np.int64(-(1 << 63) + int(PART * (1 << 64)))


def _needed(n):
    """Members that a set of n members shares with every partner, at least."""
    return (PER_CENT * n + 99) // 100


def sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes in order, where each row's begin and end) of blocks of texts."""
    for lo, hi, data, ends in blocks(column):
        hashes, at = words(data, ends, _PLAIN, lambda d: _FOLDED[d])
        member, doc = shingles(hashes, at, SHINGLE)
        member = member.view(np.int64)
        order = np.lexsort((member, doc))
        member, doc = member[order], doc[order]
        new = np.ones(len(member), bool)
        new[1:] = (member[1:] != member[:-1]) | (doc[1:] != doc[:-1])
        member, doc = member[new], doc[new]
        yield lo, hi, member, np.searchsorted(doc, np.arange(hi - lo + 1))


@lean
def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, member, at in sets(batch.column("text")):
            low = np.concatenate(([0], np.cumsum(member < _LOW)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "nid")], pa.array(np.diff(at)), pa.array(np.diff(low[at]))],
                                             ["doc_id", "nid", "n", "low"])


@lean
def _low_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, member, at in sets(batch.column("text")):
            nid = np.repeat(batch.column("nid").slice(lo, hi - lo).to_numpy(), np.diff(at))
            low = member < _LOW
            yield pa.RecordBatch.from_arrays([pa.array(member[low]), pa.array(nid[low])], ["t", "nid"])


@lean
def _member_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, member, at in sets(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("nid").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(member))],
                                             ["nid", "members"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (t, nid) in order, how many different members of each document have another owner: (nid, shared).

    The first and the last row of a task count as shared, because a neighbouring task may hold the member's other
    owners; that can only keep a document in. The last row of a batch waits for the next.
    """
    t, nid, known = np.zeros(0, np.int64), np.zeros(0, np.int64), True

    def told(owners: np.ndarray) -> pa.RecordBatch:
        names, counts = np.unique(owners, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts.astype(np.int64))], ["nid", "shared"])

    for batch in batches:
        t, nid = np.concatenate((t, batch.column("t").to_numpy())), np.concatenate((nid, batch.column("nid").to_numpy()))
        if len(t):
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (nid[1:] != nid[:-1])
            t, nid = t[new], nid[new]
            shared = np.zeros(len(t), bool)
            shared[0] = known
            shared[1:] |= t[1:] == t[:-1]
            shared[:-1] |= t[1:] == t[:-1]
            yield told(nid[:-1][shared[:-1]])
            t, nid, known = t[-1:], nid[-1:], bool(shared[-1])
    yield told(nid)


def undecided(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """(nid, doc_id, n) of the texts that may have a partner, one row for all copies of a text."""
    low = rows.mapInArrow(_low_members, "t bigint, nid bigint")
    shared = low.repartitionByRange("t", "nid").sortWithinPartitions("t", "nid").mapInArrow(_shared, "nid bigint, shared bigint")
    texts = sized.where("n > 0").groupBy("nid").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("low").alias("low"))
    own = F.col("low") - F.coalesce("shared", F.lit(0))
    return texts.join(shared.groupBy("nid").agg(F.sum("shared").alias("shared")), "nid", "left").where(own <= F.col("n") - _needed_of("n")).select("nid", "doc_id", "n")


def _needed_of(n: str):
    return F.expr(f"({PER_CENT} * {n} + 99) div 100")


def grouped(members: DataFrame) -> DataFrame:
    """(nid, n, own, prefix, gid) of the documents that share a prefix member: ``own`` members of theirs alone come
    before ``prefix``, the shared part of the prefix. Equal size and prefix make a group ``gid``."""
    each = members.select("nid", F.explode("members").alias("t"))
    owners = each.groupBy("t").agg(F.count("*").alias("owners")).where("owners > 1")
    order = F.sort_array(F.collect_list(F.struct("owners", "t")))  # no more than a document's members
    shared = each.join(owners, "t").groupBy("nid").agg(order.alias("order"))
    sized = shared.join(members.select("nid", F.size("members").cast("long").alias("n")), "nid").where(F.size("order") >= _needed_of("n"))
    first = F.slice("order", F.lit(1), (F.size("order") - _needed_of("n") + 1).cast("int"))
    out = sized.select("nid", "n", (F.col("n") - F.size("order")).alias("own"), F.transform(first, lambda x: x["t"]).alias("prefix"))
    return out.withColumn("gid", F.unhex(F.md5(F.concat_ws(",", F.col("n").cast("string"), F.col("prefix").cast("array<string>")))))


def _following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (t, n, rep) in order, each and the next of the same member."""
    t, n, rep = (np.zeros(0, np.int64) for _ in range(3))
    for batch in batches:
        t, n, rep = (np.concatenate((a, batch.column(c).to_numpy())) for a, c in ((t, "t"), (n, "n"), (rep, "rep")))
        i = np.flatnonzero((t[1:] == t[:-1]) & (n[:-1] >= _needed(n[1:])))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[i + 1])), pa.array(np.maximum(rep[i], rep[i + 1]))], ["a", "b"])
        t, n, rep = t[-1:], n[-1:], rep[-1:]


def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets."""
    left, right = members.toDF("a", "of_a"), members.toDF("b", "of_b")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(
        100 * both >= PER_CENT * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _in_order(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def small_pairs(lists: DataFrame, placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents in different components from posting lists (t, gid, n, at, low, high) of up to SMALL
    documents, filtered by group and then expanded to the documents ``placed``, and from the groups of ``mixed`` ones."""
    least = F.expr(f"({PER_CENT} * (x.n + y.n) + {99 + PER_CENT}) div {100 + PER_CENT}")
    fits = (F.col("x.t") == F.col("y.t")) & (F.struct("x.n", "x.gid") < F.struct("y.n", "y.gid")) & (F.col("x.n") >= _needed_of("y.n"))
    reach = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= least
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    groups = lists.alias("x").join(lists.alias("y"), fits & reach & apart).select(F.col("x.gid").alias("g"), F.col("y.gid").alias("h")).distinct()
    left, right = placed.select(F.col("gid").alias("g"), F.col("nid").alias("u"), F.col("comp").alias("c")), placed.select(F.col("gid").alias("h"), F.col("nid").alias("v"), F.col("comp").alias("d"))
    across = groups.join(left, "g").join(right, "h")
    own = lambda *names: mixed.select("gid", "nid", "comp").toDF(*names)
    within = own("g", "u", "c").join(own("g", "v", "d"), "g").where("u < v")
    return across.where("c != d").select(*_in_order("u", "v")).union(within.where("c != d").select(*_in_order("u", "v"))).distinct()


def _linked(table: pa.Table) -> pa.Table:
    """Links between components from two blocks of a family, or within one: as many as join what can be joined."""
    nid, sets_of = table.column("nid").to_numpy(), table.column("members").combine_chunks()
    member, starts = sets_of.flatten().to_numpy(), sets_of.offsets.to_numpy().astype(np.int64)
    starts, size = starts - starts[0], np.diff(starts)
    label, side = table.column("comp").to_numpy().copy(), table.column("side").to_numpy()
    alone = not side.any()
    member = np.unique(member, return_inverse=True)[1].astype(np.int32)
    marked, found = np.zeros(int(member.max(initial=0)) + 1, bool), []
    for p in range(len(nid)):
        rest = np.arange(p + 1, len(nid))
        fits = (label[rest] != label[p]) & (100 * size[rest] >= PER_CENT * size[p]) & (100 * size[p] >= PER_CENT * size[rest])
        rest = rest[fits if alone else fits & (side[rest] != side[p])]
        if not len(rest):
            continue
        marked[member[starts[p] : starts[p + 1]]] = True
        ends = np.cumsum(size[rest])
        taken = np.repeat(starts[rest] - ends + size[rest], size[rest]) + np.arange(ends[-1])
        both = np.add.reduceat(marked[member[taken]], ends - size[rest], dtype=np.int64)
        marked[member[starts[p] : starts[p + 1]]] = False
        for q in rest[100 * both >= PER_CENT * (size[p] + size[rest] - both)].tolist():
            if label[q] != label[p]:
                found.append((min(nid[p], nid[q]), max(nid[p], nid[q])))
                label[label == label[q]] = label[p]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def family_links(of: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between components from all pairs within the families of rows (fam, nid, n, comp).

    A family is cut into blocks by class of size and by hash of the row; blocks of classes up to two apart meet in a
    task each.
    """
    size_class = F.floor(F.log("n") / F.log(F.lit(CLASS))).cast("int")
    rows = of.withColumn("c", size_class)
    blocks_of = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_MEMBERS)).cast("int")
    count = rows.groupBy("fam", "c").agg(blocks_of.alias("blocks"))
    mixed = rows.groupBy("fam").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("fam")
    cut = rows.join(mixed, "fam").join(count, ["fam", "c"]).select(
        "fam", "c", F.pmod(F.xxhash64("nid"), "blocks").cast("int").alias("i"), "nid", "comp", F.explode(F.sequence(F.col("c") - 2, F.col("c") + 2)).alias("d"))
    met = cut.join(count.toDF("fam", "d", "partners"), ["fam", "d"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("partners") - 1)))
    mine, theirs = F.struct("c", "i"), F.struct(F.col("d").alias("c"), F.col("j").alias("i"))
    met = met.select("fam", F.least(mine, theirs).alias("x"), F.greatest(mine, theirs).alias("y"), (mine > theirs).alias("side"), "nid", "comp")
    return met.join(members, "nid").groupBy("fam", "x", "y").applyInArrow(_linked, "a bigint, b bigint").distinct()


def links(members: DataFrame) -> DataFrame:
    """Links (a, b), a < b, of sets (nid, members): enough to tell the components of all links."""
    placed = pin(grouped(members), "placed")
    groups = placed.groupBy("gid").agg(F.min("nid").alias("rep"), F.min("n").alias("n"), F.min("own").alias("own"),
                                       F.count("*").alias("size"), F.first("prefix").alias("prefix"))
    postings = pin(groups.select("gid", "rep", "n", "own", "size", F.posexplode("prefix").alias("at", "t")).withColumn("at", F.col("own") + F.col("at")), "postings")
    hubs = placed.join(postings.select("gid", "rep").distinct(), "gid").where("nid != rep").select(*_in_order("nid", "rep"))
    lined = postings.select("t", "n", "rep").repartitionByRange("t", "n", "rep").sortWithinPartitions("t", "n", "rep")
    first = hubs.union(lined.mapInArrow(_following, "a bigint, b bigint")).where("a < b").distinct()
    known = pin(verified(first, members), "links")
    roots = components(known, shorten=True)
    # what can still join components
    marked = pin(placed.select("nid", "n", "gid").join(roots.toDF("nid", "root"), "nid", "left").select("nid", "n", "gid", F.coalesce("root", "nid").alias("comp")), "marked")
    spread = marked.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    lists = postings.join(spread, "gid")
    about = lists.groupBy("t").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.sum("size").alias("docs"), F.min("rep").alias("hub")).where("l != h")
    lists = lists.join(about, "t")
    few = lists.where(F.col("docs") <= SMALL).select("t", "gid", "n", "at", "low", "high")
    wide = lists.where(F.col("docs") > SMALL).select("gid", "rep", "hub").distinct()
    inner = spread.where("low != high").join(postings.select("gid", "rep", "size").distinct(), "gid")
    wide = pin(wide.union(inner.where(F.col("size") > SMALL).select("gid", "rep", F.col("rep").alias("hub"))), "wide")
    within_few = marked.join(inner.where(F.col("size") <= SMALL).select("gid"), "gid", "left_semi")
    more = verified(small_pairs(few, marked, within_few), members)
    if not wide.isEmpty():
        family = components(wide.select("rep", "hub"), "rep", "hub", shorten=True).toDF("rep", "root")
        of = wide.select("gid", "rep").distinct().join(family, "rep", "left").select("gid", F.coalesce("root", "rep").alias("fam")).distinct()
        more = more.union(family_links(marked.join(of, "gid").select("fam", "nid", "n", "comp"), members))
    more = pin(more, "more")
    unpin(placed, postings, wide)
    return known.union(more)


def linked(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Words are runs of characters other than ASCII white space, A-Z lowered; a set holds the distinct runs of five words,
    of a shorter text the whole sequence. Texts without a word link with nothing, not even their copies. Null ids stay
    null and name no component unless all of its ids are null. Repeated rows stay, linked to each other. Other columns
    are not read; an empty table gives no row. Texts and shingles are told apart by 64-bit hashes.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("nid"), text.alias("text"))
    sized = pin(rows.mapInArrow(_sized, "doc_id bigint, nid bigint, n bigint, low bigint"), "sized")
    left = pin(undecided(rows.select("nid", "text"), sized), "undecided")
    wanted = left.select("nid", "doc_id")
    wanted = F.broadcast(wanted) if left.count() <= FEW else wanted
    members = rows.join(wanted, ["nid", "doc_id"], "left_semi").mapInArrow(_member_lists, "nid bigint, members array<bigint>")
    members = pin(members.dropDuplicates(["nid"]), "members")
    found = links(members)
    roots = components(found, shorten=True)
    texts = sized.where("n > 0").groupBy("nid").agg(F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("least"))
    texts = texts.join(roots.toDF("nid", "root"), "nid", "left").select("nid", "least", F.coalesce("root", "nid").alias("root"))
    named = texts.groupBy("root").agg(F.min("least").alias("component_id"))
    named = texts.join(named, "root").select("nid", "component_id")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return sized.join(named, "nid", "left").select(
        real.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(real).alias("component_id"))
