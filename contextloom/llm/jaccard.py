"""Exact Jaccard self-join over word n-grams by prefixes of tokens and token combinations, up to components.

Two documents link when 100 * intersection >= percent * union of their sets of distinct shingles; a token is the 64-bit
hash of a shingle, and sets are ordered by it.

Prefixes. A document with n tokens can link only with documents that lack at most t = n - ceil(percent * n / 100) of them,
so of its first t + 1 tokens in any order that all documents share, one is in both. Frequent tokens make long lists, so
tokens fall in two classes. Rare tokens come first in the order and are indexed singly: the first t + 1 rare tokens. Only a
document with fewer rare tokens than that in its whole set (a copy within a large group, or little but a very common passage)
is short, and only two short documents can link without a rare token in common. For these, frequent tokens are indexed as
pairs: the hash range is cut into groups of about GROUP tokens a document, all pairs within a group are keys, and m tokens of
a group stand for m - 1 of the t + 1. Documents of nearly one size use one grouping.

Classes. The sketch of a document is its prefix in hash order that suffices even if all its tokens are frequent. A token
is frequent if more than `frequent` sketches have it; documents left short of rare tokens in their sketches add the rest of
their sets to the count until none is short for want of counting.

Links. Documents with equal sets are one node from the start. The documents of a list of a rare token, which is not long, are
compared with its first one, and pair by pair only where they are in different components after that. Lists of pairs may be
of any length; link_lists divides them. Every candidate of rare tokens is first bounded by the sketches (an upper bound of
the intersection, so nothing is lost), and every candidate is counted exactly over the whole sets.

Defined results: null or blank texts have an empty set and link with nothing; fewer words than a shingle needs make one
shingle; rows with one id share a component, whatever their texts, and each has the size of its own set; rows without an id
are left out (keep_first keeps them); a very long text is one set of any size, as others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextloom.llm.components import Labels
from contextloom.llm.hashing import BASES, Words, mix, slices, stretches
from contextloom.llm.shared import drop, free_name, materialize, small_batches, table

SHINGLE = 4
#: Columns of a node whose whole set is to be read.
NODE = ("doc", "rep", "n", "c1", "c2", "rows")
PERCENT = 85
FREQUENT = 32
GROUP = 5
#: Percent of similarity to a head from which documents are compared by the tokens in which they differ from it.
HELD = 30
#: Lists of up to so many documents are compared pair by pair, longer ones are divided.
PAIRED = 32
#: From the second level on, long lists of one head are compared in one task if they have up to so many documents and tokens.
TOGETHER = 2_000
TOGETHER_TOKENS = 1_000_000
#: Frequent tokens are sent to all executors up to so many (8 bytes each), and joined beyond.
SENT_TOKENS = 2_000_000
#: Documents whose whole sets are read are sent to all executors up to so many (40 bytes each), and joined beyond.
SENT_NODES = 1_000_000


def shingle_sets(batch_text: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct tokens) of each text; A-Z lower-cased."""
    for at, to, data, offsets in slices(batch_text):
        ws = Words(data, offsets, lower=True)
        hashes = ws.hashes()
        n = len(hashes)
        every = np.zeros(0, dtype=np.uint64)
        if n >= size:
            places = np.arange(n - size + 1)
            every = stretches(hashes, places, places + size, BASES[1])
        for i in range(to - at):
            lo, hi = int(ws.first[i]), int(ws.first[i + 1])
            if hi - lo >= size:
                found = np.unique(every[lo : hi - size + 1].view(np.int64))
            elif hi > lo:
                found = stretches(hashes, np.array([lo]), np.array([hi]), BASES[1]).view(np.int64)
            else:
                found = np.zeros(0, dtype=np.int64)
            yield at + i, found


def missing(n: int, percent: int) -> int:
    """How many of n tokens a linked document may lack."""
    return n - -(-percent * n // 100)


def levels(n: int, percent: int) -> list[int]:
    """Groupings (bits of hash) that documents linked with one of n tokens may use."""
    bits = lambda k: max(0, (k // GROUP).bit_length() - 1)
    return sorted({bits(-(-percent * n // 100)), bits(n), bits(100 * n // percent)})


def group_of(tokens: np.ndarray, bits: int) -> np.ndarray:
    return tokens >> np.int64(64 - bits) if bits else np.zeros(len(tokens), dtype=np.int64)


def sketch_size(tokens: np.ndarray, percent: int) -> int:
    """Length of the least prefix whose pairs within groups stand for missing + 1 tokens at every level."""
    need, size = missing(len(tokens), percent) + 1, 1
    for bits in levels(len(tokens), percent):
        group = group_of(tokens, bits)
        stands = np.cumsum(group[1:] == group[:-1])
        size = max(size, int(np.searchsorted(stands, need)) + 2)
    return min(size, len(tokens))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64), type=pa.int64()))


def _sketches(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c1, c2, sketch = [], [], [], []
            for _, tokens in shingle_sets(batch.column("text"), size):
                n.append(len(tokens))
                sums = set_sums(tokens)
                c1.append(sums[0])
                c2.append(sums[1])
                sketch.append(tokens[: sketch_size(tokens, percent)] if len(tokens) else tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int32()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), _lists(sketch)], names=["doc", "n", "c1", "c2", "sketch"]
            )

    return run


def set_sums(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums of mixed tokens, which tell sets apart."""
    u = tokens.view(np.uint64)
    return tuple(int(mix(u ^ np.uint64(base)).sum(dtype=np.uint64).view(np.int64)) for base in BASES)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c1, c2 = (batch.column(c).to_pylist() for c in ("n", "c1", "c2"))
            found = [(i, t) for i, t in shingle_sets(batch.column("text"), size) if (len(t), *set_sums(t)) == (n[i], c1[i], c2[i])]
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(at), batch.column("n").take(at), _lists([t for _, t in found])], names=["doc", "n", "tokens"])

    return run


def _known_sets(size: int, sent):
    """mapInArrow function: whole sets of the documents (doc, text) that are nodes of a broadcast (rep, n, c1, c2, doc), by rep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, n, c1, c2, node = sent.value
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            lo, hi = np.searchsorted(rep, doc, "left"), np.searchsorted(rep, doc, "right")
            rows = np.flatnonzero(hi > lo)
            if not len(rows):
                continue
            found = []
            for i, tokens in shingle_sets(batch.column("text").take(pa.array(rows)), size):
                sums = (len(tokens), *set_sums(tokens))
                found += [(node[k], n[k], tokens) for k in range(lo[rows[i]], hi[rows[i]]) if (n[k], c1[k], c2[k]) == sums]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), _lists([x[2] for x in found])], names=["doc", "n", "tokens"]
            )

    return run


def full_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(doc, n, tokens) of nodes (doc, rep, n, c1, c2, rows), each node once. Up to SENT_NODES nodes go to the texts, which then
    stay where they are; with more, texts are joined."""
    wanted = materialize(nodes, "wanted")
    n = wanted.count()
    if n > SENT_NODES:
        drop(wanted)
        own = docs.withColumnRenamed("doc", "rep").join(nodes, "rep").select("doc", "n", "c1", "c2", "text")
        return own.mapInArrow(_sets(size), "doc long, n int, tokens array<long>").dropDuplicates(["doc"])
    known = wanted.toPandas().sort_values("rep")
    drop(wanted)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy(dtype=np.int64) for c in ("rep", "n", "c1", "c2", "doc")))
    out = docs.mapInArrow(_known_sets(size, sent), "doc long, n int, tokens array<long>")
    return out.dropDuplicates(["doc"]) if n and known["rows"].max() > 1 else out


def _frequent_of(lists: pa.Array, known: np.ndarray) -> pa.Array:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    hit = np.zeros(len(tokens), dtype=bool)
    if len(known):
        hit = known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens
    upto = np.concatenate([[0], np.cumsum(hit)])[ends].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(tokens[hit], type=pa.int64()))


def mark(base: DataFrame, frequent: DataFrame, sent_tokens: int) -> DataFrame:
    """base (doc, tokens, ..) with `often`, those of its tokens that are in frequent (token)."""
    if frequent.count() <= sent_tokens:
        known = frequent.toPandas()["token"].to_numpy(dtype=np.int64)
        sent = base.sparkSession.sparkContext.broadcast(np.sort(known))

        @F.arrow_udf("array<long>")
        def often(tokens: pa.Array) -> pa.Array:
            return _frequent_of(tokens, sent.value)

        return base.withColumn("often", often("tokens"))
    some = base.select("doc", F.explode("tokens").alias("token")).join(frequent, "token").groupBy("doc").agg(F.sort_array(F.collect_list("token")).alias("often"))
    return base.join(some, "doc", "left").withColumn("often", F.coalesce("often", F.array().cast("array<long>")))


def _pairs_of(percent: int):
    """mapInArrow function: keys of the pairs of frequent tokens within a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n = batch.column("doc").to_pylist(), batch.column("n").to_pylist()
            keys, owner = [], []
            for i, x in enumerate(batch.column("often")):
                tokens = np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.int64)
                for bits in levels(n[i], percent):
                    group = group_of(tokens, bits)
                    for step in range(1, len(tokens)):  # pairs that stand step apart
                        near = np.flatnonzero(group[step:] == group[:-step])
                        if not len(near):
                            break
                        first, second = tokens[near].view(np.uint64), tokens[near + step].view(np.uint64)
                        keys.append(mix(mix(first) * np.uint64(3) + second + np.uint64(bits)).view(np.int64))
                        owner.append(np.full(len(near), i))
            if keys:
                owner = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.array(doc, dtype=np.int64)[owner])], names=["key", "doc"])

    return run


def _near_in_size(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b).cast("long")) >= percent * F.greatest(a, b).cast("long")


def index_keys(docs: DataFrame, reps: DataFrame, size: int, percent: int, frequent: int, sent_tokens: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Lists (key, doc, n, first) of rare tokens; for short documents, if there are any, lists (key, doc) of pairs of frequent
    tokens, and whole sets (doc, n, rare, tokens, often) with the number of rare tokens."""
    base = reps.select("doc", "n", F.col("sketch").alias("tokens"))
    need = F.col("n") - F.ceil(percent * F.col("n") / 100).cast("int") + 1
    count = lambda df: df.select(F.explode("tokens").alias("token")).groupBy("token").count().where(f"count > {frequent}").select("token")
    common = materialize(count(base), "frequent")
    is_short = F.size("tokens") - F.size("often") < need
    short = materialize(mark(base, common, sent_tokens).where(is_short).select("doc"), "short")
    whole = None
    while not short.isEmpty():
        more = full_sets(docs, reps.join(short, "doc", "left_semi").select(*NODE), size)
        old, whole = (whole, common), materialize(more if whole is None else whole.unionByName(more), "whole")
        common = materialize(common.unionByName(count(whole)).distinct(), "frequent")
        for done in (short, *old):
            if done is not None:
                drop(done)
        short = materialize(mark(base, common, sent_tokens).where(is_short).select("doc").join(whole.select("doc"), "doc", "left_anti"), "short")
    marked = materialize(mark(base, common, sent_tokens), "marked")
    rare = F.slice(F.array_except("tokens", "often"), 1, need).alias("first")
    single, sets, pairs = marked.select("doc", "n", rare), None, None
    if whole is not None:
        # those that were short take their rare tokens from their whole sets
        held = materialize(mark(whole, common, sent_tokens), "held")
        drop(whole)
        single = marked.join(held.select("doc"), "doc", "left_anti").select("doc", "n", rare).unionByName(held.select("doc", "n", rare))
        sets = materialize(held.where(is_short).select("doc", "n", (F.size("tokens") - F.size("often")).alias("rare"), "tokens", "often"), "short")
        pairs = marked.join(sets.select("doc"), "doc", "left_semi").where(F.size("often") > 1)
        pairs = materialize(pairs.select("doc", "n", "often").mapInArrow(_pairs_of(percent), "key long, doc long"), "pairs")
    # only lists with two documents at least are of use; lists of rare tokens are short
    own = Window.partitionBy("key")
    single = single.select(F.explode("first").alias("key"), "doc", "n").select("*", F.count("*").over(own).alias("docs"), F.min("doc").over(own).alias("first"))
    single = materialize(single.where("docs > 1").select("key", "doc", "n", "first"), "single")
    for done in (marked, common, short, *([held] if whole is not None else [])):
        drop(done)
    return single, pairs, sets


def linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link, as a table. Sketches rule out what they can before whole sets are read."""
    side = lambda c: reps.select(F.col("doc").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(_near_in_size(F.col("na"), F.col("nb"), percent))
    last = F.least(F.element_at("sa", -1), F.element_at("sb", -1))
    upto = lambda s: F.size(F.filter(s, lambda x: x <= last))
    most = F.size(F.array_intersect("sa", "sb")) + F.least(F.col("na") - upto("sa"), F.col("nb") - upto("sb"))
    both = both.where(100 * most.cast("long") >= percent * (F.col("na") + F.col("nb") - most).cast("long"))
    likely = materialize(both.select("a", "b"), "likely")
    ids = likely.select(F.col("a").alias("doc")).unionByName(likely.select(F.col("b").alias("doc"))).distinct()
    sets = materialize(full_sets(docs, reps.join(ids, "doc", "left_semi").select(*NODE), size), "sets")
    out = materialize(counted(likely, sets).where(_links(percent)).select("a", "b"), "linked")
    drop(sets)
    drop(likely)
    return out


def counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with whole sets ta, tb, sizes na, nb and both, the size of the intersection."""
    own = lambda c: sets.select(F.col("doc").alias(c), *(F.col(x).alias(x[0] + c) for x in sets.columns if x in ("n", "tokens", "often")))
    return pairs.join(own("a"), "a").join(own("b"), "b").withColumn("both", F.size(F.array_intersect("ta", "tb")).cast("long"))


def _links(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def _together(percent: int):
    """applyInArrow function: of the documents (doc, comp, tokens) of a group, links (a, b) that join all components that links join."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        doc, sets = group.column("doc").to_numpy(), group.column("tokens").combine_chunks()
        n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(n) - n
        tokens = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int32)
        label = np.unique(group.column("comp").to_numpy(), return_inverse=True)[1]
        held, found = np.zeros(int(tokens.max()) + 1, dtype=bool), []
        for i in range(len(doc) - 1):
            lo = starts[i + 1]
            held[tokens[starts[i] : lo]] = True
            both = np.add.reduceat(held[tokens[lo:]], starts[i + 1 :] - lo, dtype=np.int64)
            held[tokens[starts[i] : lo]] = False
            for j in i + 1 + np.flatnonzero(100 * both >= percent * (n[i] + n[i + 1 :] - both)):
                if label[i] != label[j]:
                    found.append((doc[i], doc[j]))
                    label[label == label[j]] = label[i]
        return pa.table({c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate("ab")})

    return run


def split_by_size(now: DataFrame, percent: int) -> DataFrame:
    """Lists (key, doc, n, rare, comp) as lists for two sizes (s, l) each, of the documents of these sizes that can link so.

    What two short documents share beyond rare tokens is at most the frequent tokens of either, so the sizes of what a document
    can link with are bounded from both sides; a copy with many edits of its own can link with smaller ones only.
    """
    sizes = now.groupBy("key").agg(F.collect_set("n").alias("sizes"))
    each = now.join(sizes, "key").withColumn("size", F.explode(F.filter("sizes", lambda x: _in_reach(x, F.col("n"), F.col("rare"), percent)))).drop("sizes")
    each = each.withColumn("s", F.least("n", "size")).withColumn("l", F.greatest("n", "size")).drop("size")
    return each.withColumn("key", F.xxhash64("key", "s", "l"))


def _in_reach(other: Column, n: Column, rare: Column, percent: int) -> Column:
    """Whether n - rare shared tokens suffice for a link of documents with n and other tokens."""
    return _near_in_size(n, other, percent) & ((n - rare) * (100 + percent) >= percent * (n + other))


def link_lists(lists: DataFrame, sets: DataFrame, labels: Labels, percent: int) -> None:
    """Add to labels what joins all short documents that link and are in one of the lists (key, doc).

    What is in one component already is not compared again, so a list counts only while it has two components. Up to PAIRED
    documents are compared pair by pair. A longer list has a head h, its document with the fewest rare tokens (of a group of
    near copies, the original or what is nearest to it), with which all others are compared. Let y not be linked with h, and x
    be linked with y without a rare token in common. Then x and y share a frequent token that h has not, or all they share is
    in h; as the latter is less than y and h need, x is smaller than h and lies almost wholly in it, and its size is bounded
    from both sides by what y shares with h, so such x and y are joined by size. Others at least HELD percent similar to h go
    on in lists of the frequent tokens that h has not. By the triangle inequality of the Jaccard distance, a document at
    distance d from h links only with such whose distance is d give or take step = 1 - percent / 100; so those below HELD
    percent go on without it, with a rim of those above it: once in their old list, and after that in lists of one more token
    of a prefix of their frequent tokens. From the second level on, lists are for two sizes each. New lists have only
    documents that come after h in the order of heads, so this ends.

    Where the original is missing, every head lacks tokens that the others share, and a level may take little but the head
    out of a list. So from the second level on, the documents of all lists of a head are compared in one task if they are up
    to TOGETHER and have up to TOGETHER_TOKENS tokens; only more of them are divided further.
    """
    step, level = 100 - percent, 0
    small = sets.select("doc", "n", "rare")
    plain = sets.select("doc", "n", "tokens")
    lists = materialize(lists.join(small, "doc").select("key", "doc", "n", "rare", F.lit(0).alias("s"), F.lit(0).alias("l")), "lists")
    while True:
        level += 1
        now = labels.of(lists, "doc", "comp")
        if level == 2:
            now = split_by_size(now.drop("s", "l"), percent)
        both = lambda size: F.sum((F.col("n") == F.col(size)).cast("long"))
        kept = now.groupBy("key").agg(F.count("*").alias("docs"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("rare", "doc"))["doc"].alias("head"), F.when(F.first("s") > 0, both("s") * both("l")).alias("meet"))
        kept = kept.where("lo < hi and docs > 1 and (meet is null or meet > 0)").withColumn("brief", F.coalesce("meet", F.col("docs") * F.col("docs")) <= PAIRED * PAIRED)
        mixed = materialize(now.join(kept.select("key", "brief", "head"), "key"), "mixed")
        drop(lists)
        ask = mixed.agg(F.max("brief").alias("brief"), F.min("brief").alias("only")).first()
        if ask["brief"] is None:
            drop(mixed)
            return
        brief = mixed.where("brief")
        other = brief.select("key", *(F.col(c).alias(f"{c}2") for c in ("doc", "n", "rare", "comp")))
        pair = brief.join(other, "key").where("doc < doc2 and comp <> comp2 and (s = 0 or (least(n, n2) = s and greatest(n, n2) = l))")
        pair = pair.where(_in_reach(F.col("n2"), F.col("n"), F.col("rare"), percent) & _in_reach(F.col("n"), F.col("n2"), F.col("rare2"), percent))
        pair = pair.select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct()
        if ask["brief"]:
            labels.take(materialize(counted(pair, plain).where(_links(percent)).select("a", "b"), "linked"))
        if ask["only"]:
            drop(mixed)
            return
        long = mixed.where("not brief")
        if level > 1:
            crowd = materialize(long.select("head", "doc", "n", "comp").distinct(), "crowd")
            sizes = crowd.groupBy("head").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
            fits = materialize(sizes.select("head", ((F.col("docs") <= TOGETHER) & (F.col("tokens") <= TOGETHER_TOKENS)).alias("fits")), "fits")
            some = fits.agg(F.max("fits").alias("any"), F.min("fits").alias("all")).first()
            if some["any"]:
                whole = crowd.join(fits.where("fits"), "head").join(sets.select("doc", "tokens"), "doc").select("head", "doc", "comp", "tokens")
                labels.take(materialize(whole.groupBy("head").applyInArrow(_together(percent), "a long, b long"), "linked"))
                rest = materialize(long.join(fits.where("fits"), "head", "left_anti"), "mixed")
                drop(mixed)
                mixed = long = rest
            drop(crowd)
            drop(fits)
            if some["all"]:
                drop(mixed)
                return
        stars = long.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
        at = lambda least: 100 * F.col("both") >= least * (F.col("na") + F.col("nb") - F.col("both"))
        kind = F.when(at(percent), "linked").when(at(HELD + step), "near").when(at(HELD), "inner").otherwise("rim")
        held = counted(stars, sets).where(at(HELD - step)).withColumn("kind", kind)
        held = materialize(held.select("a", "b", F.col("na").alias("m"), F.col("nb").alias("n"), "both", "kind", F.when(F.col("kind") != "rim", F.array_except("ob", "ta")).alias("own")), "held")
        labels.add(held.where("kind = 'linked'").select("a", "b"))
        near = held.where("kind <> 'rim'")
        least, most = F.ceil(percent * F.col("n") / 100).cast("int"), F.floor(F.col("both") * (100 + percent) / percent).cast("int") - F.col("n")
        most = F.least(most, F.col("m") - 1)
        reach = labels.of(near.where("kind <> 'linked'").where(most >= least).select("a", F.col("b").alias("y"), F.explode(F.sequence(least, most)).alias("n")), "y", "other")
        inside = labels.of(near.where((F.col("n") < F.col("m")) & (100 * F.col("both") >= percent * F.col("n"))).select("a", F.col("b").alias("x"), "n"), "x", "comp")
        pair = inside.join(reach, ["a", "n"]).where("x <> y and comp <> other").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        labels.take(materialize(counted(pair, plain).where(_links(percent)).select("a", "b"), "linked"))
        sizes = long.where("doc <> head").select("head", "doc", "n", "rare", "s", "l").distinct()
        sub = near.select(F.col("a").alias("head"), F.col("b").alias("doc"), F.explode("own").alias("token")).join(sizes, ["head", "doc"])
        sub = sub.withColumn("key", F.xxhash64(F.lit(level), "head", "s", "l", "token"))
        kinds = held.select(F.col("a").alias("head"), F.col("b").alias("doc"), "kind")
        left = long.where("doc <> head").join(kinds.where("kind in ('linked', 'near')"), ["head", "doc"], "left_anti")
        left = left.join(kinds.where("kind not in ('linked', 'near')"), ["head", "doc"], "left")
        rims = left.groupBy("key").agg(F.max(F.coalesce(F.col("kind") == "rim", F.lit(False))).alias("rim"))
        left = left.join(rims, "key").where("kind is null or kind <> 'inner' or rim")
        if level > 1:
            need = F.size("often") - F.ceil(percent * F.col("n") / 100).cast("int") + 1
            ordered = F.transform("often", lambda x: F.struct(F.xxhash64(x, F.lit(level)).alias("place"), x.alias("token")))
            first = left.select("doc").distinct().join(sets, "doc").select("doc", F.explode(F.slice(F.sort_array(ordered), 1, need)).alias("one"))
            left = left.join(first, "doc").withColumn("key", F.xxhash64("key", "one.token"))
        columns = ["key", "doc", "n", "rare", "s", "l"]
        lists = materialize(sub.select(*columns).unionByName(left.select(*columns)).distinct(), "lists")
        drop(mixed)
        drop(held)


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, frequent: int = FREQUENT, sent_tokens: int = SENT_TOKENS) -> DataFrame:
    """(doc, n_shingles, component) for every row of docs with an id."""
    if not 75 <= percent <= 100:
        raise ValueError("percent must be from 75 to 100")
    with small_batches(docs.sparkSession):
        return _link(docs, doc_id, text, size, percent, frequent, sent_tokens)


def _link(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, frequent: int, sent_tokens: int) -> DataFrame:
    slim = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    made = materialize(slim.mapInArrow(_sketches(size, percent), "doc long, n int, c1 long, c2 long, sketch array<long>"), "sketches")
    same = ["n", "c1", "c2"]
    # a node for each set: its least id, or a hash where an id has several sets
    nodes = made.where("n > 0").groupBy(*same).agg(F.min("doc").alias("rep"))
    nodes = nodes.withColumn("k", F.row_number().over(Window.partitionBy("rep").orderBy(*same)))
    nodes = materialize(nodes.select(*same, "rep", F.when(F.col("k") == 1, F.col("rep")).otherwise(F.xxhash64(*same)).alias("node")), "nodes")
    reps = made.withColumnRenamed("doc", "rep").join(nodes, ["rep", *same]).groupBy("rep", *same, "node")
    reps = reps.agg(F.first("sketch").alias("sketch"), F.count("*").alias("rows"))
    reps = materialize(reps.select(F.col("node").alias("doc"), "rep", *same, "sketch", "rows"), "reps")
    own = materialize(made.select("doc", *same), "own")
    drop(made)
    single, pairs, sets = index_keys(slim, reps, size, percent, frequent, sent_tokens)
    labels = Labels()
    several = own.where("n > 0").groupBy("doc").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).where("lo < hi").select("doc")
    several = own.where("n > 0").join(several, "doc", "left_semi").distinct().join(nodes.select(*same, "node"), same).select("doc", "node")
    several = several.join(several.groupBy("doc").agg(F.min("node").alias("a")), "doc").select("a", F.col("node").alias("b"))
    labels.take(materialize(several.where("a <> b"), "several"))
    stars = single.where("doc > first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    labels.take(linked(stars, slim, reps, size, percent))
    if pairs is not None:
        link_lists(pairs, sets, labels, percent)
        drop(pairs)
        drop(sets)
    # in a short list what is still in different components is compared directly
    left = labels.of(single.select("key", "doc", "n"), "doc", "comp")
    mixed = left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = left.join(mixed, "key")
    other = left.select("key", F.col("doc").alias("doc2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    rest = left.join(other, "key").where((F.col("doc") < F.col("doc2")) & (F.col("comp") != F.col("comp2")) & _near_in_size(F.col("n"), F.col("n2"), percent))
    rest = rest.select(F.col("doc").alias("a"), F.col("doc2").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    labels.take(linked(rest, slim, reps, size, percent))
    drop(single)
    drop(reps)
    # a component is named by its least id, which need not be that of its least node
    whole = labels.of(nodes, "node", "comp")
    least = whole.groupBy("comp").agg(F.min("rep").alias("component"))
    named = materialize(whole.join(least, "comp").select(*same, "component"), "named")
    drop(nodes)
    return own.join(named, same, "left").select("doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows whose component has a smaller id; rows with one id stay or go together."""
    key = free_name(docs.columns, "_doc")
    found = link_documents(docs, doc_id, text, **how).where("doc <> component").select(F.col("doc").alias(key)).distinct()
    return docs.join(found, docs[doc_id].cast("long") == F.col(key), "left_anti")


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_documents(docs).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
