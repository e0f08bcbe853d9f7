"""Near-duplicate documents by a signature-coordinate inverted join.

Equal shingle sets are one class from the start. Each class has a MinHash signature of 64 coordinates and is posted
under each (coordinate, value) pair. A pair of classes that is similar enough agrees in 28 coordinates or more (at
the threshold 48 are expected; fewer than 28 have a probability below 1e-7). Prefix merging: postings are ordered by one
order for all classes, rare ones first; of two classes that agree in 28 of 64 coordinates, the first 37 postings of
each share one, so the 27 most common postings are skipped. Agreements are then counted on the signatures, pairs
below 28 are dropped, and what is left is confirmed on the full shingle sets.

Lists are merged without giving their pairs. Each list has a leader, its most central class (whose postings are the most
common ones), and lists with the same leader are one group, so two classes that share a list share a group. First each class
is compared with its leaders: in a group of near copies this links most of them, in linear work. Only classes that are
not in their leader's component are then compared with the rest of the group, in blocks of bounded classes and bytes: first
signatures against signatures, which tells the classes that have a partner at all, then full sets, by counting shared
shingles over an index of the block. A block returns at most one link for each pair of components that it joins, never its
pairs. Joins on tokens and leaders deal hot ones over many tasks. A large group of texts that are half alike but no near
copies is compared in full, block by block: its work grows with the square of the group, its memory doesn't.

Rows are told apart by a number written with them, so that a doc_id may be shared or null. Sets are compared by 64-bit
shingle hashes (see ``textarrays``) within a pair or block.

Nulls and edges: a text without words, or null, has an empty set and is linked with nothing; texts of fewer words than
a shingle are one shingle; rows that share a doc_id are one document and share its component; a row without doc_id is
linked like others but has a null component_id and counts as kept, since no doc_id says otherwise: ``first`` tells which
one row of a component stays, that of the least doc_id, then of the least row number, rows without doc_id last; long
texts count whole; an empty table gives no rows; further columns are ignored unless named in ``carry``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketgrain.llm.components import connected_components
from marketgrain.llm.shared import settled, spread_join, written
from marketgrain.llm.textarrays import SPACES, U, bounded, grams, mix, sequence_hash, text_buffers, word_hashes

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
COORDINATES = 64
AGREEMENTS = 28
PREFIX = COORDINATES - AGREEMENTS + 1
#: Postings more common than one in so many are ordered by how common they are; there are no more of them than this.
COMMON_POSTINGS = 50_000
#: Outsiders, and members, of a block, and bytes of their texts.
BLOCK = 256
BLOCK_BYTES = 32 << 20
#: Up to so many identifiers are broadcast to select the texts to compare; beyond it they are joined.
BROADCAST_IDS = 500_000


def shingle_sets(column: pa.Array, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    hashes, offsets = word_hashes(*text_buffers(column), SPACES, lower=True)
    values, _ = grams(hashes, offsets, k)
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= k:
            own = np.sort(values[a : b - k + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            sets.append(np.array([sequence_hash(hashes[a:b])], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def minhash(own: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least of 64 multiply-shift hashes over a set, 32 bits each."""
    factor, shift = seeds
    least = np.full(COORDINATES, 2**32 - 1, np.uint32)
    for i in range(0, len(own), 1024):
        part = own[i : i + 1024]
        np.minimum(least, ((part[:, None] * factor + shift) >> U(32)).min(axis=0).astype(np.uint32), out=least)
    return least


def signatures(rows: DataFrame) -> DataFrame:
    """Add to rows of doc_id, row, text and more: n_shingles, n_bytes, set_key (digest of the set; null if empty), signature
    (64 little-endian unsigned 32-bit values)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds()
        for batch in bounded(batches, lambda b: b.column("text")):
            sets = shingle_sets(batch.column("text"))
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            known: dict[bytes, bytes] = {}
            signed = []
            for s, key in zip(sets, keys):
                if key is not None and key not in known:
                    known[key] = minhash(s, seeds).tobytes()
                signed.append(None if key is None else known[key])
            sizes = np.diff(text_buffers(batch.column("text"))[1])
            added = [pa.array([len(s) for s in sets], pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "n_shingles", "n_bytes", "set_key", "signature"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(sign, f"{own}, n_shingles long, n_bytes long, set_key binary, signature binary")


def _tokens(signed: np.ndarray) -> np.ndarray:
    """One 64-bit number for each (coordinate, value) of signatures in rows."""
    return mix(signed.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << U(32)))


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's tokens, with counts: combined before the shuffle."""
    for batch in batches:
        tokens, counts = np.unique(_tokens(_signature_rows(batch.column(0))).ravel(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts, pa.int64())], ["token", "n"])


def postings(classes: DataFrame) -> DataFrame:
    """Each class under the PREFIX rarest of its postings: token, rep."""
    spark = classes.sparkSession
    n_classes = classes.count()
    least = max(64, n_classes * COORDINATES // COMMON_POSTINGS)
    common = classes.select("signature").mapInArrow(_all_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    found = sorted((r["token"], r["n"]) for r in common.collect())  # COMMON_POSTINGS at most, by their least count
    sent = spark.sparkContext.broadcast((np.array([t for t, _ in found], np.int64), np.array([n for _, n in found], np.int64)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_known, counts = sent.value
        for batch in batches:
            tokens = _tokens(_signature_rows(batch.column(1))).view(np.int64)
            rank = np.zeros(tokens.shape, np.int64)
            if len(tokens_known):
                at = np.minimum(np.searchsorted(tokens_known, tokens), len(tokens_known) - 1)
                rank = np.where(tokens_known[at] == tokens, counts[at], 0)
            order = np.lexsort((tokens, rank), axis=1)[:, :PREFIX]
            chosen = np.take_along_axis(tokens, order, axis=1)
            reps = np.repeat(batch.column(0).to_numpy(), PREFIX)
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel()), pa.array(reps)], ["token", "rep"])

    return classes.select("rep", "signature").mapInArrow(post, "token long, rep long")


def agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in AGREEMENTS coordinates or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_signature_rows(batch.column(2)) == _signature_rows(batch.column(3))).sum(axis=1) >= AGREEMENTS
            yield batch.select([0, 1]).filter(pa.array(same))

    left = classes.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    return spread_join(pairs, right, "b", "a").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long")


def holding(texts: DataFrame, reps: DataFrame) -> DataFrame:
    """The texts of the rows named; if these are few, the others are left out where they are."""
    if reps.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        reps = F.broadcast(reps)
    return texts.join(reps, "rep", "left_semi")


def similar(pairs: DataFrame, texts: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have the wanted Jaccard similarity. ``texts``: rep, text."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left = batch.column(2).dictionary_encode()  # leaders recur
            sets = shingle_sets(left.dictionary.cast(pa.string()))
            for i, other in zip(left.indices.to_pylist(), shingle_sets(batch.column(3))):
                both = len(np.intersect1d(sets[i], other, assume_unique=True))
                keep.append(100 * both >= percent * (len(sets[i]) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = holding(texts, pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct())
    with_a = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    by_leader = pairs.groupBy("b").agg(F.count("*").alias("n"))
    with_both = spread_join(with_a, texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b", "a", counts=by_leader, total=pairs.count())
    return with_both.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long").distinct()


def blocks(members: DataFrame) -> DataFrame:
    """``members``: leader, rep, component, outside, n_bytes. Each outsider meets every member of its group in one block at least.

    Adds the block numbers i and j; a block has about BLOCK outsiders and BLOCK members, and about twice BLOCK_BYTES of text at
    most (a longer text stands with few others), whatever its group's size.
    """
    parts = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(F.coalesce(size, F.lit(0)) / BLOCK_BYTES))
    outer = F.when(F.col("outside"), F.col("n_bytes"))
    sizes = members.groupBy("leader").agg(F.count("*").alias("n"), parts(F.count("*"), F.sum("n_bytes")).alias("nj"), parts(F.count_if("outside"), F.sum(outer)).alias("ni"))
    sized = spread_join(members, sizes.where("ni > 0").drop("n"), "leader", "rep", counts=sizes.select("leader", "n"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = lambda n: F.pmod(F.xxhash64("rep"), n)
    # an outsider goes to its own row and to its own column of blocks, an insider to its column only
    all_ = sized.withColumns({"j": own(F.col("nj")), "i": F.explode(numbers(F.col("ni")))})
    outside = sized.where("outside").withColumns({"i": own(F.col("ni")), "j": F.explode(numbers(F.col("nj")))})
    both = all_.withColumn("outside", F.col("outside") & (own(F.col("ni")) == F.col("i"))).unionByName(outside.where(F.col("j") != own(F.col("nj"))))
    return both.drop("ni", "nj", "n_bytes")


def _with_partners(block: pd.DataFrame) -> pd.DataFrame:
    """The block's classes that agree well enough with a class of another component, outsiders against all."""
    signed = _signature_rows(pa.array(block["signature"]))
    component, outside = block["component"].to_numpy(), np.flatnonzero(block["outside"].to_numpy())
    found = np.zeros(len(block), bool)
    for k in outside:
        partners = ((signed == signed[k]).sum(axis=1) >= AGREEMENTS) & (component != component[k])
        found |= partners
        found[k] |= partners.any()
    return block.loc[found, ["leader", "rep"]]


def _joined(percent: int):
    def join(block: pd.DataFrame) -> pd.DataFrame:
        """Links that join components: outsiders against all of the block, on full shingle sets."""
        sets = shingle_sets(pa.array(block["text"]))
        sizes = np.array([len(s) for s in sets])
        shingles, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(shingles, kind="stable")
        shingles, doc = shingles[order], doc[order]
        reps, component = block["rep"].to_numpy(), block["component"].to_numpy().copy()
        edges = []
        for k in np.flatnonzero(block["outside"].to_numpy()):
            a, b = np.searchsorted(shingles, sets[k], "left"), np.searchsorted(shingles, sets[k], "right")
            n = b - a
            shared = np.bincount(doc[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())], minlength=len(sets))
            linked = np.flatnonzero((100 * shared >= percent * (sizes + sizes[k] - shared)) & (component != component[k]))
            for other in linked:
                if component[other] != component[k]:
                    edges.append((reps[k], reps[other]))
                    component[component == component[other]] = component[k]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return join


def _linked(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between classes that join all that are similar, but not every link."""
    posted = written(postings(classes), "postings")
    lists = written(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    shared = written(spread_join(posted, lists, "token", "rep", counts=lists), "shared")
    central = shared.join(shared.groupBy("rep").agg(F.sum("n").alias("score")), "rep")
    leaders = central.groupBy("token").agg(F.max(F.struct("score", (-F.col("rep")).alias("l"))).alias("x")).select("token", (-F.col("x.l")).alias("leader"))
    led = written(spread_join(shared, leaders, "token", "rep", counts=lists).select("leader", "rep").distinct(), "led")

    tried = agreeing(led.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")), classes)
    links = written(similar(written(tried, "tried"), texts, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    placed = written(connected_components(links), "placed")

    # a pair with the leader has been compared; groups of two have no other
    of_leader = led.groupBy("leader").agg(F.count("*").alias("n")).where("n > 2").join(placed.select(F.col("node").alias("leader"), F.col("component").alias("main")), "leader", "left")
    of_leader = written(of_leader.select("leader", "n", F.coalesce("main", "leader").alias("main")), "leaders")
    grouped = spread_join(led, of_leader, "leader", "rep", counts=of_leader).join(placed.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    members = grouped.select("leader", "rep", component.alias("component"), (component != F.col("main")).alias("outside")).join(classes.select("rep", "n_bytes"), "rep")
    members = written(members, "members")
    key = ["leader", "i", "j"]
    flagged = blocks(members).join(classes.select("rep", "signature"), "rep").groupBy(*key).applyInPandas(_with_partners, "leader long, rep long").distinct()
    open_ = written(members.join(flagged, ["leader", "rep"]), "open")
    few = holding(texts, open_.select("rep").distinct())
    more = blocks(open_).join(few, "rep").groupBy(*key).applyInPandas(_joined(percent), "a long, b long")
    return links.unionByName(written(more, "more").select(F.col("a").alias("u"), F.col("b").alias("v")))


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (u, v) between the classes of rows that share a doc_id; None where no doc_id has several."""
    some = signed.where("doc_id is not null and set_key is not null")
    several = written(some.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("b"), F.count("*").alias("n")).where("a <> b"), "several")
    if several.isEmpty():
        return None
    held = spread_join(some.select("doc_id", "row", "set_key"), several.select("doc_id", F.col("a").alias("first")), "doc_id", "row", counts=several.select("doc_id", "n"))
    pairs = held.select("set_key", "first").where("set_key <> first").distinct()
    u, v = classes.select("set_key", F.col("rep").alias("u")), classes.select(F.col("set_key").alias("first"), F.col("rep").alias("v"))
    return pairs.join(u, "set_key").join(v, "first").select("u", "v")


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id reachable), kept (it is that one), first (it is
    the one row of its component that stays), and the columns of ``carry``."""
    spark = docs.sparkSession
    # the text is written once: it stands for the column of that name
    others = [c for c in carry if c != text_column]
    carried = [F.struct(*[F.col(c) for c in others]).alias("carry")] if others else []
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("text"), *carried)
    signed = written(signatures(rows), "signatures")

    def judged() -> DataFrame:
        order = [F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"]
        some = signed.where(F.col("set_key").isNotNull())
        least = some.groupBy("set_key").agg(F.min(F.struct(*order, "signature", "n_bytes")).alias("c"), F.count("*").alias("n"))
        classes = written(least.select("set_key", "n", F.col("c.doc_id").alias("doc_id"), F.col("c.row").alias("rep"), F.col("c.signature").alias("signature"), F.col("c.n_bytes").alias("n_bytes")), "classes")
        edges, same = _linked(classes, signed.select(F.col("row").alias("rep"), "text"), percent), _same_document(signed, classes)
        placed = written(connected_components(edges if same is None else edges.unionByName(same)), "components").withColumnRenamed("node", "rep")

        inside = written(classes.select("set_key", "n", "doc_id", "rep").join(placed, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "inside")
        firsts = inside.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rep")).alias("first"))
        known = spread_join(inside, firsts, "component", "rep").select("set_key", F.col("first.doc_id").alias("root"), F.col("first.rep").alias("first_row"))
        told = signed.select("doc_id", "row", "n_shingles", "set_key")
        empty = told.where("set_key is null").withColumns({"root": F.col("doc_id"), "first_row": F.col("row")})
        found = spread_join(told.where("set_key is not null"), known, "set_key", "row", counts=classes.select("set_key", "n")).unionByName(empty)
        kept, root = F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)), F.when(F.col("doc_id").isNotNull(), F.col("root"))
        return found.select("row", "doc_id", "n_shingles", root.alias("component_id"), kept.alias("kept"), (F.col("row") == F.col("first_row")).alias("first"))

    result = settled(spark, judged, "near-duplicates")
    if not carry:
        return result.drop("row")
    own = {c: F.col("text") if c == text_column else F.col("carry")[c] for c in carry}
    return result.join(signed.select("row", *(["text"] if text_column in carry else []), *(["carry"] if others else [])), "row").select(*(c for c in result.columns if c != "row"), *[v.alias(c) for c, v in own.items()])
