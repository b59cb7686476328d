"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification.

Texts are sets (or, with ``weighted``, multisets) of five-word shingles of lower-cased
words. Hashed darts are thrown into the rectangle weight x rank of every shingle, in
dyadic regions, so that a text only throws about as many darts as its signature
needs; a dart lands if the shingle's weight reaches it. Every dart belongs to one
coordinate, and the earliest one per coordinate is the signature. Two signatures
agree in a coordinate with the weighted Jaccard similarity as probability.

Candidates share a band of coordinates. Texts with one set of shingles are one node,
however many they are, and lists with the same members are compared once. It goes in rounds:

1. The nodes of a band are compared in full if they are few. Else every one is
   compared with their hub, the node with the fewest shingles.
2. Nodes that stood with one hub meet again by the shingles that the hub lacks, if not
   all of them are in its component. No node is smaller than its hub R, so if U is not
   similar to R, then U and another node A can only be similar if they share such a
   shingle: else U would share as much with R, which is no larger than A. Shingles
   that the same nodes have count as one, and of each node only the rarest: a text
   similar to U lacks at most n - 0.8 n of U's n shingles, so the rarest that both have
   comes before U could have missed more. What so is left of one hub's nodes is
   compared in full, up to ``small_rest`` nodes; beyond, those that share a shingle are
   compared with a hub of their own, whose rest is treated in the same way.
3. After ``hub_rounds`` such rounds what is left is compared in full, whatever its
   number.

A long list is cut into parts, and any two parts meet in one tile of bounded size.
So no link between nodes that share a band is lost. Similarity is verified on whole
shingle sets, and nodes of one component are never compared again. The rounds with hubs
take at most a fixed number of comparisons for each node and list; the last takes the
square of what is left after all of them, nodes neither similar to any of their hubs nor
different enough beside it.

Defined cases: texts equal byte by byte, empty and null ones included, share a class;
a text of fewer than five words is one shingle of all of them; texts without a word
are similar to equal texts only; the class id is the smallest non-null doc_id of the
class, null if there is none; the row of that id stays, of several with different
texts one; rows repeating id and text are one document, flagged alike, of which
:func:`deduplicate` returns one; an empty table gives an empty result; extra columns
are ignored; memory grows with the longest text of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_rows, keep, light_driver, passing, text_of
from eventloom.llm.components import components

WORD = re.compile(r"\w+")
SHINGLE = 5
# Multipliers of the 64-bit finaliser and of word positions.
_MULTIPLY = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLY[0]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLY[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, those seen lately remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        self[word] = found
        return found


_hashes = WordHashes()


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, times) of all distinct shingles, sorted by owner and shingle."""
    words = [WORD.findall((t or "").lower()) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    hashes = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
    counts = np.where(sizes == 0, 0, np.maximum(1, sizes - SHINGLE + 1))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner]
    end = first[owner] + sizes[owner]
    found = np.zeros(len(owner), np.uint64)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
    for i in range(SHINGLE):
        inside = at + i < end
        found = mixed(found * _STEP + np.where(inside, padded[at + i], np.uint64(i + 1)))
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    starts = np.flatnonzero(new)
    return owner[starts], found[starts], np.diff(np.append(starts, len(owner)))


def region(w: int, r: int) -> np.uint64:
    """A constant of the dyadic region of weight level w and rank level r."""
    return mixed(np.array([64 * w + r + 1], np.uint64))[0]


@dataclass
class DartMinHash:
    """Signatures of ``k`` coordinates; ``width`` is the first rank region's extent."""

    k: int = 80
    width: float = 0.125
    rank_bits: int = 18
    _tables: dict[float, np.ndarray] = field(default_factory=dict)

    def _counts(self, area: float, cells: np.ndarray) -> np.ndarray:
        """Darts per cell: Poisson with the region's area as mean, from the cell's hash."""
        if area not in self._tables:
            n = np.arange(int(area + 12 * area**0.5 + 30))
            log_p = n * np.log(area) - area - np.cumsum(np.log(np.maximum(n, 1)))
            self._tables[area] = np.cumsum(np.exp(log_p))
        return np.searchsorted(self._tables[area], (cells >> np.uint64(11)) * 2.0**-53, side="right")

    def signatures(self, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_sets: int) -> np.ndarray:
        """Matrix set x coordinate of 32-bit dart names; sets without elements get zeros."""
        total = np.bincount(owner, weights=weight, minlength=n_sets)
        expected = self.k * (np.log(self.k) + 5)
        reach = np.where(total > 0, expected / np.maximum(total, 1e-300), 0.0)
        empty = np.iinfo(np.uint64).max
        best = np.full(n_sets * self.k, empty, np.uint64)
        open_ = total > 0
        while open_.any():
            mine = open_[owner]
            self._throw(owner[mine], element[mine], weight[mine], reach, best)
            open_ = (total > 0) & (best.reshape(n_sets, self.k) == empty).any(axis=1)
            reach = np.where(open_, 2 * reach, reach)
        names = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_sets, self.k)
        names[total == 0] = 0
        return names

    def _throw(self, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, reach: np.ndarray, best: np.ndarray) -> None:
        for w in range(64):
            low_weight = 2.0**w - 1
            heavy = np.flatnonzero(weight > low_weight)
            if not len(heavy):
                return
            for r in range(64):
                low_rank, extent = (2.0**r - 1) * self.width, 2.0**r * self.width
                own = heavy[reach[owner[heavy]] > low_rank]
                if not len(own):
                    break
                cells = mixed(element[own] ^ region(w, r))
                n = self._counts(2.0**w * extent, cells)
                of = np.repeat(np.arange(len(own)), n)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                dart = mixed(cells[of] + (nth.astype(np.uint64) + np.uint64(1)) * _STEP)
                place = mixed(dart ^ _STEP)
                rank = low_rank + (dart >> np.uint64(32)) * (2.0**-32 * extent)
                of = own[of]
                landed = rank < reach[owner[of]]
                if w or (weight[own] < 1).any():
                    landed &= low_weight + (dart & np.uint64(0xFFFFFFFF)) * (2.0**-32 * 2.0**w) < weight[of]
                of, rank, place = of[landed], rank[landed], place[landed]
                coordinate = ((place >> np.uint64(32)) * np.uint64(self.k)) >> np.uint64(32)
                value = ((rank * 2.0**self.rank_bits).astype(np.uint64) << np.uint64(32)) | (place & np.uint64(0xFFFFFFFF))
                np.minimum.at(best, owner[of] * self.k + coordinate.astype(np.int64), value)


def band_keys(names: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    n, k = names.shape
    keys = np.zeros((n, k // rows), np.uint64)
    for i in range(rows):
        keys = mixed(keys * _STEP + names[:, i::rows][:, : k // rows] + np.uint64(1))
    return mixed(keys + np.arange(k // rows, dtype=np.uint64) * _STEP).view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: int, most_chars: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about so many characters of text; a longer text is a slice by itself."""
    for batch in batches:
        lengths = [len(t or "") for t in batch.column(column).to_pylist()]
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > most_chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield batch.slice(start)


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, kind))


@dataclass(frozen=True)
class Settings:
    """Bands of ``rows`` coordinates each: at similarity 0.8 a pair shares none with probability 2.6e-5."""

    bands: int = 20
    rows: int = 4
    similarity: float = 0.8
    weighted: bool = False
    #: Lists of at most so many nodes are compared in full: those of bands, then what one hub left.
    small_bucket: int = 16
    small_rest: int = 2000
    #: Rounds in which what a hub left may get hubs of its own.
    hub_rounds: int = 4
    #: Longer lists than two sides are compared in tiles of about two sides of nodes.
    side: int = 250


def elements(found: np.ndarray, times: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``found``, element): shingles; with ``weighted`` every occurrence is an element of its own.

    The weighted similarity of two texts is the plain one of these sets.
    """
    if not weighted:
        return np.arange(len(found)), found
    at = np.repeat(np.arange(len(found)), times)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    return at, np.where(nth > 0, mixed(found[at] + nth.astype(np.uint64) * _STEP), found[at])


def set_digests(owner: np.ndarray, element: np.ndarray, n_sets: int) -> list[bytes | None]:
    """A 128-bit digest of each set, None for a set without elements."""
    out: list[bytes | None] = [None] * n_sets
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    if len(starts):
        sums = np.stack([np.add.reduceat(mixed(element ^ salt), starts) for salt in _MULTIPLY], axis=1)
        for i, pair in zip(owner[starts].tolist(), sums, strict=True):
            out[i] = b"s" + pair.tobytes()
    return out


def sign(docs: DataFrame, settings: Settings) -> DataFrame:
    """Per document: doc_id, text_key, key (of its set; of the text if it has no word), size of its set, bands (none without words)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = DartMinHash(settings.bands * settings.rows)
        for batch in slices(batches, 2):
            owner, element, times = shingles(batch.column(2).to_pylist())
            weight = times.astype(float) if settings.weighted else np.ones(len(times))
            keys = band_keys(hasher.signatures(owner, element, weight, len(batch)), settings.rows)
            some = np.bincount(owner, minlength=len(batch)) > 0
            size = np.bincount(owner, weights=weight, minlength=len(batch)).astype(np.int64)
            at, whole = elements(element, times, settings.weighted)
            digests = set_digests(owner[at], whole, len(batch))
            own = [digest or b"t" + text for digest, text in zip(digests, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own, pa.binary()), pa.array(size), _lists(keys[some].ravel(), some * keys.shape[1], pa.int64())],
                names=["doc_id", "text_key", "key", "size", "bands"],
            )
        _hashes.clear()  # the worker goes on to other work

    return _keyed(docs).select("doc_id", "text_key", "text").mapInArrow(rows, "doc_id long, text_key binary, key binary, size long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))


def nodes_of(signed: DataFrame) -> DataFrame:
    """One node per set: node (ascending with size), key, n (rows), source (its first document, null ids last), bands."""
    grouped = signed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("source"),
        F.first("size").alias("size"),
        F.first("bands").alias("bands"),
    )
    return keep(grouped.orderBy("size", "key").withColumn("node", F.monotonically_increasing_id()), "nodes")


def shingle_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, source, repeated), from one of their documents.

    Of a node whose rows may repeat (``repeated``) each task makes one set, and one of those stays.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[int] = set()
        for batch in batches:
            first = []
            for i, (node, repeated) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not repeated or node not in made:
                    first.append(i)
                if repeated:
                    made.add(node)
            for part in slices([batch.take(pa.array(first, pa.int64()))], 1):
                owner, element, times = shingles(part.column(1).to_pylist())
                at, whole = elements(element, times, settings.weighted)
                counts = np.bincount(owner[at], minlength=len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(whole.view(np.int64), counts, pa.int64()), part.column(2)], names=["node", "shingles", "repeated"])
        _hashes.clear()

    own = _keyed(docs)
    wanted = wanted.select("node", "repeated", F.col("source.doc_id").alias("from_id"), F.col("source.text_key").alias("from_key"))
    same = own["doc_id"].eqNullSafe(wanted["from_id"]) & (own["text_key"] == wanted["from_key"])
    made = own.join(wanted, same).select("node", "text", "repeated").mapInArrow(rows, "node long, shingles array<long>, repeated boolean")
    with arrow_rows(docs.sparkSession, 1000):
        made = keep(made, "made-sets")
    once = keep(made.filter("repeated").dropDuplicates(["node"]), "sets-of-repeated")
    return made.filter("NOT repeated").union(once).drop("repeated")


def _distinct_lists(rows: DataFrame) -> DataFrame:
    """Of lists (bucket, node, component) with the same members one, with its length ``n``; none that holds a single component.

    Members are the same where their number and two independent 64-bit hashes of the list agree.
    """
    lists = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("h1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"),
        F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    chosen = lists.filter("low <> high").groupBy("n", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return keep(rows.join(keep(chosen, "chosen"), "bucket").select("bucket", "node", "component", "n"), "lists")


def _tiles(lists: DataFrame, side: int) -> DataFrame:
    """(bucket, low, high, part, node, component): lists cut into tiles of about 2 * side nodes at most.

    A longer list is dealt into parts of about ``side`` nodes, and any two parts meet in one tile.
    """
    parts = F.when(F.col("n") <= 2 * side, F.lit(1)).otherwise(F.ceil(F.col("n") / side).cast("int"))
    dealt = lists.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "component")


def linked_within(node: np.ndarray, component: np.ndarray, part: np.ndarray, shingle: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that join the similar nodes of one tile, compared in full; nodes of one component, or of one of two parts, are not compared."""
    n = len(node)
    apart = component[:, None] != component[None, :]
    if part.min() != part.max():
        apart &= part[:, None] != part[None, :]
    least = np.minimum(sizes[:, None], sizes[None, :])
    apart &= least >= similarity * np.maximum(sizes[:, None], sizes[None, :])
    if not apart.any():
        return []
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    again = np.concatenate([[False], shingle[1:] == shingle[:-1]])
    shared = again | np.append(again[1:], False)
    column = np.cumsum(~again[shared]) - 1  # of shingles that two nodes have
    owner = owner[shared]
    common = np.zeros((n, n), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, columns, 4096):
        inside = slice(*np.searchsorted(column, [low, low + 4096]))
        has = np.zeros((n, min(4096, columns - low)), np.float32)
        has[owner[inside], column[inside] - low] = 1
        common += has @ has.T
    linked = apart & (common >= similarity * (sizes[:, None] + sizes[None, :] - common))
    label = np.arange(n)
    while True:  # every node takes the least label among those that it is linked to
        lower = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        if (lower == label).all():
            break
        label = lower
    return [(int(node[i]), int(node[j])) for i, j in enumerate(label.tolist()) if i != j]


def verify(tiles: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) of the tiles; a task holds one tile's sets at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def compared(tile: pa.Table) -> list[tuple[int, int]]:
            node, component, part = (tile.column(i).to_numpy() for i in (3, 4, 5))
            lists = tile.column(6).combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            return linked_within(node, component, part, lists.flatten().to_numpy(), sizes, settings.similarity)

        for batch in chain(batches, [None]):
            found = []
            if batch is None or not len(batch):
                cuts = []
            else:
                keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
                cuts = (np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()
                if rest and any(rest[-1].column(i)[-1] != batch.column(i)[0] for i in range(3)):
                    cuts.insert(0, 0)
            start = 0
            for cut in cuts:
                found += compared(pa.Table.from_batches([*rest, *([batch.slice(start, cut - start)] if cut > start else [])]))
                rest, start = [], cut
            if batch is not None and len(batch):
                rest.append(batch.slice(start))
            elif batch is None and rest:
                found += compared(pa.Table.from_batches(rest))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    whole = tiles.join(sets, "node").select("bucket", "low", "high", "node", "component", "part", "shingles")
    dealt = whole.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(rows, "a long, b long")


def compare_with_hubs(large: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Members of lists against their hub, the smallest node: node, hub, linked, extra (what the hub lacks), spare.

    Both sides of every join are written tables, so Spark can split a large list.
    """
    hubs = keep(large.groupBy("bucket").agg(F.min("node").alias("hub")), "hubs")
    pairs = keep(large.select("bucket", "node").join(hubs, "bucket").filter("node <> hub").select("node", "hub").distinct(), "pairs-with-hubs")
    other = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("of_hub"))
    common = F.size(F.array_intersect("shingles", "of_hub"))
    n = F.size("shingles")
    return pairs.join(sets, "node").join(other, "hub").select(
        "node",
        "hub",
        (common >= F.lit(settings.similarity) * (n + F.size("of_hub") - common)).alias("linked"),
        F.array_except("shingles", "of_hub").alias("extra"),
        # A text that is similar to this one lacks at most so many of its shingles.
        (n - F.floor(F.lit(settings.similarity) * n)).alias("spare"),
    )


def _meetings(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """(hub, bucket, node, component): nodes that stood with one hub and share a shingle that it lacks, if one of them is not in its component.

    Shingles of a hub that the same nodes have are one; of each node only its rarest
    count, until it could not do without more of them.
    """
    of_hub = labels.select(F.col("node").alias("hub"), F.col("component").alias("of_hub"))
    own = _labelled(stars, labels).join(of_hub, "hub", "left").withColumn("loose", F.col("component") != F.coalesce("of_hub", "hub"))
    own = keep(own.select("hub", "node", "component", "loose", "extra", "spare"), "stars")
    spread = own.select("hub", "node", "component", "loose", "spare", F.size("extra").alias("extras"), F.explode("extra").alias("shingle"))
    shared = spread.groupBy("hub", "shingle").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"), F.max("loose").alias("any_loose")
    )
    bundles = shared.filter("n > 1").groupBy("hub", "n", "h1", "h2", "any_loose").agg(F.min("shingle").alias("shingle"), F.count(F.lit(1)).alias("weight"))
    placed = spread.join(keep(bundles.select("hub", "shingle", "n", "weight", "any_loose"), "bundles"), ["hub", "shingle"])
    of_node = Window.partitionBy("hub", "node")
    rarer = F.coalesce(F.sum("weight").over(of_node.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alone = F.col("extras") - F.sum("weight").over(of_node.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = placed.withColumns({"rarer": rarer, "alone": alone})
    return ranked.filter("any_loose AND rarer + alone <= spare").select("hub", F.xxhash64("hub", "shingle").alias("bucket"), "node", "component")


def _of_hubs(met: DataFrame) -> DataFrame:
    """The nodes that meet again under one hub, as one list (bucket: the hub)."""
    return met.select(F.col("hub").alias("bucket"), "node", "component").distinct()


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add each node's component; a node without a link is its own."""
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def link(docs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """(node, component) of all nodes that have a link, in the rounds of the module's text."""
    lists = _distinct_lists(nodes.select(F.explode("bands").alias("bucket"), "node", F.col("node").alias("component")))
    members = lists.select("node").distinct()
    sets = shingle_sets(docs, members.join(nodes.select("node", "source", (F.col("n") > 1).alias("repeated")), "node"), settings)

    def round_(full: DataFrame, large: DataFrame | None, labels: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """New labels, and what was compared with hubs."""
        links, stars = verify(_tiles(full, settings.side), sets, settings), None
        if large is not None:
            stars = keep(compare_with_hubs(large, sets, settings), "with-hubs")
            links = links.union(stars.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))
        with arrow_rows(docs.sparkSession, 1000):
            links = keep(links, "found")
        if labels is None:
            return components(links), stars
        known = labels.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        return (labels if links.isEmpty() else components(links.union(known))), stars

    labels, stars = round_(lists.filter(F.col("n") <= settings.small_bucket), lists.filter(F.col("n") > settings.small_bucket), None)
    for left in reversed(range(settings.hub_rounds)):
        if stars.isEmpty():
            return labels
        met = keep(_meetings(stars, labels), "met")
        rest = _distinct_lists(_of_hubs(met))
        crowded = keep(rest.filter(F.col("n") > settings.small_rest).select(F.col("bucket").alias("hub")).distinct(), "crowded")
        if not left or crowded.isEmpty():
            break
        large = _distinct_lists(met.join(crowded, "hub", "left_semi").select("bucket", "node", "component"))
        labels, stars = round_(rest.filter(F.col("n") <= settings.small_rest), large, labels)
    return round_(rest, None, labels)[0]


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, class_id, class_size, kept, text_key."""
    with arrow_rows(docs.sparkSession, 1000):
        signed = keep(sign(docs, settings), "signed")
    with light_driver(docs.sparkSession):
        with passing(docs.sparkSession):
            nodes = nodes_of(signed)
            labelled = keep(_labelled(nodes.select("node", "key", "source", "n"), link(docs, nodes, settings)), "labelled", lasting=True)
        whole = keep(labelled.groupBy("component").agg(F.min("source").alias("first"), F.sum("n").alias("class_size")), "classes")
        by_key = keep(labelled.select("key", "component").join(whole, "component").drop("component"), "class-keys")
    # Joined where and when the caller reads it, with the caller's settings: not through the driver either.
    return signed.select("doc_id", "text_key", "key").join(by_key.hint("merge"), "key").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("kept"),
        "text_key",
    )


def _row_key(doc_id: Column, text_key: Column) -> Column:
    """Names a row by its id and text: one column, so that what is joined by it is also grouped by it."""
    return F.unhex(F.md5(F.concat(text_key, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))))


def deduplicate(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document, with its own columns, of each class."""
    kept = classes(docs, settings).filter("kept").select(_row_key(F.col("doc_id"), F.col("text_key")).alias("__row"))
    tagged = docs.withColumn("__row", _row_key(F.col("doc_id").cast("long"), F.unhex(F.md5(text_of()))))
    return tagged.join(kept.hint("merge"), "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
