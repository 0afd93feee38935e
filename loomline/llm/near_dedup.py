"""Near-dedup by circulant MinHash, banding and exact Jaccard verification (operator 4).

Two permutations of a universe of 2**32 make all coordinates of a signature:
one is applied to a document's shingles, the other, shifted by one place more
for each coordinate, gives the values whose least is the coordinate.  Documents
that agree in a band are candidates, and links are confirmed on the full sets.

Documents with the same words in the same order are one node; their words are
compared in full once, and copies cost nothing further.  In a bucket all nodes
are compared with one of them first.  Buckets whose nodes then still lie in
several components have those outside of its largest component compared with
each other and with that one, pair by pair, in blocks of bounded size; no pair that shares a bucket is left out unless its
nodes are known to be connected, or their signatures rule a link out.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import components
from .workers import small_batches, tidy

SHINGLE = 5
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Coordinates are BANDS * ROWS; a pair at exactly 0.75 misses all bands with probability 5e-6.
BANDS, ROWS = 32, 4
#: In blocks, pairs are taken to the full sets if so many of 128 coordinates agree; at 0.75 fewer do with probability 1e-10.
AGREE = 64
#: Nodes of a bucket, and shingles of theirs, that are compared as one block with another; nodes compared with one copy of a hub's text.
BLOCK, BLOCK_SHINGLES, HUB_NODES = 500, 1_000_000, 1_000
#: Shingles whose coordinates are made together, and words that a worker remembers.
TOGETHER, REMEMBERED = 1 << 16, 200_000

_M64 = (1 << 64) - 1
#: Odd multipliers; any do.
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SIGMA, _PI1, _PI2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F)


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case; both hold for bytes.lower and bytes.split."""
    return (text or "").encode().lower().split()


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    """A document's set: distinct shingles of SHINGLE words, all words as one if there are fewer."""
    words = words_of(text)
    if 0 < len(words) < SHINGLE:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def node_key(words: list[bytes]) -> bytes:
    """128 bits of SHA-256 that stand for a sequence of words (none of which holds a space)."""
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def _firsts(ids: np.ndarray, kinds: int, width: int) -> np.ndarray:
    """Where the distinct ``width``-tuples of neighbouring ids (0 .. kinds - 1) stand first; numbers, not hashes, tell them apart."""
    n = len(ids) - width + 1
    key, bound = ids[:n], kinds
    for i in range(1, width):
        if bound * kinds >= 1 << 63:  # ranks keep the numbers small
            ranks = np.unique(key, return_inverse=True)[1].reshape(-1)
            key, bound = ranks, n
        key, bound = key * kinds + ids[i : i + n], bound * kinds
    return np.unique(key, return_index=True)[1]


class Hasher:
    """64-bit hashes of a text's distinct shingles, with a bounded memory of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """One hash for each distinct shingle: as many as the set has members, even if two of them should be equal."""
        if not words:
            return np.empty(0, np.uint64)
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for word in number:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, number), np.uint64, len(number))
        width = min(SHINGLE, len(words))
        first = _firsts(ids, len(number), width)
        out = np.full(len(first), width, np.uint64)
        for i in range(width):
            out *= _MUL
            out += hashes[ids[first + i]]
            out ^= out >> np.uint64(29)
        out *= _MIX
        out ^= out >> np.uint64(32)
        return out


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of nonempty sets of 64-bit hashes: a row of ``size`` 32-bit coordinates for each."""
    out = np.empty((len(sets), size), np.uint32)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (end == at or n + len(sets[end]) <= TOGETHER):
            n += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        # The first permutation, of the hashes' low 32 bits; the factor of the second is drawn into it.
        x = flat.astype(np.uint32)
        x ^= x >> np.uint32(16)
        x *= _SIGMA
        x ^= x >> np.uint32(13)
        x *= _PI1
        starts = np.cumsum([0] + [len(s) for s in sets[at : end - 1]])
        z, t = np.empty_like(x), np.empty_like(x)
        for k in range(size):  # (sigma + k) * PI1 is the circular shift by k places, then the second permutation goes on
            np.add(x, np.uint32((k * int(_PI1)) & 0xFFFFFFFF), out=z)
            np.right_shift(z, np.uint32(15), out=t)
            np.bitwise_xor(z, t, out=z)
            np.multiply(z, _PI2, out=z)
            np.right_shift(z, np.uint32(14), out=t)
            np.bitwise_xor(z, t, out=z)
            out[at:end, k] = np.minimum.reduceat(z, starts)
        at = end
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each signature; the band's number is part of its key."""
    parts = signature.reshape(len(signature), -1, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key *= _MUL
        key += parts[:, :, i]
        key ^= key >> np.uint64(31)
    key *= _MIX
    key ^= key >> np.uint64(33)
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            words = [words_of(t.as_py()) for t in batch.column("text")]
            sets = list(map(hasher, words))
            filled = [i for i, s in enumerate(sets) if len(s)]
            node: list[bytes | None] = [None] * len(sets)
            sig: list[bytes | None] = [None] * len(sets)
            bands: list[np.ndarray | None] = [None] * len(sets)
            if filled:
                made = signatures([sets[i] for i in filled])
                for i, line, keys in zip(filled, made.astype(np.uint16), band_keys(made), strict=True):
                    node[i], sig[i], bands[i] = node_key(words[i]), line.tobytes(), keys
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "node", "sig", "bands"],
            )


_KEYED_TEXT = "node binary, salt int, salts int, text string"


def _texts_of_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that were joined by id, those whose text is the node's: an id may stand for several texts."""
    for batch in batches:
        good = [node_key(words_of(t.as_py())) == n.as_py() for t, n in zip(batch.column("text"), batch.column("node"), strict=True)]
        yield batch.select(["node", "salt", "salts", "text"]).filter(pa.array(good, pa.bool_()))


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each (node, salt) of sorted rows, after comparing the words of all others with its own in full.

    Texts of different words under one key would make a wrong node, so they end the work with an error.
    """
    group, text, words = None, None, None
    for batch in batches:
        begins = []
        for *key, own in zip(batch.column("node"), batch.column("salt"), batch.column("text"), strict=True):
            key, own = [k.as_py() for k in key], own.as_py()
            begins.append(key != group)
            if begins[-1]:
                group, text, words = key, own, None
            elif own != text:
                words = words_of(text) if words is None else words
                if words_of(own) != words:
                    raise RuntimeError("two sequences of words have one node key")
        yield batch.filter(pa.array(begins, pa.bool_()))


def _compared(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """One text of each node, all rows of which were compared in full.

    copies: node, salts, and id and hash of each row's text.  A node's
    rows are dealt to groups of some HUB_NODES; the groups' first rows, where
    there are several, are compared in a second round.
    """
    same = F.col("doc_id").eqNullSafe(F.col("asked_id")) & F.col("text_hash").eqNullSafe(F.col("asked_hash"))
    salt = F.pmod(F.xxhash64("doc_id", "text_hash", F.spark_partition_id()), F.col("salts")).cast("int").alias("salt")
    matched = rows.join(copies, same).select("node", salt, "salts", "text").mapInArrow(tidy(_texts_of_nodes), _KEYED_TEXT)
    group = ["node", "salt"]
    first = scratch.stage(matched.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(_leaders), _KEYED_TEXT), "op4-texts")
    several = first.where("salts > 1").withColumn("salt", F.lit(0))
    second = scratch.stage(several.repartition("node").sortWithinPartitions(*group).mapInArrow(tidy(_leaders), _KEYED_TEXT), "op4-texts")
    return first.where("salts = 1").unionByName(second).select("node", "text")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hubs and nodes whose full sets are similar enough; a hub's own row, without a node, comes before those of its nodes."""
    hub, hub_set = None, set()
    for batch in batches:
        keep = []
        for a, b, text in zip(batch.column("a"), batch.column("b"), batch.column("text"), strict=True):
            own = shingle_set(text.as_py())
            if not b.is_valid:
                hub, hub_set = a.as_py(), own
                keep.append(False)
                continue
            if a.as_py() != hub:
                raise RuntimeError("a node came before its hub")
            both = len(hub_set & own)
            keep.append(100 * both >= PERCENT * (len(hub_set) + len(own) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


_ROW = ("bucket", "low", "high", "side", "band", "node", "root", "n_shingles", "sig")


def _candidates(lines: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """Places of two rows of a group, and how many coordinates they share, where the full sets must decide.

    The two lie in different components and in different blocks (or the same,
    if the group has one), sizes and signatures allow a link, and this bucket
    is that of the first band that they share, so that no pair comes twice.
    """
    _, low, high, _, band = lines[0][:5]
    label = {r: i for i, r in enumerate(dict.fromkeys(line[6] for line in lines))}
    root = np.array([label[line[6]] for line in lines])
    side, size = np.array([line[3] for line in lines]), np.array([line[7] for line in lines])
    sigs = np.frombuffer(b"".join(line[8] for line in lines), np.uint16).reshape(len(lines), -1)
    place = np.arange(len(lines))
    for i in place if low == high else place[side == 0]:
        others = place[i + 1 :] if low == high else place[side == 1]
        others = others[(root[others] != root[i]) & (100 * np.minimum(size[others], size[i]) >= PERCENT * np.maximum(size[others], size[i]))]
        if len(others):
            same = sigs[others] == sigs[i]
            agree = same.sum(axis=1)
            near = agree >= AGREE
            first = same[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            for j, n in zip(others[near][first].tolist(), agree[near][first].tolist(), strict=True):
                yield int(i), j, n


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Sorted rows of one (bucket, block, block) after the other; a group has two blocks at most."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

    for _, group in itertools.groupby(rows(), lambda r: r[:3]):
        lines = list(group)
        if len(lines) > 1:
            yield lines


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of groups that some candidate has: at most as many as came in, however many candidates there are."""
    schema, out = None, []

    def seen():
        nonlocal schema
        for batch in batches:
            schema = batch.schema
            yield batch

    for lines in _groups(seen(), _ROW):
        used = set()
        for i, j, _ in _candidates(lines):
            used.update((i, j))
        out += [lines[i] for i in sorted(used)]
        if len(out) >= 2_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(_ROW, zip(*out, strict=True), strict=True)], names=list(_ROW))
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(_ROW, zip(*out, strict=True), strict=True)], names=list(_ROW))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that the full sets confirm, the likeliest first; a candidate whose rows links of the group already connect adds nothing."""
    found: list[tuple[bytes, bytes]] = []
    for lines in _groups(batches, (*_ROW, "text")):
        head = {line[6]: line[6] for line in lines}

        def top(root, head=head):
            while head[root] != root:
                head[root] = head[head[root]]
                root = head[root]
            return root

        sets: dict[int, set] = {}
        for i, j, _ in sorted(_candidates(lines), key=lambda c: -c[2]):
            a, b = top(lines[i][6]), top(lines[j][6])
            if a == b:
                continue
            for k in (i, j):
                if k not in sets:
                    sets[k] = shingle_set(lines[k][-1])
            both = len(sets[i] & sets[j])
            if 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                head[a] = b
                found.append((lines[i][5], lines[j][5]))
        if len(found) >= 50_000:
            yield _pairs(found)
            found = []
    if found:
        yield _pairs(found)


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _confirmed(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """Stars (hub, node) that the full sets confirm, as links (a, b).

    A hub's text goes to one group for each HUB_NODES of its nodes, and each
    node's text to its group.
    """
    salts = F.ceil(F.count(F.lit(1)) / HUB_NODES).cast("int").alias("salts")
    sized = scratch.stage(stars.groupBy("hub").agg(salts), "op4-sized")
    dealt = stars.join(sized, "hub").select("node", F.col("hub").alias("a"), F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    nodes = dealt.join(texts, "node").select("a", "salt", F.col("node").alias("b"), "text")
    hubs = sized.join(texts, F.col("hub") == F.col("node")).select(F.col("hub").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("b"), "text")
    grouped = nodes.unionByName(hubs).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull())
    return grouped.mapInArrow(tidy(_verify), "a binary, b binary")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id of the rows that links connect, its own
    included.  A null text or one without words has an empty set: it is linked
    with nothing, not even with its like, and is kept.  Rows of the same words
    are linked, so of rows that repeat an id and text all are kept or none.  A
    null id is never a component_id unless a component has no other; rows that
    share an id but not a text are nodes of their own.  Other columns are
    ignored; no rows give no rows.
    """
    found = _components(docs, id_col, text_col)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, component_id and root (null without words) of each row, and text_hash of its text."""
    small_batches(docs.sparkSession)
    begun = scratch.mark()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed = scratch.stage(rows.mapInArrow(tidy(_sign), "doc_id long, text_hash long, n_shingles long, node binary, sig binary, bands array<long>"), "op4-signed")
    light = signed.select("doc_id", "text_hash", "n_shingles", "node")
    one = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n_shingles", "bands", "sig")
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(one).alias("r"), F.count(F.lit(1)).alias("copies")).select("node", "copies", "r.doc_id", "r.n_shingles", "r.bands", "r.sig")
    nodes = scratch.stage(nodes, "op4-nodes")

    # Buckets of two nodes or more.  All others of a bucket are compared with its hub first: the node that meets most nodes
    # in all its buckets, as the original of a group of near copies does, so that the group hangs together at once.
    banded = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    # What is joined back on a key that may be common is staged first: a join of two plain shuffles is one that Spark can split.
    shared = scratch.stage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "op4-buckets")
    members = scratch.stage(banded.join(shared, "bucket"), "op4-members")
    meets = members.groupBy("node").agg(F.sum("members").alias("meets"), F.first("n_shingles").alias("n"))
    placed = members.join(meets, "node")
    hubs = scratch.stage(placed.groupBy("bucket").agg(F.max(F.struct("meets", "node", "n")).alias("hub")), "op4-hubs")
    size, hub_size = F.col("n_shingles"), F.col("hub.n")
    fits = F.lit(100) * F.least(size, hub_size) >= F.lit(PERCENT) * F.greatest(size, hub_size)
    stars = members.join(hubs, "bucket").where((F.col("node") != F.col("hub.node")) & fits)
    # Two that are each other's hub make one star.
    stars = stars.groupBy(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).agg(F.max("hub.node").alias("hub"))
    stars = scratch.stage(stars.select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node")), "op4-stars")

    # The texts of all nodes in buckets, once for both rounds, and of all copies, which are compared on the way.
    bucketed = members.select("node").distinct().withColumn("bucketed", F.lit(True))
    asked = nodes.select("node", "copies").join(bucketed, "node", "left").where("copies > 1 or bucketed")
    asked = asked.select("node", F.ceil(F.col("copies") / HUB_NODES).cast("int").alias("salts"))
    asked = light.join(asked, "node").select("node", "salts", F.col("doc_id").alias("asked_id"), F.col("text_hash").alias("asked_hash")).distinct()
    texts = _compared(rows, asked)
    first = scratch.stage(_confirmed(stars, texts), "op4-links")

    roots = scratch.stage(components(first), "op4-roots")
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = scratch.stage(placed, "op4-placed")
    # Of a bucket, those outside of its largest component (blocks 0 ..) meet each other and that component (blocks after theirs).
    by_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    by_root = by_root.groupBy("bucket").agg(F.max(F.struct("n", "w", "root")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("roots"))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    open_buckets = by_root.where("roots > 1").select("bucket", F.col("main.root").alias("main_root"), blocks(F.col("main.n"), F.col("main.w")).alias("main_blocks"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("rest_blocks"))
    open_buckets = scratch.stage(open_buckets, "op4-open")
    waiting = placed.join(open_buckets, "bucket").join(nodes.select("node", "sig"), "node")
    in_main, rest = F.col("root") == F.col("main_root"), F.col("rest_blocks")
    dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    waiting = waiting.withColumn("own", F.when(in_main, rest + dealt(F.col("main_blocks"))).otherwise(dealt(rest)))
    waiting = waiting.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_main, rest).otherwise(rest + F.col("main_blocks")) - 1)))
    side = (F.col("own") > F.col("other")).cast("int")
    waiting = waiting.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"), "band", "node", "root", "n_shingles", "sig")
    group = ["bucket", "low", "high"]
    involved = waiting.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(_involved), waiting.schema)
    involved = scratch.stage(involved, "op4-involved")
    second = involved.join(texts, "node").select(*_ROW, "text").repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(_linked), "a binary, b binary")
    second = scratch.stage(second, "op4-links")

    final = scratch.stage(components(first.unionByName(second)), "op4-roots")
    named = light.join(final, "node", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "node").alias("root"))
    named = named.where(F.col("root").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    least = scratch.stage(named.groupBy("root").agg(first.alias("first")), "op4-least")
    grouped_rows = named.join(least, "root").select("doc_id", "text_hash", "n_shingles", F.col("first.doc_id").alias("component_id"), F.col("first.text_hash").alias("first_hash"))
    alone = light.where(F.col("node").isNull()).select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.col("text_hash").alias("first_hash"))
    result = grouped_rows.unionByName(alone)
    scratch.release_unread(scratch.since(begun), result)
    return result


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, with all its columns: that with the smallest id, or of those that share it the one with the least hash of its text.

    Rows without words are kept.  Rows equal in id and text are one row here: all of them are kept or none.
    """
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    kept = _components(docs, id_col, text_col).where(first).select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    hashed = docs.withColumn("_own_hash", F.xxhash64(text_col))
    return hashed.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id")) & (F.col("_own_hash") == F.col("_kept_hash")), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
