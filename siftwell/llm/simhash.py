"""SimHash near-duplicates: 64-bit fingerprints linked through rings of segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import connected_components, map_texts, set_aside, word_blocks
from siftwell.runtime import cut_lineage, drop_written

SEED = 42
BITS = 64
#: Rows, and share of rows, on which the order of the shingles is estimated, and how many common ones are put last; any order finds the same pairs.
ORDER_ROWS, ORDER_SHARE, ORDER_SHINGLES = 20_000, 0.25, 1_000_000
#: Share of a text's first shingles that it has in common with a neighbour to be compared with it ahead of all others.
CHAIN_SHARE = 0.25
#: Bits in which the SimHashes of texts that are compared ahead of all others differ at most.
STAR_BITS = 2
#: Rounds in which each text is compared with one text of another group next to it in some order, as long as groups grow by it.
SWEEPS = 2
#: Rounds in which only the best candidate of every two groups is compared; what is left then is compared at once.
ROUNDS = 2
#: 64-bit words of a text's parities.
PARITY_WORDS = 8


def _tally(counts: np.ndarray, shingles: Iterable[bytes]) -> int:
    """Add the set bits of the shingles' hashes to ``counts``; how many shingles there were."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    for i in range(0, len(hashes), 1 << 16):
        block = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return len(hashes)


def fingerprint(data: bytes | None, words: int = 3) -> int:
    """SimHash of a UTF-8 text as a signed 64-bit number.

    A-Z count as a-z, shingles are ``words`` consecutive words (fewer words: the
    whole sequence, none: zero), and a bit is set if over half of the shingles'
    XXH64 values have it. A very long text is read in blocks.
    """
    counts, total, tail = np.zeros(BITS, np.int64), 0, []
    for block in word_blocks((data or b"").lower()):
        tail += block
        total += _tally(counts, map(b" ".join, zip(*(tail[i:] for i in range(words)), strict=False)))
        tail = tail[max(0, len(tail) - words + 1) :]
    if not total and tail:
        total = _tally(counts, [b" ".join(tail)])
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``fingerprint`` (long) of the whole text."""
    return map_texts(docs, text, keep, "fingerprint long", lambda texts: [[fingerprint(t, words) for t in texts]])


def _mask(start: int, length: int, segments: int) -> int:
    """Bits of ``length`` consecutive segments of the ring from ``start``, as a signed number."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    bits = 0
    for s in (x % segments for x in range(start, start + length)):
        bits |= (1 << edges[s + 1]) - (1 << edges[s])
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _viable(difference: Column, start: int, max_bits: int, segments: int) -> Column:
    """Every chain from segment ``start`` stays within its share of the budget."""
    out = F.lit(True)
    for length in range(1, segments + 1):
        out = out & (F.bit_count(difference.bitwiseAND(F.lit(_mask(start, length, segments)))) <= length * max_bits // segments)
    return out


def fingerprint_links(prints: DataFrame, max_bits: int = 2, segments: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct ``fingerprint`` values that differ in at most ``max_bits`` bits.

    Pigeonring: with the 64 bits as a ring of segments, some segment of every such
    pair starts a chain whose first l segments differ in at most l * max_bits / segments
    bits, for each l. The chain's first segments have no budget, so they must be equal:
    they are the join key, one row per start. The longer chains are checked within the
    join, one segment more at a time, so that most candidates fall out before the last of them, the whole Hamming distance. A pair comes from its first viable start only.
    """
    segments = segments or 2 * max_bits + 1
    if segments <= max_bits:
        raise ValueError("more segments than bits are needed")
    equal = max(n for n in range(1, segments) if n * max_bits < segments)
    starts = F.array(*[F.struct(F.lit(i).alias("start"), F.col("fingerprint").bitwiseAND(F.lit(_mask(i, equal, segments))).alias("key")) for i in range(segments)])
    rows = prints.select("fingerprint", F.explode(starts).alias("s")).select("fingerprint", "s.start", "s.key")
    left = rows.select(F.col("fingerprint").alias("a"), "start", "key")
    right = rows.select(F.col("fingerprint").alias("b"), "start", "key")
    difference = F.col("a").bitwiseXOR(F.col("b"))
    viable, earlier = F.lit(False), F.lit(False)
    for i in reversed(range(segments)):
        viable = F.when(left["start"] == i, _viable(difference, i, max_bits, segments)).otherwise(viable)
        earlier = earlier | ((left["start"] > i) & _viable(difference, i, max_bits, segments))
    ring = (left["start"] == right["start"]) & (left["key"] == right["key"])
    return left.join(right, ring & (F.col("a") < F.col("b")) & viable & ~earlier).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id that a document reaches over links of at most
    ``max_bits`` bits. Copies meet in one fingerprint, which is linked once. A null or
    wordless text has fingerprint zero and is linked like any other; a null id gets its
    group's id and names a group only if nothing else is in it; repeated rows are
    repeated in the result; other columns are ignored; an empty table gives no rows.
    """
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = cut_lineage(fingerprints(named, words))
    distinct = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    groups = connected_components(fingerprint_links(distinct, max_bits))
    roots = distinct.join(groups, distinct["fingerprint"] == groups["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(roots.join(smallest, "root").select("fingerprint", "component_id"), "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def shingle_set(data: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text (fewer words: the whole sequence; none: nothing)."""
    shingles, tail, total = [np.zeros(0, np.uint64)], [], 0
    for block in word_blocks((data or b"").lower()):
        tail += block
        shingles.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(tail[i:] for i in range(words)), strict=False))), np.uint64)))
        total += len(shingles[-1])
        tail = tail[max(0, len(tail) - words + 1) :]
    if not total and tail:
        shingles.append(np.array([xxhash.xxh64_intdigest(b" ".join(tail))], np.uint64))
    return np.unique(np.concatenate(shingles))


def set_fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a set of shingle hashes as a signed 64-bit number: a bit is set if over half of them have it."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(shingles), 1 << 16):
        counts += np.unpackbits(shingles[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view(np.int64)[0])


def parities(shingles: np.ndarray) -> np.ndarray:
    """64 * PARITY_WORDS bits of a set of shingle hashes: whether an odd number of them falls on each. Those of two sets differ in no more bits than the sets in shingles."""
    odd = np.bincount((shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _digest(text: str) -> Column:
    """128-bit digest of a text; texts without words have that of the empty one."""
    return F.md5(F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.col(text)).otherwise(F.lit("")))


def _common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, texts that hold them) of the most common ones in a sample; only an order is taken from them, and any order finds the same pairs."""
    total = texts.count()
    share = min(1.0, max(ORDER_SHARE, ORDER_ROWS / max(total, 1)))
    seen = map_texts(texts.sample(share, 7), "text", (), "shingles array<long>", lambda found: ([shingle_set(t, words).view(np.int64) for t in found],))
    counted = seen.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("held")).where("held > 2")
    common = counted.orderBy(F.desc("held"), "shingle").limit(ORDER_SHINGLES).toArrow()
    keys, held = common.column("shingle").to_numpy(), common.column("held").to_numpy()
    by_key = np.argsort(keys)
    return keys[by_key], held[by_key]


def distinct_texts(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, digest, doc_id, n, fingerprint, parity, first) of the distinct texts of ``docs`` (doc_id, text), written: a number, the text's 128-bit digest, its smallest
    doc_id (null if it has no other), how many shingles it has, their SimHash, their parities, and the first of them.

    Shingles are ordered rare to common, then by hash; of two texts of that ``similarity`` the ``first`` ones share at least one.
    """
    texts = docs.select("doc_id", "text", _digest("text").alias("digest"))
    shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(texts, words))

    def first(found: list[bytes | None]) -> tuple[list, ...]:
        known, count = shared.value
        sizes, prints, odd, chosen, seen = [], [], [], [], {}
        for t in found:
            if t not in seen:
                hashes = shingle_set(t, words)
                own = hashes.view(np.int64)
                often = np.zeros(len(own), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    often = np.where(known[at] == own, count[at], 0)
                seen[t] = len(own), set_fingerprint(own), parities(hashes), own[np.lexsort((own, often))][: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]
            for out, value in zip((sizes, prints, odd, chosen), seen[t], strict=True):
                out.append(value)
        return sizes, prints, odd, chosen

    rows = map_texts(texts, "text", ("doc_id", "digest"), "n long, fingerprint long, parity array<long>, first array<long>", first)
    alone = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "fingerprint", "parity", "first")))
    return cut_lineage(alone.withColumn("node", F.monotonically_increasing_id()))


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """(shingle, node, n, place, before) of the first shingles that several texts hold, written; ``before`` is the next smaller text that has it.

    Rows are dealt by ranges of (shingle, n, node), so that a common shingle is spread over tasks, and stream by; at the border of a
    task a row may come without need, or without ``before``.
    """
    rows = nodes.select("node", "n", F.posexplode("first").alias("place", "shingle")).select("shingle", "n", "node", "place")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        start = True
        for batch in batches:
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if len(whole) > 1:
                yield from linked(whole, start, False)
                start, held = False, whole.slice(max(len(whole) - 2, 0))
            else:
                held = whole
        if held is not None:
            yield from linked(held, start, True)

    def linked(rows: pa.RecordBatch, start: bool, end: bool) -> Iterator[pa.RecordBatch]:
        """The rows whose shingle stands next to them too, but for the last one, which waits for the next batch, and, behind the start, the first one, which was there before."""
        shingle, node = rows.column("shingle").to_numpy(), rows.column("node").to_numpy()
        same = shingle[1:] == shingle[:-1]
        back, ahead = np.concatenate([[start], same]), np.concatenate([same, [end]])
        at = np.flatnonzero(back | ahead)
        at = at[(at >= (0 if start else 1)) & (at < len(shingle) - (0 if end else 1))]
        none = ~back[at] | (at == 0)
        before = pa.array(node[np.maximum(at - 1, 0)], mask=none)
        yield pa.RecordBatch.from_arrays([*rows.take(pa.array(at, pa.int64())).columns, before], ["shingle", "n", "node", "place", "before"])

    order = ["shingle", "n", "node"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(laid.mapInArrow(chained, "shingle long, n long, node long, place int, before long"))


def shingle_sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the texts ``asked`` for (node, digest, doc_id), written; each text is read once."""
    wanted = asked.select("node", _row_key(F.col("digest"), F.col("doc_id")).alias("key"))
    rows = docs.select("text", _row_key(_digest("text"), F.col("doc_id")).alias("key")).join(wanted, "key").dropDuplicates(["key"])
    return cut_lineage(map_texts(rows, "text", ("node",), "shingles array<long>", lambda found: ([shingle_set(t, words).view(np.int64) for t in found],)))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of ``similarity`` or more, written. Only texts of some pair are read again, each once."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "digest", "doc_id")
    sets = shingle_sets(docs, asked, words)
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    found = pairs.join(left, "a").join(right, "b").where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")
    found = cut_lineage(found)
    drop_written(sets)
    return found


def _fits(similarity: float) -> Column:
    return F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9


def chain_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b), written: for each node the smaller neighbour ``before`` it that it shares most of its first shingles with, if they are CHAIN_SHARE of them; at most one pair a node."""
    met = rows.where("before is not null").groupBy("node", "before").agg(F.count("*").alias("common"), F.first("n").alias("n"))
    near = met.where(F.col("common") >= CHAIN_SHARE * (F.col("n") - F.ceil(similarity * F.col("n")) + 1))
    best = near.groupBy("node").agg(F.max_by("before", F.struct("common", "before")).alias("before"))
    return cut_lineage(best.select(F.col("node").alias("a"), F.col("before").alias("b")))


def simhash_pairs(nodes: DataFrame, max_bits: int = STAR_BITS) -> DataFrame:
    """(a, b), written: each node and the smallest one of its group of SimHashes, which links of at most ``max_bits`` bits join through the ring; at most one pair a node."""
    prints = cut_lineage(nodes.where("n > 0").groupBy("fingerprint").agg(F.min("node").alias("first_node")))
    groups = connected_components(fingerprint_links(prints.select("fingerprint"), max_bits))
    rooted = prints.join(groups, prints["fingerprint"] == groups["node"], "left").select("fingerprint", "first_node", F.coalesce("root", "fingerprint").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("first_node").alias("b"))
    own = rooted.join(heads, "root").select("fingerprint", "b")
    made = cut_lineage(nodes.join(own, "fingerprint").where("node <> b").select(F.col("node").alias("a"), "b"))
    drop_written(prints)
    return made


def open_rows(rows: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(shingle, node, n, place, root, parity), written: those of ``rows`` whose shingle stands in several ``groups`` (node, root)."""
    rooted = cut_lineage(rows.join(groups, "node").select("shingle", "node", "n", "place", "root"))
    apart = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    asked = cut_lineage(rooted.join(apart, "shingle").join(nodes.select("node", "parity"), "node"))
    drop_written(rooted)
    return asked


def sweep_pairs(asked: DataFrame, nodes: DataFrame, tested: DataFrame, similarity: float, nth: int) -> DataFrame:
    """(a, b), written: for every two groups that are neighbours the best pair, at most one a node, of those not ``tested``.

    The rows of a shingle are laid out by size and by the least hash of the text's first shingles, which differs from round to
    round, and each is paired with the row before it, if that is of another group and can be similar by size and parities.
    """
    marks = nodes.select("node", F.array_min(F.transform("first", lambda x: F.xxhash64(x, F.lit(nth)))).alias("mark"))
    step = F.floor(F.log("n") / float(np.log(1 / similarity)) + nth / 2).alias("step")
    order = ["shingle", "step", "mark", "node"]
    laid = asked.join(marks, "node").select("shingle", step, "mark", "node", "n", "root", "parity").repartitionByRange(*order).sortWithinPartitions(*order)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            shingle, node, n, root = (rows.column(c).to_numpy() for c in ("shingle", "node", "n", "root"))
            at = 1 + np.flatnonzero((shingle[1:] == shingle[:-1]) & (root[1:] != root[:-1]))
            odd = rows.column("parity").flatten().to_numpy().reshape(-1, PARITY_WORDS)
            apart = np.bitwise_count((odd[at] ^ odd[at - 1]).view(np.uint64)).sum(axis=1)
            at = at[(apart <= (1 - similarity) / (1 + similarity) * (n[at] + n[at - 1]) + 1e-6) & (np.minimum(n[at], n[at - 1]) >= similarity * np.maximum(n[at], n[at - 1]) - 1e-9)]
            ends = node[at], node[at - 1], root[at], root[at - 1]
            yield pa.RecordBatch.from_arrays([pa.array(f(*ends[i : i + 2])) for i in (0, 2) for f in (np.maximum, np.minimum)], ["a", "b", "high", "low"])
            held = rows.slice(len(rows) - 1) if len(rows) else None

    met = laid.mapInArrow(neighbours, "a long, b long, high long, low long").groupBy("a", "b", "low", "high").agg(F.count("*").alias("common"))
    best = met.join(tested, ["a", "b"], "left_anti").groupBy("low", "high").agg(F.max(F.struct("common", "a", "b")).alias("p"))
    return cut_lineage(best.groupBy("p.a").agg(F.max(F.struct("p.common", "p.b")).alias("p")).select("a", "p.b"))


def missed_pairs(asked: DataFrame, tested: DataFrame, similarity: float) -> DataFrame:
    """(a, b, common), written: nodes of different groups that can still be as similar: all that share a first shingle in ``asked``, fit in size and parities, have room for the overlap and aren't ``tested``."""
    left, right = (asked.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "place", "root", "parity"))) for side in "ab")
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) - 1
    needed = similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6
    most = F.least("place_a", "place_b") + 1 + room  # as shingles have one order, no more can be common before this one
    differ = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    near = differ <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6
    first = left.join(right, "shingle").where(_fits(similarity) & (F.col("root_a") != F.col("root_b")) & (F.col("node_a") > F.col("node_b")) & (most >= needed) & near)
    met = first.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
        F.count("*").alias("common"), F.min(room).alias("room"), F.min(needed).alias("needed")
    )
    found = met.where(F.col("common") + F.col("room") >= F.col("needed")).select("a", "b", "common")
    return cut_lineage(found.join(tested, ["a", "b"], "left_anti"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``pairs`` (a, b, common) whose nodes are in different ``groups``, with the groups as low and high, written."""
    for side in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side)
    return cut_lineage(pairs.where("root_a <> root_b").select("a", "b", "common", F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high")))


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, root) of all nodes, grown together over ``links`` (a, b), written. Only the linked groups are walked."""
    joined = _apart(links.select("a", "b", F.lit(0).alias("common")), groups)
    grown = connected_components(joined, "low", "high").select(F.col("node").alias("root"), F.col("root").alias("to"))
    made = cut_lineage(groups.join(grown, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    drop_written(joined, groups, links)
    return made


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(digest, doc_id, root) of the distinct texts of ``docs`` (doc_id, text): the digest of the text, its smallest doc_id and its group.

    Texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more
    are joined, all of them and only on the shingles themselves. At such a distance (about a seventh of the bits) the ring's keys would be a few
    bits long, so SimHash finds the close ones: texts whose fingerprints the ring links are compared with the first text of their
    group of fingerprints. The others come from prefix filtering: similar texts share one of their rarest shingles. Each text is
    compared with one neighbour by it, too, which joins copies with few changes however many they are, and in some sweeps with a neighbour
    of another group, so that a crowd of near copies is one group but for a few texts. All pairs that share such a shingle and are
    not yet in one group follow, if size, parities and place leave room for the overlap: the best one of every two groups first, and once groups
    have grown together those that are still apart.
    """
    nodes = distinct_texts(docs, words, similarity)
    rows = shared_shingles(nodes)
    chain, stars = chain_pairs(rows, similarity), simhash_pairs(nodes)
    tested = cut_lineage(chain.unionAll(stars).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    drop_written(chain, stars)
    groups = _merged(cut_lineage(nodes.select("node", F.col("node").alias("root"))), verified(tested, docs, nodes, words, similarity))
    for nth in range(SWEEPS):
        asked = open_rows(rows, groups, nodes)
        chosen = sweep_pairs(asked, nodes, tested, similarity, nth)
        drop_written(asked)
        links = verified(chosen, docs, nodes, words, similarity)
        tested = tested.unionAll(chosen)
        if links.isEmpty():
            break
        groups = _merged(groups, links)
    asked = open_rows(rows, groups, nodes)
    pairs = missed_pairs(asked, tested, similarity)
    drop_written(rows, asked, tested)
    for nth in range(ROUNDS + 1):
        open_ = _apart(pairs, groups)
        drop_written(pairs)
        if open_.isEmpty():
            break
        if nth < ROUNDS:
            best = open_.groupBy("low", "high").agg(F.max(F.struct("common", "a", "b")).alias("p"))
            chosen = cut_lineage(best.select("p.a", "p.b"))
        else:
            chosen = open_.select("a", "b")
        groups = _merged(groups, verified(chosen, docs, nodes, words, similarity))
        pairs = cut_lineage(open_.select("a", "b", "common").join(chosen, ["a", "b"], "left_anti"))
        drop_written(open_)
    return nodes.join(groups, "node").select("digest", "doc_id", "root")


def _row_key(digest: Column, doc_id: Column) -> Column:
    return F.concat(digest, F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("-")))


def one_per_group(docs: DataFrame, words: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one of the smallest id (null last), then of the smallest digest.

    Null, empty and wordless texts are copies of each other. Of rows that agree in id and text any one stays. All columns
    are kept, also those named like the operator's own; an empty table gives no rows; a very long text is read in blocks.
    """
    rows, _ = set_aside(docs, [doc_id, text])
    rows = rows.withColumnsRenamed({doc_id: "doc_id", text: "text"})
    back = [F.col({doc_id: "doc_id", text: "text"}.get(c, n)).alias(c) for c, n in zip(docs.columns, rows.columns, strict=True)]
    groups = cut_lineage(similar_groups(rows.select("doc_id", "text"), words, similarity))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("digest")))
    keepers = groups.groupBy("root").agg(first.alias("k")).select(_row_key(F.col("k.digest"), F.col("k.id")).alias("_key"))
    kept = rows.withColumn("_key", _row_key(_digest("text"), F.col("doc_id"))).join(keepers, "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).select(*back)
