"""All pairs of texts whose sets of word shingles overlap enough, as components. Exact.

1. A text becomes the sorted array of its distinct shingle hashes; equal arrays are one node, so any number
   of exact copies costs what one does. The same pass keeps each set's bitmap, and counts hashes into a table
   of counters, of which each task reports those that stand out.
2. A set that overlaps another by the threshold shares one of its first n - ceil(t n) + 1 hashes with it,
   in any order that all sets agree on. The order puts hashes that the counters call frequent last, so
   boilerplate rarely leads anywhere. Sizes are cut into bands so wide that linked sets lie in one band or
   in neighbours; each set goes, by each such hash, to the tile of its band and of the band below. Of the
   nodes under one hash and band, the least is the leader: two nodes that share both meet its leader, so
   tiles (a leader and all that meet it) hold every linked pair. What meets under a frequent hash is dealt
   out in parts, whose leaders make way for the least of them.
3. Bitmaps of each tile's members are compared with the leader's, and what may link is intersected exactly.
4. Where the members of a tile still lie in several components, they are dealt into blocks by hash; pairs of
   blocks are compared by bitmaps, all against all that sizes allow across components, and the members that
   may link are intersected, but for what is connected by then.

A bitmap has a bit for each hash value modulo its width, set if an odd number of the set's hashes falls
there. The bits in which two differ are at most the hashes in which the sets differ, so their count bounds
the overlap from above. Wider bitmaps are folded to the width of narrower ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.llm.kernel import DARK, U, mix, slices, windows
from foliospark.llm.shared import WORD, Kept, Scratch, id_type, sealed, spread_join
from foliospark.ship import ship

#: Members of a tile compared with a leader in one part, and hashes (with 128 more for each set) in one block.
PART, BLOCK = 256, 1 << 18
#: Counters of hashes, whatever the corpus; and the most parts into which those that meet under one hash are dealt.
COUNTER_BITS, MOST_PARTS = 21, 1024


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text: k words in a row, or all words of a shorter text."""
    for s in slices(column):
        start, end, text = s.words(DARK)
        words = s.hashes(s.sums(), start, end)
        grams, at = windows(words, text, k)
        by_word, by_gram = s.bounds(text), s.bounds(text[at])
        for i in range(len(s)):
            n = by_word[i + 1] - by_word[i]
            if n >= k:
                sorted_ = np.sort(grams[by_gram[i] : by_gram[i + 1]])
                yield s.first + i, sorted_[np.concatenate(([True], sorted_[1:] != sorted_[:-1]))]
            elif n:
                whole = U(n)
                for w in words[by_word[i] : by_word[i + 1]]:
                    whole = mix(np.array([whole]) * U(0x9E3779B97F4A7C15) + w)[0]
                yield s.first + i, np.array([whole], U)
            else:
                yield s.first + i, np.zeros(0, U)


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _first_schema(docs: DataFrame) -> str:
    return f"doc_id {id_type(docs)}, version long, n long, node long, bits binary, counter int, count long"


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _first_pass(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total, seen, held, kind = None, 0, [], 0, None
        for batch in batches:
            n, node, maps, kind = [], [], [], batch.column("doc_id").type
            for _, hashes in shingle_sets(batch.column("text"), k):
                n.append(len(hashes))
                node.append(node_of(hashes) if len(hashes) else None)
                maps.append(parity_bitmap(hashes).tobytes() if len(hashes) else None)
                seen.append(hashes >> U(64 - COUNTER_BITS))
                held += len(hashes)
                if held > 1 << 20:
                    counts, total, seen, held = _added(counts, seen), total + held, [], 0
            empty = len(n)
            yield _batch(
                doc_id=batch.column("doc_id"), version=batch.column("version"), n=pa.array(n, pa.int64()), node=pa.array(node, pa.int64()),
                bits=pa.array(maps, pa.binary()), counter=pa.nulls(empty, pa.int32()), count=pa.nulls(empty, pa.int64()),
            )
        counts, total = _added(counts, seen), total + held
        if counts is not None:
            # At most a quarter of the counters, or half of the hashes.
            high = np.flatnonzero(counts >= max(2, 4 * total / len(counts)))
            none = pa.nulls(len(high), pa.int64())
            yield _batch(doc_id=pa.nulls(len(high), kind), version=none, n=none, node=none, bits=pa.nulls(len(high), pa.binary()), counter=pa.array(high.astype(np.int32)), count=pa.array(counts[high].astype(np.int64)))

    return run


def _added(counts: np.ndarray | None, seen: list[np.ndarray]) -> np.ndarray | None:
    if not seen:
        return counts
    new = np.bincount(np.concatenate(seen).astype(np.int64), minlength=1 << COUNTER_BITS)
    return new if counts is None else counts + new


def _frequency_classes(first: DataFrame) -> np.ndarray:
    """One byte a counter: 0 for the usual, more for each doubling over four times the mean."""
    total = first.agg(F.sum("n")).first()[0] or 0
    usual = max(16.0, 4.0 * total / (1 << COUNTER_BITS))
    high = first.where(F.col("counter").isNotNull()).groupBy("counter").agg(F.sum("count").alias("count")).where(F.col("count") > usual).toArrow()
    classes = np.zeros(1 << COUNTER_BITS, np.uint8)
    classes[high.column("counter").to_numpy()] = np.ceil(np.log2(high.column("count").to_numpy() / usual))
    return classes


def band_of(n: np.ndarray | int, percent: int) -> np.ndarray:
    """Bands a little wider than the ratio of the sizes of linked sets, so that those never skip one."""
    return np.floor(np.log(n) / (1.001 * np.log(100 / percent) + 1e-9)).astype(np.int64)


def _prefixes(k: int, percent: int, classes):
    """(token, part, node); part: 0, or for a frequent hash a number by node from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        klass, seen = classes.value, set()
        tokens, parts, nodes, n_rows = [], [], [], 0

        def out() -> pa.RecordBatch:
            return _batch(token=pa.array(np.concatenate(tokens).view(np.int64)), part=pa.array(np.concatenate(parts)), node=pa.array(np.concatenate(nodes)))

        for batch in batches:
            for _, hashes in shingle_sets(batch.column("text"), k):
                n = len(hashes)
                if not n or (node := node_of(hashes)) in seen:
                    continue
                if len(seen) < 200_000:  # copies within a task need not be sent twice
                    seen.add(node)
                most = n - -(-percent * n // 100) + 1
                rank = klass[hashes >> U(64 - COUNTER_BITS)]
                if rank.any():
                    first = np.lexsort((hashes, rank))[:most]
                    prefix, rank = hashes[first], rank[first].astype(np.int32)
                else:
                    prefix, rank = hashes[:most], np.zeros(most, np.int32)
                of = int(mix(np.array([node]).view(U))[0] & U(MOST_PARTS - 1))
                part = np.where(rank > 0, 1 + of % np.minimum(1 << np.minimum(rank, 20), MOST_PARTS), 0).astype(np.int32)
                band = int(band_of(n, percent))
                for tile in (band, band - 1):
                    tokens.append(prefix ^ mix(np.array([tile + 2], U)))
                    parts.append(part)
                    nodes.append(np.full(most, node, np.int64))
                n_rows += 2 * most
                if n_rows > 50_000:
                    yield out()
                    tokens, parts, nodes, n_rows = [], [], [], 0
        if tokens:
            yield out()

    return run


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leader, node, token, part) of rows sorted by (token, part, node): the first node leads. token: null where part is 0; leaders of parts lead themselves too."""
    last = (None, None)
    last_leader = 0
    for batch in batches:
        token, part, node = (batch.column(c).to_numpy() for c in ("token", "part", "node"))
        if not len(token):
            continue
        new = np.concatenate(([(token[0], part[0]) != last], (token[1:] != token[:-1]) | (part[1:] != part[:-1])))
        at = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
        leader = np.where(at >= 0, node[np.maximum(at, 0)], last_leader)
        last, last_leader = (token[-1], part[-1]), leader[-1]
        rows = np.flatnonzero((leader != node) | (part > 0))
        if len(rows):
            plain = part[rows] == 0
            yield _batch(leader=pa.array(leader[rows]), node=pa.array(node[rows]), token=pa.array(token[rows], mask=plain), part=pa.array(part[rows], mask=plain))


def _tiles(led: DataFrame) -> DataFrame:
    """(leader, node), once each, of what _leaders gives; the parts of a token get the least of their leaders."""
    dealt = led.where(F.col("token").isNotNull())
    heads = dealt.groupBy("token", "part").agg(F.min("leader").alias("head"))
    tops = heads.join(heads.groupBy("token").agg(F.min("head").alias("top")), "token").select("token", "part", "top")
    under = dealt.join(tops, ["token", "part"]).select(F.col("top").alias("leader"), "node").where(F.col("leader") != F.col("node"))
    return led.where(F.col("token").isNull()).select("leader", "node").unionByName(under).distinct()


def _arrays(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, data, held = [], [], 0
            for _, hashes in shingle_sets(batch.column("text"), k):
                if len(hashes):
                    node.append(node_of(hashes)), data.append(hashes.tobytes())
                    held += len(data[-1])
                if held > 1 << 23:
                    yield _batch(node=pa.array(node, pa.int64()), hashes=pa.array(data, pa.binary()))
                    node, data, held = [], [], 0
            if node:
                yield _batch(node=pa.array(node, pa.int64()), hashes=pa.array(data, pa.binary()))

    return run


def parity_bitmap(hashes: np.ndarray) -> np.ndarray:
    """Twice as many bits as hashes, or up to twice that, as 64-bit words: whether an odd number falls on each."""
    width = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & U(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").view(U)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted arrays share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Tile:
    """Sizes and bitmaps side by side."""

    def __init__(self, n: np.ndarray, bitmaps: list[np.ndarray], percent: int):
        self.n, self.percent = n, percent
        words = min(map(len, bitmaps))
        self.bitmaps = np.stack([folded(x, words) for x in bitmaps])

    def may_link(self, i: int, among: np.ndarray) -> np.ndarray:
        """Those of among that sizes and bitmaps allow to link with i."""
        least, most = np.minimum(self.n[among], self.n[i]), np.maximum(self.n[among], self.n[i])
        among = among[least * 100 >= most * self.percent]
        both = self.n[among] + self.n[i]
        differ = np.bitwise_count(self.bitmaps[among] ^ self.bitmaps[i]).sum(axis=1, dtype=np.int64)
        return among[(both - differ) // 2 * (100 + self.percent) >= self.percent * both]


def link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return overlap(a, b) * (100 + percent) >= percent * (len(a) + len(b))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys that follow each other, put together across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(v[a] for v in values)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _arrays_of(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U) for x in table.column(column)]


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return _batch(a=pa.array([a for a, _ in pairs], pa.int64()), b=pa.array([b for _, b in pairs], pa.int64()))


def _led(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    node, leader = table.column("node").to_numpy(), table.column("leader")[0].as_py()
    return leader, node, np.flatnonzero(node == leader), np.flatnonzero(node != leader)


def _may_link_leader(percent: int):
    """(leader, node) that bitmaps allow, of rows (leader, salt, node, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for table in runs(batches, ["leader", "salt"]):
            leader, node, lead, rest = _led(table)
            if len(lead) and len(rest):
                tile = Tile(table.column("n").to_numpy(), _arrays_of(table, "bits"), percent)
                found += [(leader, int(node[j])) for j in tile.may_link(int(lead[0]), rest)]
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    return run


def _link_leader(percent: int):
    """(leader, node) that link, of rows (leader, salt, node, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["leader", "salt"]):
            leader, node, lead, rest = _led(table)
            sets = _arrays_of(table, "hashes")
            if len(lead) and (found := [(leader, int(node[j])) for j in rest if link(sets[lead[0]], sets[j], percent)]):
                yield _pairs(found)

    return run


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Nodes, components, the rows to compare from, and which rows to compare with (None: those that follow)."""
    node, root = table.column("node").to_numpy(), table.column("label").to_numpy().copy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    if i == j:
        return node, root, np.arange(len(node)), None
    second = table.column("block").to_numpy() == j
    return node, root, np.flatnonzero(~second), np.flatnonzero(second)


def _may_link_members(percent: int):
    """(leader, i, j, node): members of a pair of blocks that bitmaps allow to link across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["leader", "i", "j"]):
            node, root, these, those = _sides(table)
            if (root == root[0]).all():
                continue
            tile, may = Tile(table.column("n").to_numpy(), _arrays_of(table, "bits"), percent), np.zeros(len(node), bool)
            for a in these:
                others = those if those is not None else np.arange(a + 1, len(node))
                if len(hit := tile.may_link(int(a), others[root[others] != root[a]])):
                    may[a] = may[hit] = True
            if may.any():
                yield table.filter(pa.array(may)).select(["leader", "i", "j", "node"]).combine_chunks().to_batches()[0]

    return run


def _link_members(percent: int):
    """Links across components, of rows (leader, i, j, block, node, label, hashes), but for what they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["leader", "i", "j"]):
            node, root, these, those = _sides(table)
            if (root == root[0]).all():
                continue
            sets, found = _arrays_of(table, "hashes"), []
            tile = Tile(np.array([len(x) for x in sets]), [parity_bitmap(x) for x in sets], percent)
            for a in these:
                others = those if those is not None else np.arange(a + 1, len(node))
                for b in tile.may_link(int(a), others[root[others] != root[a]]):
                    if root[b] != root[a] and link(sets[a], sets[b], percent):
                        found.append((int(node[a]), int(node[b])))
                        root[root == root[b]] = root[a]
            if found:
                yield _pairs(found)

    return run


def _fetch(docs: DataFrame, sets: DataFrame, nodes: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(node, hashes) of the nodes (node), each from one of its texts."""
    chosen = sets.join(nodes.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("doc_id", "version")).alias("of"))
    chosen = scratch.keep(chosen.select(F.col("of.doc_id").alias("chosen"), F.col("of.version").alias("its_version")).distinct(), "chosen")
    texts = docs.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("chosen")) & (F.col("version") == F.col("its_version")), "left_semi")
    return scratch.keep(texts.select("text").mapInArrow(_arrays(k), "node long, hashes binary").dropDuplicates(["node"]), "arrays")


def _dealt(tiles: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """Tiles (leader, node) with what held has of each node, in parts of about PART members, the leader in each."""
    parts = scratch.keep(tiles.groupBy("leader").agg(F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / PART).cast("int")), "parts")
    members = spread_join(tiles, parts.drop("rows"), "leader", parts.select("leader", "rows"), "node")
    members = members.select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"), "node")
    leaders = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("leader").alias("node"))
    return members.unionByName(leaders).join(held, "node").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "node")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, result: Scratch | None = None) -> DataFrame:
    """(doc_id, version, n_shingles, component_id, component) of each row of docs (doc_id, text).

    Two texts link when 100 * intersection >= percent * union of their sets of k-word shingles.
    component_id: the least doc_id reachable by links, the own one included; component: an equal number for
    linked rows (null without shingles); version: xxhash64 of the text.
    Defined results: a null, empty or blank text has 0 shingles and stands alone; a null doc_id links like
    any other but never names a component (null where a component has no id); rows that repeat stay.
    What is returned reads tables kept in ``result``.
    """
    ship(docs.sparkSession)
    result, scratch = result or Scratch(), Scratch()
    docs, _ = sealed(docs, ("doc_id", "text"))
    docs = docs.select("doc_id", "text").withColumn("version", F.xxhash64("text"))
    first = result.keep(docs.mapInArrow(_first_pass(k), _first_schema(docs)), "sets")
    sets = first.where(F.col("counter").isNull()).select("doc_id", "version", F.col("n").alias("n_shingles"), "node")
    bitmaps = scratch.keep(first.where(F.col("node").isNotNull()).select("node", "n", "bits").dropDuplicates(["node"]), "bitmaps")
    classes = docs.sparkSession.sparkContext.broadcast(_frequency_classes(first))

    prefixes = docs.select("text").mapInArrow(_prefixes(k, percent, classes), "token long, part int, node long")
    led = prefixes.repartition("token", "part").sortWithinPartitions("token", "part", "node").mapInArrow(_leaders, "leader long, node long, token long, part int")
    led = scratch.keep(led, "led")
    tiles = scratch.keep(_tiles(led), "tiles")

    may = scratch.keep(_dealt(tiles, bitmaps, scratch).mapInArrow(_may_link_leader(percent), "a long, b long").toDF("leader", "node"), "may-link")
    arrays = _fetch(docs, sets, may.select("node").unionByName(may.select(F.col("leader").alias("node"))), k, scratch)
    direct = scratch.keep(_dealt(may, arrays, scratch).mapInArrow(_link_leader(percent), "a long, b long"), "direct")
    labels = scratch.keep(components(direct, scratch), "labels")

    # What is not settled: tiles whose members lie in several components.
    placed = tiles.join(labels, "node", "left").join(bitmaps.select("node", "n"), "node").select("leader", "node", "n", F.coalesce("label", "node").alias("label"))
    placed = scratch.keep(placed, "placed")
    weight = F.sum(F.col("n") + 128)
    torn = placed.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(weight / BLOCK).cast("int").alias("blocks"), F.count("*").alias("rows")).where("lo < hi")
    torn = scratch.keep(torn.select("leader", "blocks", "rows"), "torn")
    cut = spread_join(placed, torn.drop("rows"), "leader", torn.select("leader", "rows"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = cut.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = scratch.keep(cut.select("leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "label"), "sides")
    by_block = ["leader", "i", "j"]
    mapped = sides.join(bitmaps.select("node", "bits"), "node").repartition(*by_block).sortWithinPartitions(*by_block, "n", "node")
    near = scratch.keep(mapped.select(*by_block, "block", "node", "n", "label", "bits").mapInArrow(_may_link_members(percent), "leader long, i int, j int, node long"), "near")
    if not near.isEmpty():
        filled = sides.join(near, [*by_block, "node"], "left_semi").join(_fetch(docs, sets, near, k, scratch), "node")
        filled = filled.repartition(*by_block).sortWithinPartitions(*by_block, "n", "node")
        rest = scratch.keep(filled.select(*by_block, "block", "node", "label", "hashes").mapInArrow(_link_members(percent), "a long, b long"), "rest")
        labels = scratch.keep(components(direct.unionByName(rest), scratch), "labels")

    least = sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc")).join(labels, "node", "left")
    least = scratch.keep(least.select("node", "doc", F.coalesce("label", "node").alias("component")), "least")
    names = scratch.keep(least.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("rows")), "names")
    named = spread_join(least, names.drop("rows"), "component", names.select("component", "rows"), "node")
    named = result.keep(named.select("node", "component_id", "component"), "named")
    # Exact copies may be a large share of all rows.
    copies = result.keep(sets.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1"), "copies")
    scratch.clear()
    alone = sets.where(F.col("node").isNull()).select("doc_id", "version", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    found = spread_join(sets.where(F.col("node").isNotNull()), named, "node", copies, "version", "doc_id")
    return found.select("doc_id", "version", "n_shingles", "component_id", "component").unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the least doc_id, or the least text by hash where none has an id.

    Rows equal in doc_id and text are one document, and stay or go together; of equal texts without an id one
    row stays, if any; texts without words all stay.
    """
    scratch = Scratch()
    docs, back = sealed(docs, ("doc_id", "text"))
    found = jaccard_components(docs, k, percent, scratch).where(F.col("component").isNotNull()).select("component", "doc_id", "version")
    found = scratch.keep(found.distinct(), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "version")
    stay = scratch.keep(found.groupBy("component").agg(F.min(rank).alias("stay"), F.count("*").alias("rows")), "stay")
    grouped = spread_join(found, stay.drop("rows"), "component", stay.select("component", "rows"), "doc_id", "version")
    gone = grouped.where(~(F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("version") == F.col("stay.version"))))
    gone = Kept(gone.select(F.col("doc_id").alias("leaving"), "version"), "gone").frame
    scratch.clear()
    same = F.col("doc_id").eqNullSafe(F.col("leaving")) & (F.xxhash64("text") == F.col("version"))
    bare = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    left = docs.where(~bare).unionByName(docs.where(bare).dropDuplicates(["text"]))
    return left.join(gone.hint("merge"), same, "left_anti").select(*back.values())
