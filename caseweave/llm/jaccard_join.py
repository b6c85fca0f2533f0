"""N-gram Jaccard join by T-occurrence search.

Two documents are linked when their sets of word k-grams have a Jaccard similarity of at
least ``num / den``. With T = ceil(similarity x size), partners of a document share at
least T of its grams. As in DivideSkip, the lists of a document are divided: all but T - l of
its grams, the first in a global order, make up its short lists, and partners meet at least
``l`` times there; the other lists are long and are only probed.

1. Documents with the same set become one (two 64-bit halves of a digest name a set), so
   a text copied a million times is one row from here on.
2. Short lists, over the whole corpus: one row per (gram, set). Their sizes are counted, and each
   set keeps the rarest grams of its short lists, so many that partners still share some of them: a
   passage that thousands of texts have in common makes none of them candidates. In a list of up
   to ``SHORT`` sets (a constant) those of like size meet and are counted; half of the meetings that
   are due make them candidates. In a longer list no pairs are made: sets with so many grams in such
   lists that they can have met too rarely in the others are tied to the first of their size
   there. Every linked pair is found by one of the two ways.
3. Connected candidates form blocks. A block above ``TILE`` documents is searched in two rounds,
   both in tiles: all against the first tile, then those that did not join the largest group
   against all. So near copies of one text cost a multiple of their number, not its square.
4. In a tile the search itself: an inverted index, a heap merge of the short lists, binary
   probes of the long ones, and a verdict by the exact overlap. Documents that are connected
   already are not compared again, so a tile reports at most as many links as it has documents.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a text with fewer than k words has
its whole sequence as its one gram. Null, empty and blank texts have an empty set and link
with nothing. A null id links with nothing and gets a null component. Rows that repeat an id
are one document with several texts: what any of them links with belongs to its component.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseweave.llm.common import cut, id_and_text, texts_of
from caseweave.llm.components import components
from caseweave.session import freeze

#: Meetings that partners are sure to have in their short lists (fewer in small sets), and the share
#: of a large set that they are: a long text holds many common grams, which must not be enough.
MEETINGS, MEETING_SHARE = 40, 20
#: One meeting among the rarest grams is asked for per so many grams of a set, one at least.
RARE_SHARE = 100
#: Lists of up to so many documents are counted pair by pair.
SHORT = 16
#: Block members up to this number (about 40 bytes each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_MEMBERS = 1_000_000
#: Documents and grams of a tile.
TILE, TILE_GRAMS = 200, 600_000

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str, k: int) -> np.ndarray:
    """The set of word k-grams as sorted distinct 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\x20".join(words), seed=k)], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        part = hashed[i : len(words) - k + 1 + i]
        total = (total + part) * _MIX
        total ^= total >> np.uint64(32)
    total *= _STEP
    total ^= total >> np.uint64(29)
    return np.unique(total)


def least_overlap(size: int, num: int, den: int) -> int:
    """T: a partner shares at least so many grams with a set of this size."""
    return -(-num * size // den)


def sure_meetings(size: int, num: int, den: int, meetings: int = MEETINGS) -> int:
    return min(max(meetings, size // MEETING_SHARE), least_overlap(size, num, den))


def pair_overlap(a: int, b: int, num: int, den: int) -> int:
    """The overlap at which sets of these sizes are linked: den x common >= num x union."""
    return -(-num * (a + b) // (num + den))


def sets(docs: DataFrame, k: int, num: int, den: int, meetings: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (name of the set), short (grams of its short lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, short = [], [], [], []
            for text in texts_of(batch):
                g = grams(text, k)
                name = np.frombuffer(hashlib.blake2b(g.tobytes(), digest_size=16).digest(), "<i8")
                t = least_overlap(len(g), num, den)
                n.append(len(g))
                k1.append(int(name[0]))
                k2.append(int(name[1]))
                # Sorted by hash: a global order that spreads frequent grams evenly.
                short.append(g[: len(g) - t + sure_meetings(len(g), num, den, meetings)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(short, pa.list_(pa.int64()))],
                ["doc_id", "n", "k1", "k2", "short"],
            )

    schema = "doc_id long, n long, k1 long, k2 long, short array<long>"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def candidate_edges(named: DataFrame, num: int, den: int, meetings: int = MEETINGS) -> DataFrame:
    """(a, b) from (name, n, short): edges between names of sets whose components hold all linked pairs.

    Sets that are too unlike in size are never partners and get no edge for it.
    """
    least = lambda n: F.ceil(F.lit(num) * n / F.lit(den)).cast("long")
    sure = lambda n: F.least(F.greatest(F.lit(meetings), F.floor(n / MEETING_SHARE)), least(n)).cast("long")
    # Meetings that are sure with any partner, and how many of them must lie among the rarest grams. Both grow with n.
    low = lambda n: sure(least(n))
    rare = lambda n: F.greatest(F.lit(1), F.least(F.floor(n / RARE_SHARE), F.floor(low(n) / 2))).cast("int")
    n = F.col("n")
    # These rows are many, so they carry nothing that can be worked out again.
    lists = named.select("name", F.col("n").cast("int").alias("n"), F.explode("short").alias("gram"))
    often = lists.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1")
    # Two sets that share ``sure`` of the grams of their short lists share ``rare`` of those that are left when
    # each side keeps all but its ``sure - rare`` most frequent ones. Most grams stand in one set only.
    mine = Window.partitionBy("name")
    placed = lists.join(often, "gram").withColumn("place", F.row_number().over(mine.orderBy("size", "gram")))
    kept = placed.withColumn("many", F.count("*").over(mine)).filter(F.col("place") <= rare(n) - low(n) + F.col("many"))
    # Few rows out of many: both ways below start from here.
    kept = freeze(kept.select("name", "n", "gram", "size"), "rare")

    in_short = kept.filter(f"size <= {SHORT}").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("name", "n"))).alias("docs"))
    alike = lambda x, y: F.least(x["n"], y["n"]) * den >= F.greatest(x["n"], y["n"]) * num
    later = F.transform("docs", lambda x, i: F.transform(
        F.filter("docs", lambda y, j: (j > i) & alike(x, y)),
        lambda y: F.struct(x["name"].alias("a"), y["name"].alias("b"), F.least(x["n"], y["n"]).alias("n"))))
    met = in_short.select(F.inline(F.flatten(later))).groupBy("a", "b", "n").count()
    close = met.filter(F.col("count") >= F.ceil(rare(n) / 2)).select("a", "b")

    # Partners that met less often share more than half of them in longer lists. Of so many one is left
    # when each side drops one fewer of its most frequent ones: ties are made by the others only.
    own = kept.filter(f"size > {SHORT}").select(
        "name", "n", "gram", F.row_number().over(mine.orderBy("size", "gram")).alias("place"), F.count("*").over(mine).alias("many"))
    ties = own.filter(F.col("place") <= F.col("many") - F.floor(rare(least(n)) / 2))
    # Partners lie in one size class or in neighbouring ones.
    size_class = _size_class(F.col("n"), num, den)
    ties = ties.select("name", "gram", F.explode(F.array(size_class, size_class - 1)).alias("sizes"))
    heads = ties.groupBy("gram", "sizes").agg(F.min("name").alias("head"))
    tied = ties.join(heads, ["gram", "sizes"]).filter("name <> head").select(F.col("name").alias("a"), F.col("head").alias("b"))
    return close.union(tied).distinct()


def _size_class(n, num: int, den: int):
    """Sizes of partners differ by a factor of at most ``den / num``, which is the width of a class."""
    return F.floor(F.log(n) / F.log(F.lit(den / num)) + 1e-9).cast("long")


class Tile:
    """Inverted index of a few documents and the search of others in it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.lists: dict[int, list[int]] = {}

    def add(self, doc: int, items: list[int]) -> None:
        place = len(self.ids)
        self.ids.append(doc)
        self.sizes.append(len(items))
        for g in items:
            self.lists.setdefault(g, []).append(place)

    def search(self, items: list[int], wanted) -> Iterator[int]:
        """Ids of documents that reach the required overlap; ``wanted`` says which are worth probing."""
        size = len(items)
        least = least_overlap(size, self.num, self.den)
        found = sorted((self.lists[g] for g in items if g in self.lists), key=len)
        if len(found) < least:
            return
        n_long = least - 1
        short, long = found[: len(found) - n_long], found[len(found) - n_long :]
        run, count = -1, 0
        for place in [*heapq.merge(*short), -2]:
            if place == run:
                count += 1
                continue
            if run >= 0 and wanted(self.ids[run]):
                need = pair_overlap(size, self.sizes[run], self.num, self.den)
                if self._probe(run, count, long, need):
                    yield self.ids[run]
            run, count = place, 1

    def _probe(self, place: int, count: int, long: list[list[int]], need: int) -> bool:
        left = len(long)
        for entries in long:
            if count >= need:
                return True
            if count + left < need:
                return False
            at = bisect_left(entries, place)
            count += at < len(entries) and entries[at] == place
            left -= 1
        return count >= need


class Groups:
    """Union-find over the documents of a tile."""

    def __init__(self, known: dict[int, int] | None = None):
        self.parent: dict[int, int] = {}
        self.known = known or {}

    def find(self, x: int) -> int:
        x = self.known.get(x, x)
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def tile_links(rows: list[tuple[int, str, bool, bool, int]], k: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what they can of a tile; rows: (doc, text, in the index, is a query, group so far)."""
    tile, groups, links = Tile(num, den), Groups({doc: group for doc, _, _, _, group in rows}), []
    waiting = []
    for doc, text, indexed, query, _ in rows:
        items = grams(text, k).tolist()
        if indexed and query:  # each against those before it
            links += _ask(tile, groups, doc, items)
        elif query:
            waiting.append((doc, items))
        if indexed:
            tile.add(doc, items)
    for doc, items in waiting:
        links += _ask(tile, groups, doc, items)
    return links


def _ask(tile: Tile, groups: Groups, doc: int, items: list[int]) -> list[tuple[int, int]]:
    apart = lambda other: groups.find(other) != groups.find(doc)
    return [(doc, other) for other in tile.search(items, apart) if groups.join(doc, other)]


def search_tiles(placed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links found in the tiles of ``placed`` (tile key columns x, y, z; rep, text, indexed, query, part)."""
    keys = ["x", "y", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "rep", "text", "indexed", "query", "part")]
            links = []
            for x, y, z, *row in zip(*columns):
                if (x, y, z) != at:
                    links += tile_links(held, k, num, den)
                    held, at = [], (x, y, z)
                row[1] = row[1] or ""
                held.append(tuple(row))
            if links:
                yield _links_batch(links)
        if held:
            yield _links_batch(tile_links(held, k, num, den))

    dealt = placed.repartition(*keys).sortWithinPartitions(*keys, "rep")
    return dealt.select(*keys, "rep", "text", "indexed", "query", "part").mapInArrow(run, "a long, b long")


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"]
    )


def _tiles(size, n_grams):
    return F.greatest(F.ceil(size / TILE), F.ceil(n_grams / TILE_GRAMS)).cast("long")


def block_links(docs: DataFrame, blocks: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links within blocks (rep, block, n): same components as all links have."""
    measured = blocks.groupBy("block").agg(_tiles(F.count("*"), F.sum("n")).alias("tiles"))
    members = blocks.join(measured, "block").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    members = cut(members)
    texts = id_and_text(docs, id_col, text_col)

    def with_text(placed: DataFrame) -> DataFrame:
        """Texts come last, so that they are shuffled once, to their tiles."""
        few = placed.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS
        return texts.join(F.broadcast(placed) if few else placed, texts["doc_id"] == placed["rep"]).drop("doc_id")

    zero = F.lit(0).cast("long")
    everyone = F.sequence(zero, F.col("tiles") - 1)
    role = lambda z, indexed, query: F.struct(z.alias("z"), F.lit(indexed).alias("indexed"), F.lit(query).alias("query"))
    roles = F.when(
        F.col("own") == 0, F.concat(F.array(role(zero, True, True)), F.transform(F.slice(everyone, 2, 1_000_000_000), lambda z: role(z, True, False)))
    ).otherwise(F.array(role(F.col("own"), False, True)))
    round1 = members.select(F.col("block").alias("x"), zero.alias("y"), "rep", F.col("rep").alias("part"), F.explode(roles).alias("r")).select(
        "x", "y", "r.z", "rep", "r.indexed", "r.query", "part"
    )
    links = cut(search_tiles(with_text(round1), k, num, den))
    many = members.filter("tiles > 1").select("rep", "block", "n")
    if many.isEmpty():
        return links
    parts = components(links)
    many = many.join(parts, many["rep"] == parts["id"], "left").select(
        "rep", "block", "n", F.coalesce("component", "rep").alias("part")
    )
    sizes = many.groupBy("block", "part").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("block").agg(F.max_by("part", F.struct("size", "part")).alias("main"))
    # What is outside meets everyone of its size: partners lie in one size class or in neighbouring ones.
    placed = many.join(largest, "block").withColumn("class", _size_class(F.col("n"), num, den))
    outside = placed.filter("part <> main")
    of_outside = outside.groupBy("block", "class").agg(_tiles(F.count("*"), F.sum("n")).alias("rest_tiles"))
    near = placed.withColumn("class", F.explode(F.array(*[F.col("class") + i for i in (-1, 0, 1)]))).join(of_outside, ["block", "class"])
    of_near = near.groupBy("block", "class").agg(_tiles(F.count("*"), F.sum("n")).alias("near_tiles"))
    tile = lambda number: F.col("class") * 1_000_000_000 + number
    indexed = near.join(of_near, ["block", "class"]).select(
        F.col("block").alias("x"), F.explode(F.sequence(zero, F.col("rest_tiles") - 1)).alias("y"), "class",
        F.pmod(F.xxhash64("rep"), F.col("near_tiles")).alias("z"), "rep", "part",
    ).select("x", tile(F.col("y")).alias("y"), "z", "rep", F.lit(True).alias("indexed"), F.lit(False).alias("query"), "part")
    queries = outside.join(of_outside, ["block", "class"]).join(of_near, ["block", "class"]).select(
        F.col("block").alias("x"), tile(F.pmod(F.xxhash64("rep", F.lit(7)), F.col("rest_tiles"))).alias("y"),
        F.explode(F.sequence(zero, F.col("near_tiles") - 1)).alias("z"), "rep", F.lit(False).alias("indexed"),
        F.lit(True).alias("query"), "part",
    )
    round2 = cut(indexed.union(queries))
    return links.union(search_tiles(with_text(round2), k, num, den))


def join(
    docs: DataFrame, *, k: int = 5, num: int = 4, den: int = 5, meetings: int = MEETINGS, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked at a Jaccard similarity of ``num / den`` or more."""
    # Written once: the names and sizes are read again and again, the short lists once more for each different set.
    cut_up = freeze(sets(docs, k, num, den, meetings, id_col, text_col), "sets")
    named = cut_up.select("doc_id", "n", "k1", "k2")
    alike = cut_up.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.first("short").alias("short")
    )
    # Half of a set's digest names it here: grams are hashes of the same width.
    edges = candidate_edges(alike.select(F.col("k1").alias("name"), "n", "short"), num, den, meetings)
    blocks = components(edges)
    reps = named.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    blocks = blocks.join(reps, blocks["id"] == reps["k1"]).select("rep", F.col("component").alias("block"), "n")
    links = block_links(docs, blocks, k, num, den, id_col, text_col)
    reps = reps.select("k1", "k2", "rep")
    placed = named.select("doc_id", "n", "k1", "k2").join(reps, ["k1", "k2"], "left")
    texts = placed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    several = texts.filter("a <> b").select("doc_id").join(placed.select("doc_id", "rep"), "doc_id")
    found = components(links.union(several.select("doc_id", "rep").filter("rep IS NOT NULL")))
    placed = placed.join(found, F.col("rep") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
