"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are compared in tiles with numpy exclusive-or and bit counts.  A tile holds
fingerprints with the same bit counts in each of their four 16-bit quarters.  A differing bit
changes one quarter's count by one, so two tiles whose counts differ by more than the radius, summed
over the quarters, cannot hold a link, and that pair of tiles is skipped.  All other pairs of
tiles are compared whole: the result is exact, with no cap on a class, a tile or a document's links.

* Equal fingerprints are grouped first, so copies cost nothing beyond one aggregation.
* A class of equal counts larger than ``TILE`` is split by hash into several tiles.
* A pair of tiles yields a spanning forest of its links, never the links themselves, so a group
  of n fingerprints gives fewer than n rows a pair of tiles.
* Components come from label propagation with pointer jumping over those forests.

The driver learns no fingerprint, link or component; the table of classes, at most 17**4 rows, is
the only thing broadcast.

Edge cases: a null text counts as empty; an empty text has fingerprint zero and links like any
other; null ids are kept, and are skipped when the smallest id of a component is looked for;
repeated rows share a component; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.llm.common import ByPlace, cut, key_of, pick, small_batches

#: Fingerprints in a tile, about.
TILE = 2048
#: Parts that the members of one component are dealt to where its root's row has to reach them.
SALTS = 32
#: Base of the digits that a class of bit counts is numbered by; counts go from 0 to 16.
BASE = 64


@dataclass(frozen=True)
class Rule:
    """Members link if their first ``lead`` words differ in at most first bits and, where there are more
    words, all words in at most radius bits while the smaller size is least_ratio of the larger; where the
    smaller size is under short, in at most short_radius bits."""

    first: int
    radius: int = 0
    least_ratio: float = 0.0
    lead: int = 1
    short: int = 0
    short_radius: int = 0

    def alike(self, differ: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Whether members of two sizes that differ in so many bits of all words link."""
        small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
        return (differ <= np.where(small < self.short, self.short_radius, self.radius)) & (small >= self.least_ratio * large)


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text: A-Z lower-cased, ASCII white space between words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, shingle_words: int = 3) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        out = np.fromiter((fingerprint(t, shingle_words) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(out.view(np.int64))

    return signed(text)


def _class_of(fp: Column) -> Column:
    """Number of the class: the bit counts of the four quarters as digits."""
    digits = [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))) + 16 for q in (3, 2, 1, 0)]
    number = F.lit(0)
    for d in digits:
        number = number * BASE + d
    return number.cast("int")


def neighbour_steps(radius: int) -> list[int]:
    """What to add to a class's number to get each class within the radius, one of each two opposite steps."""
    steps = (s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius)
    return sorted(n for s in steps if (n := int(np.dot(s, [BASE**3, BASE**2, BASE, 1]))) >= 0)


def tile_links(a: np.ndarray, b: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles, as (member, root) pairs of node numbers.

    A tile is an int64 matrix with a row (node, size, words of the fingerprint) for each member.
    Pass the same matrix twice for a tile against itself.
    """
    near = np.zeros((len(a), len(b)), dtype=bool)
    words_a, words_b = np.ascontiguousarray(a[:, 2:]).view(np.uint64), np.ascontiguousarray(b[:, 2:]).view(np.uint64)
    rows = max(1, 250_000 // max(1, len(b)))
    first_b = [np.ascontiguousarray(words_b[:, w]) for w in range(rule.lead)]
    for at in range(0, len(a), rows):
        differ = np.bitwise_count(words_a[at : at + rows, :1] ^ first_b[0][None, :])
        for w in range(1, rule.lead):
            differ += np.bitwise_count(words_a[at : at + rows, w : w + 1] ^ first_b[w][None, :])
        close = differ <= rule.first
        if words_a.shape[1] > 1:
            i, j = close.nonzero()
            close[:] = False
            differ = np.bitwise_count(words_a[at + i] ^ words_b[j]).sum(axis=1, dtype=np.int64)
            yes = rule.alike(differ, a[at + i, 1], b[j, 1])
            close[i[yes], j[yes]] = True
        near[at : at + rows] = close
    if a is b:
        np.fill_diagonal(near, False)
    hit_a, hit_b = near.any(axis=1).nonzero()[0], near.any(axis=0).nonzero()[0]
    if not len(hit_a):
        return []
    near = near[np.ix_(hit_a, hit_b)]
    ids_a, ids_b = a[hit_a, 0], b[hit_b, 0]
    label_a, label_b = ids_a.copy(), ids_b.copy()
    while True:
        new_a = np.minimum(label_a, _least(near, label_b))
        new_b = np.minimum(label_b, _least(near.T, new_a))
        if np.array_equal(new_a, label_a) and np.array_equal(new_b, label_b):
            break
        label_a, label_b = new_a, new_b
    members, roots = np.concatenate([ids_a, ids_b]), np.concatenate([label_a, label_b])
    keep = members != roots
    return np.unique(np.stack([members[keep], roots[keep]], axis=1), axis=0).tolist()


def _least(near: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each row of near, the smallest label at a true column."""
    out, rows = np.empty(len(near), dtype=np.int64), max(1, 250_000 // max(1, near.shape[1]))
    for at in range(0, len(near), rows):
        out[at : at + rows] = np.where(near[at : at + rows], labels[None, :], np.iinfo(np.int64).max).min(axis=1)
    return out


def forest(nodes: DataFrame, steps: list[int], rule: Rule, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect whatever nodes are near by the rule.

    nodes has k, the number of a member's class, and record, its row of a tile.  steps are the
    differences of class numbers that may hold links; all else is skipped.
    """
    classes = nodes.groupBy("k").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = cut(
        nodes.join(F.broadcast(classes), "k")
        .groupBy("k", F.pmod(F.xxhash64(F.col("record")[0]), F.col("parts")).cast("int").alias("part"))
        .agg(F.flatten(F.collect_list("record")).alias("tile"), F.max(F.size("record")).alias("width"))
    )
    sizes = tiles.groupBy("k").agg(F.max("part").alias("last"))
    pairs = (
        sizes.select(F.col("k").alias("k1"), F.col("last").alias("last1"), F.explode(F.array(*map(F.lit, steps))).alias("step"))
        .withColumn("k2", F.col("k1") + F.col("step"))
        .join(F.broadcast(sizes.select(F.col("k").alias("k2"), F.col("last").alias("last2"))), "k2")
        .select("k1", "k2", "last2", F.explode(F.sequence(F.lit(0), F.col("last1"))).alias("p1"))
        .select("k1", "p1", "k2", F.explode(F.sequence(F.lit(0), F.col("last2"))).alias("p2"))
        .filter("k1 <> k2 OR p1 <= p2")
    )
    left = tiles.select(F.col("k").alias("k1"), F.col("part").alias("p1"), F.col("tile").alias("left"), "width")
    right = tiles.select(F.col("k").alias("k2"), F.col("part").alias("p2"), F.col("tile").alias("right"))
    # tiles hold every fingerprint, whatever size Spark takes them for, so they never go through the driver
    met = pairs.join(left.hint("merge"), ["k1", "p1"]).join(right.hint("merge"), ["k2", "p2"])
    itself = (F.col("k1") == F.col("k2")) & (F.col("p1") == F.col("p2"))

    def compare(batches):
        for batch in batches:
            found = []
            for a, b, width, same in zip(batch["left"], batch["right"], batch["width"], batch["itself"]):
                a = np.asarray(a, dtype=np.int64).reshape(-1, width)
                found += tile_links(a, a if same else np.asarray(b, dtype=np.int64).reshape(-1, width), rule)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.select("left", "right", "width", itself.alias("itself")).mapInPandas(compare, "a long, b long")


def to_members(members: DataFrame, roots: DataFrame, node: str, how: str = "inner", few: bool = False) -> DataFrame:
    """members (node, root, ...) with what roots, one row for each root of several members, knows of theirs.

    A component may hold a large part of all nodes, so its members are dealt to SALTS parts and its root goes to each.
    Spark's size check sees the roots as they are before that, SALTS times too small, so unless roots are few they are not broadcast.
    """
    spread = roots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = spread if few else spread.hint("merge")
    return members.withColumn("salt", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int")).join(spread, ["root", "salt"], how).drop("salt")


def named(reps: DataFrame, rooted: DataFrame, node: str, least: Column) -> DataFrame:
    """(node, named): for every row of reps, known by node, the smallest of its component, or its own if rooted lacks it."""
    placed = cut(reps.select(node, least.alias("own")).join(rooted.withColumnRenamed("node", node), node, "left"))
    grouped = placed.filter("root IS NOT NULL")
    smallest = grouped.groupBy("root").agg(F.min("own").alias("named"))
    alone = placed.filter("root IS NULL").select(node, F.col("own").alias("named"))
    return alone.unionByName(to_members(grouped.drop("own"), smallest, node).select(node, "named"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of edges (a, b), for every node that has an edge.

    Each round takes the smallest label among a node's neighbours, then that label's own label.
    """
    with small_batches(edges.sparkSession, 64):
        ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = cut(edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())  # edges made twice may turn out the other way round
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    labels = cut(labels)
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        new = labels.withColumnRenamed("root", "old").join(heard, "node").select("node", "old", F.least("old", "heard").alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("above")).join(new.select("root").distinct(), "root", "left_semi")
        new = cut(to_members(new, above, "node").select("node", "old", F.least("root", "above").alias("root")))
        labels = new.select("node", "root")
        if new.filter("root <> old").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 2
) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    fingerprint is 16 lowercase hex digits; component_id the smallest id that is reachable over
    links of at most radius differing bits.
    """
    with small_batches(docs.sparkSession):
        own = cut(pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), shingle_words).alias("fp")))
    reps = cut(own.groupBy("fp").agg(F.min("id").alias("rep")))
    nodes = reps.select(_class_of(F.col("fp")).alias("k"), F.array("fp", F.lit(0).cast("long"), "fp").alias("record"))
    rooted = components(forest(nodes, neighbour_steps(radius), Rule(radius)))
    return own.join(named(reps, rooted, "fp", F.col("rep")), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("named").alias("component_id")
    )


#: Words of the long fingerprint that candidates for near copies are told by.
LONG_WORDS = 8
#: Bits of the first 128 and of 512 that may differ between candidates.  At a Jaccard similarity s of two
#: sets a bit differs with probability acos(2 s / (1 + s)) / pi at most, 0.152 at 0.8, if the sets are
#: large; ties make it more for small ones, 0.1875 for 4 shingles against 5, the worst case.  Counted
#: exactly for sets of 4 shingles and more, a pair at 0.8 is missed with a chance below 4e-7.
LONG_RULE = Rule(first=48, radius=128, least_ratio=0.75, lead=2, short=8, short_radius=150)
#: Sets of fewer shingles are alike by 0.8 only if they are equal.
LEAST_SIZE = 4
#: Shingles in a tile of sets, about.
SET_TILE = 1 << 18


def shingle_hashes(text: str | None, shingle_words: int = 5) -> np.ndarray:
    """The 64-bit hashes of the set of shingles, in no order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    shingles = {b" ".join(words)} if len(words) <= shingle_words else set(map(b" ".join, zip(*(words[i:] for i in range(shingle_words)))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64)


def long_fingerprint(text: str | None, shingle_words: int = 5) -> tuple[int, int, list[int]]:
    """(hash of the set of shingles, its size, LONG_WORDS words of fingerprint), all as signed longs."""
    hashes = shingle_hashes(text, shingle_words)
    ones = np.zeros((LONG_WORDS, 64), dtype=np.int64)
    for at in range(0, len(hashes), 16384):
        for w in range(LONG_WORDS):
            x = hashes[at : at + 16384] + np.uint64((w * 0x9E3779B97F4A7C15) % 2**64)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            ones[w] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), axis=1).view(np.int64).reshape(-1)
    whole = int(np.bitwise_xor.reduce(hashes * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(len(hashes)))
    return whole - 2**64 if whole >= 2**63 else whole, len(hashes), bits.tolist()


def settled(a: list[np.ndarray], b: list[np.ndarray], rule: Rule = LONG_RULE) -> list[tuple[int, int]]:
    """Links between two tiles of sets that are alike by 0.8 or more, enough of them to connect all that are.

    A member is an int64 array: node, LONG_WORDS words of the fingerprint, sorted shingle hashes.  Candidates
    by the rule are settled by the shingles they share, unless links found before connect them already.
    Pass the same list twice for a tile against itself.
    """
    at = 1 + LONG_WORDS
    words_a, words_b = (np.array([m[1:at] for m in t], dtype=np.int64).reshape(-1, LONG_WORDS) for t in (a, b))
    sets_a, sets_b = [m[at:] for m in a], [m[at:] for m in b]
    sizes_b = np.array([len(x) for x in sets_b], dtype=np.int64)
    label_a = np.arange(len(a))
    label_b = label_a if a is b else np.arange(len(a), len(a) + len(b))
    found = []
    for i, own in enumerate(sets_a):
        near = rule.alike(np.bitwise_count((words_a[i] ^ words_b).view(np.uint64)).sum(axis=1, dtype=np.int64), np.int64(len(own)), sizes_b)
        near &= label_b != label_a[i]
        if a is b:
            near[: i + 1] = False
        js = near.nonzero()[0]
        if not len(js):
            continue
        theirs = np.concatenate([sets_b[j] for j in js])
        places = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        shared = np.add.reduceat((own[places] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(sizes_b[js])[:-1]]))
        for j in js[9 * shared >= 4 * (len(own) + sizes_b[js])]:  # shared / (both - shared) >= 4 / 5
            if label_b[j] != label_a[i]:
                old, new = label_b[j], label_a[i]
                label_a[label_a == old] = new
                label_b[label_b == old] = new
                if a[i][0] != b[j][0]:
                    found.append((int(a[i][0]), int(b[j][0])))
    return found


def settle(members: DataFrame, tile: int = SET_TILE) -> DataFrame:
    """(a, b): links that connect whatever members of a group are alike by 0.8 or more.

    members has root, a group of candidates, node, and record, as settled() takes it.  A group is
    dealt to tiles of about tile shingles, which are compared two by two.
    """
    large_groups = members.groupBy("root").agg(F.ceil(F.sum(F.size("record")) / tile).cast("int").alias("parts")).filter("parts > 1")
    dealt = to_members(members, large_groups, "node", "left", few=True).withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    tiles = dealt.groupBy("root", "part").agg(F.first("parts").alias("parts"), F.collect_list("record").alias("tile"))
    large = cut(tiles.filter("parts > 1"))
    left = large.select("root", F.col("part").alias("p1"), F.col("tile").alias("left"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("p2"))
    right = large.select("root", F.col("part").alias("p2"), F.col("tile").alias("right"))
    met = left.join(right, ["root", "p2"]).select("left", F.when(F.col("p1") != F.col("p2"), F.col("right")).alias("right"))
    met = met.unionByName(tiles.filter("parts = 1").select(F.col("tile").alias("left"), F.lit(None).cast("array<array<long>>").alias("right")))

    def compare(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch["left"], batch["right"]):
                a = [np.asarray(m, dtype=np.int64) for m in a]
                found += settled(a, a if b is None else [np.asarray(m, dtype=np.int64) for m in b])
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.mapInPandas(compare, "a long, b long")


def text_key(text: Column) -> Column:
    """What tells texts apart; a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """(id_col, text_key, component_id, stays) for every row: groups of documents whose sets of five-word shingles are alike by 0.8 or more.

    Candidates are told from 512-bit fingerprints, see LONG_RULE; classes go by size in steps of a third,
    so only those of like size meet.  Within each group that candidates connect, likeness is settled by
    the shingles themselves, as 64-bit hashes.  component_id is the smallest id of a group, and stays
    marks the row that stands for it: that of the smallest id, null after all others, and of these the
    one with the smallest text_key.
    """

    @F.pandas_udf("whole long, size long, words array<long>")
    def taken(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([long_fingerprint(t, shingle_words) for t in texts], columns=["whole", "size", "words"])

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([np.sort(shingle_hashes(t, shingle_words).view(np.int64)) for t in texts], dtype=object)

    texts = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    with small_batches(docs.sparkSession):
        own = cut(texts.select("id", "text_key", taken(F.col("text")).alias("f")).select("id", "text_key", "f.*"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "text_key")
    reps = cut(own.groupBy("whole").agg(F.min(place).alias("rep"), F.first("size").alias("size"), F.first("words").alias("words")))
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / F.log(F.lit(1 / LONG_RULE.least_ratio))).cast("int")
    nodes = reps.filter(F.col("size") >= LEAST_SIZE).select(band.alias("k"), F.concat(F.array("whole", "size"), "words").alias("record"))
    candidates = components(forest(nodes, [0, 1], LONG_RULE, tile=4 * TILE)).withColumnRenamed("node", "whole")
    asked = reps.join(candidates, "whole").select(
        key_of(F.col("rep.id")).alias("key"), F.col("rep.text_key").alias("text_key"), "root", F.col("whole").alias("node"), "words"
    )
    met = texts.withColumn("key", key_of(F.col("id"))).join(asked, ["key", "text_key"])
    members = met.select("root", "node", F.concat(F.array("node"), "words", hashes(F.col("text"))).alias("record"))
    with small_batches(docs.sparkSession):
        members = cut(members)
    rooted = components(settle(members))
    stays = F.col("id").eqNullSafe(F.col("named.id")) & (F.col("text_key") == F.col("named.text_key"))
    return own.join(named(reps, rooted, "whole", F.col("rep")), "whole").select(
        F.col("id").alias(id_col), "text_key", F.col("named.id").alias("component_id"), stays.alias("stays")
    )


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that do not stand for their group; of rows alike in id and text one stays.

    Rows are known by id and text together, so documents that merely share an id, or have none, all count.
    """
    own = ByPlace(docs)
    kept = groups.filter("stays").select(key_of(F.col(id_col)).alias("key"), "text_key").distinct()
    keyed = own.df.withColumn("key", key_of(F.col(own.name(id_col)))).withColumn("text_key", text_key(F.col(own.name(text_col))))
    once = keyed.groupBy("key", "text_key").agg(F.first(F.struct(*own.df.columns)).alias("row"))
    return own.back(once.join(kept, ["key", "text_key"], "left_semi").select("row.*"))
