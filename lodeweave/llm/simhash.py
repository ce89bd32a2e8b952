"""SimHash fingerprints, links between close ones by Golay-code keys, and near-duplicate groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .components import connected_components
from .golay import link_keys

SEED = 42
#: Keys with more fingerprints than this are linked through single-bit neighbours instead of pairs.
WIDE = 32
#: Buckets with more documents than this are compared with a few pivots first; what these don't join goes pairwise by tiles.
CROWD = 12
#: Documents of a crowded bucket that are compared as one block.
TILE = 512
#: Texts and shingles that the order of the prefixes is learnt from; any order gives the same pairs.
ORDER_TEXTS, ORDER_SHINGLES = 10_000, 100_000
#: Ids are broadcast up to this count (8 bytes each).
MOST_IDS = 500_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words (of the whole sequence where it has fewer; none for no word)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = zip(*[words[i:] for i in range(width)], strict=False) if len(words) >= width else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(r), SEED) for r in runs), dtype=np.uint64)


def fingerprint(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The 64-bit majority of the hashes, repeats included: a bit is 1 if over half of them have it. Zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, rid: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(rid, print): the fingerprint of each whole text as a signed long. A null or empty text has zero."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [signed(fingerprint(shingle_hashes(t, width))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["rid", "print"])

    return docs.select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text")).mapInArrow(run, "rid bigint, print bigint")


def _explode_keys(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            keys = link_keys(values.view(np.uint64))
            good = keys >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(values, keys.shape[1])[good.ravel()]), pa.array(keys[good])], ["print", "key"])

    return prints.mapInArrow(run, "print bigint, key bigint")


def links(prints: DataFrame) -> DataFrame:
    """(u, v) edges between distinct fingerprints that connect exactly those joined by steps of two or fewer bits.

    Candidates share a Golay key and are verified. Under a key that more than WIDE fingerprints share, pairs would grow
    with the square of the group; there each fingerprint goes to itself and its 64 one-bit neighbours, and all that meet
    at one value (two or fewer bits apart, and 65 at most) are tied to the least of them: the same components, exactly.
    """
    keyed = cut(_explode_keys(prints))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    kept = cut(keyed.join(shared, "key"))
    narrow = kept.where(F.col("n") <= WIDE)
    pairs = (
        narrow.select("key", F.col("print").alias("u"))
        .join(narrow.select("key", F.col("print").alias("v")), "key")
        .where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2))
        .select("u", "v")
    )
    flips = F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(64)])
    wide = kept.where(F.col("n") > WIDE).select("print").distinct().select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("at"))
    meet = wide.groupBy("at").agg(F.min("print").alias("v"), F.count("*").alias("n")).where("n > 1")
    stars = wide.join(meet, "at").select(F.col("print").alias("u"), "v").where("u <> v")
    return pairs.union(stars).distinct()


def linked_groups(docs: DataFrame, rid: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(rid, print, component) of every row: fingerprints within two bits are linked; component is the least rid reachable.

    Rows with equal texts, and rows without a word (fingerprint zero), fall together. Null rids are kept; a group of them
    alone has a null component. An empty table gives no rows.
    """
    rows = cut(fingerprints(docs, rid, text, width))
    prints = cut(rows.groupBy("print").agg(F.min("rid").alias("least")))
    roots = connected_components(links(prints.select("print")))
    rooted = prints.join(roots, prints.print == roots.node, "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    component = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("print", "component"))
    return rows.join(component, "print").select("rid", "print", "component")


def _common_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles that several of some texts have, the least common first. Only the order of the prefixes rests on them."""
    n = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, width)).view(np.int64))], ["shingle"])

    some = rows.where(F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(max(1, -(-n // ORDER_TEXTS)))) == 0).select("text")
    counted = some.mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    top = counted.orderBy(F.desc("n"), "shingle").limit(ORDER_SHINGLES).toArrow()
    return top.column("shingle").to_numpy()[::-1].view(np.uint64)


def least_common(size: int, similarity: float) -> int:
    """Shingles that a set of `size` shares at least with any set at `similarity` or more."""
    return math.ceil(similarity * size - 1e-9)


def parity_map(hashes: np.ndarray) -> bytes:
    """Bit i is the parity of the hashes that fall on i, over four bits a hash or more. Two maps differ in no more bits than
    their sets have elements apart; the longer folds to the shorter by XOR of its parts."""
    bits = max(512, 1 << int(4 * len(hashes)).bit_length())
    at = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) & bits - 1
    return np.packbits(np.bincount(at, minlength=bits) & 1).tobytes()


def _sketch(rows: DataFrame, width: int, similarity: float, print_width: int | None) -> DataFrame:
    """(rid, digest, size, keys, map, print): keys are the prefix of the distinct shingles, the rarest first; digest is that of
    the whole text, or of the empty one where there is no word; print is the fingerprint (zero without a print_width)."""
    common = _common_shingles(rows, width)
    order = np.argsort(common)
    known = rows.sparkSession.sparkContext.broadcast((common[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, ranks = known.value
        for batch in batches:
            digests, sizes, keys, maps, prints = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, width))
                rank = np.zeros(len(h), dtype=np.int64)
                if len(values) and len(h):
                    at = np.minimum(np.searchsorted(values, h), len(values) - 1)
                    rank = np.where(values[at] == h, ranks[at], 0)
                first = np.lexsort((h, rank))[: len(h) - least_common(len(h), similarity) + 1]
                digests.append(xxhash.xxh3_128_digest(t.encode() if len(h) else b""))
                sizes.append(len(h))
                keys.append(h[first].view(np.int64))
                maps.append(parity_map(h))
                prints.append(signed(fingerprint(shingle_hashes(t, print_width))) if print_width else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary()), pa.array(prints, pa.int64())], ["rid", "digest", "size", "keys", "map", "print"])

    return rows.mapInArrow(run, "rid bigint, digest binary, size int, keys array<bigint>, map binary, print bigint")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rid", "hashes"])

    return docs.mapInArrow(run, "rid bigint, hashes array<bigint>")


def _verified(rows: DataFrame, candidates: DataFrame, width: int, similarity: float) -> DataFrame:
    """(u, v) of the candidates (a, b) whose whole shingle sets are at `similarity` or more."""
    wanted = cut(candidates.select(F.col("a").alias("rid")).union(candidates.select("b")).distinct())
    # few enough ids go to every task; beyond that the texts are dealt out by id
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_IDS else wanted
    sets = cut(_sets(rows.join(wanted, "rid", "left_semi"), width))
    left, right = sets.select(F.col("rid").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("rid").alias("b"), F.col("hashes").alias("hb"))
    common, sizes = F.size(F.array_intersect("ha", "hb")), F.size("ha") + F.size("hb")
    return cut(candidates.join(left, "a").join(right, "b").where(common >= similarity * (sizes - common) - 1e-9).select(F.col("b").alias("u"), F.col("a").alias("v")))


def _by_maps(candidates: DataFrame, least: DataFrame, similarity: float) -> DataFrame:
    """The candidates (a, b) that their parity maps don't rule out; maps are far smaller than the sets."""
    apart = (1 - similarity) / (1 + similarity)
    of = lambda c: least.select(F.col("least").alias(c), F.col("size").alias(f"size_{c}"), F.col("map").alias(f"map_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            far = []
            for x, y in zip(batch.column("map_a").to_pylist(), batch.column("map_b").to_pylist(), strict=True):
                w = min(len(x), len(y)) // 8
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                far.append(int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, w)) ^ np.bitwise_xor.reduce(y.reshape(-1, w))).sum(dtype=np.int64)))
            yield batch.select(["a", "b"]).filter(pa.array(np.array(far, dtype=np.int64) <= apart * total + 1e-6, pa.bool_()))

    return candidates.join(of("a"), "a").join(of("b"), "b").mapInArrow(run, "a bigint, b bigint")


def tile_pairs(table: pa.Table, similarity: float) -> pa.Table:
    """(a, b) of the documents of one block that may be at `similarity` and are not joined yet. A pair that its sizes, the
    places of the key or the parity maps rule out is not at `similarity`, or has an earlier key in common."""
    share, apart = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)
    rid, root, size, pos, tile = (table.column(c).to_numpy() for c in ("rid", "root", "size", "pos", "tile"))
    maps = [np.frombuffer(m, np.uint64) for m in table.column("map").to_pylist()]
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    us, vs = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
    out_a, out_b = [], []
    words = np.array([len(m) for m in maps])
    for wu in np.unique(words[us]):
        for wv in np.unique(words[vs]):
            w = min(wu, wv)
            own, others = us[words[us] == wu], vs[words[vs] == wv]
            folded = {k: np.stack([np.bitwise_xor.reduce(maps[i].reshape(-1, w)) for i in part]) for k, part in (("u", own), ("v", others))}
            for i, u in enumerate(own):
                total, left = size[u] + size[others], np.minimum(size[u] - pos[u], size[others] - pos[others])
                may = (root[others] != root[u]) & (left >= share * total - 1e-6)
                may &= (rid[others] != rid[u]) if lo != hi else (rid[others] > rid[u])
                js = np.flatnonzero(may)
                if len(js):
                    far = np.bitwise_count(folded["v"][js] ^ folded["u"][i]).sum(axis=1, dtype=np.int64)
                    js = js[far <= apart * total[js] + 1e-6]
                    out_a.append(np.minimum(rid[u], rid[others[js]]))
                    out_b.append(np.maximum(rid[u], rid[others[js]]))
    none = np.zeros(0, dtype=np.int64)
    return pa.table({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})


def _crowded_rest(crowd: DataFrame, least: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(a, b): candidates of crowded buckets among documents that the links so far do not join."""
    rooted = cut(crowd.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 <> r1").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    rest = rooted.select("key", "rid", "size", "pos", "root").join(open_keys, "key")
    rest = rest.withColumn("tile", F.pmod(F.xxhash64("rid", F.lit(7)), F.col("tiles")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = rest.select("key", F.least("tile", "t").alias("lo"), F.greatest("tile", "t").alias("hi"), "tile", "rid", "size", "pos", "root")
    mapped = rest.join(least.select(F.col("least").alias("rid"), "map"), "rid")

    def run(table: pa.Table) -> pa.Table:
        return tile_pairs(table, similarity)

    return mapped.groupBy("key", "lo", "hi").applyInArrow(run, "a bigint, b bigint").distinct()


def _printed(least: DataFrame) -> DataFrame:
    """(u, v) links between texts whose fingerprints are equal or within two bits: through the first text of each fingerprint."""
    prints = cut(least.groupBy("print").agg(F.min("least").alias("first")))
    of = lambda c, first: prints.select(F.col("print").alias(c), F.col("first").alias(first))
    close = links(prints.select("print")).join(of("u", "a"), "u").join(of("v", "b"), "v").select("a", "b")
    equal = least.join(prints, "print").select(F.col("least").alias("a"), F.col("first").alias("b"))
    return cut(close.union(equal).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def near_duplicates(docs: DataFrame, rid: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, print_width: int | None = None) -> DataFrame:
    """(rid, group) of every row that belongs to a group of two or more; group is the least rid in it.

    Groups are the components of links between equal texts and between texts whose sets of `width`-word shingles have a
    Jaccard similarity of `similarity` or more; with a `print_width` also between all texts whose SimHash fingerprints of
    so many words are within two bits, found by links(). Texts collapse to one representative each first. Candidates share a key:
    the keys of a set of n shingles are its n - ceil(similarity * n) + 1 rarest in one order of all shingles, so two sets
    at `similarity` have one in common. Every candidate is verified on the whole shingle sets (64-bit hashes). In a
    bucket of more than CROWD texts each is compared with up to four pivots first; then the texts of a bucket that are
    not in one component yet are compared pairwise, in tiles, by filters that lose no pair. Null texts count as empty, and
    all texts without a word are one group; rows with a null rid are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(rid).isNotNull()).select(F.col(rid).cast("bigint").alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # only sketches are dealt out; texts are equal if their 128-bit digests are
    sketched = cut(_sketch(rows, width, similarity, print_width))
    same = sketched.select("rid", "digest")
    least = cut(sketched.groupBy("digest").agg(F.min("rid").alias("least"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("size", "keys", "map", "print")]))
    keyed = least.select(F.col("least").alias("rid"), "size", F.posexplode("keys").alias("pos", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(shared, "key"))
    few = met.where(F.col("n") <= CROWD).select("key", "rid", "size", "pos")
    other = few.select("key", F.col("rid").alias("b"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"))
    # if the key is the first in common, the rest behind it must hold enough
    enough = F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b")) >= similarity / (1 + similarity) * (F.col("size") + F.col("size_b")) - 1e-6
    pairs = few.join(other, "key").where((F.col("rid") < F.col("b")) & enough).select(F.col("rid").alias("a"), "b")
    crowd, member = met.where(F.col("n") > CROWD), F.struct("rid", "size")
    order = F.xxhash64("rid")
    pivots = crowd.groupBy("key").agg(F.array_distinct(F.array(F.min(member), F.max(member), F.min_by(member, order), F.max_by(member, order))).alias("pivots"))
    # a document meets the same pivots under many keys: each once
    facing = crowd.join(pivots, "key").groupBy("rid", "size").agg(F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots"))
    alike = F.least("size", "p.size") >= similarity * F.greatest("size", "p.size") - 1e-6
    stars = facing.select("rid", "size", F.explode("pivots").alias("p")).where(alike).select(F.least("rid", "p.rid").alias("a"), F.greatest("rid", "p.rid").alias("b"))
    candidates = cut(_by_maps(pairs.union(stars).where(F.col("a") < F.col("b")).distinct(), least, similarity).distinct())
    verified = _verified(rows, candidates, width, similarity)
    verified = verified.union(_printed(least)) if print_width else verified
    roots = connected_components(verified)
    if not crowd.isEmpty():
        rest = cut(_crowded_rest(crowd, least, roots, similarity).join(candidates, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            roots = connected_components(verified.union(_verified(rows, rest, width, similarity)))
    # the texts' groups, carried back to all of their copies
    groups = least.join(roots, least.least == roots.node, "left").select("digest", "copies", F.coalesce("root", "least").alias("group"), F.col("root").isNotNull().alias("linked"))
    heads = roots.select(F.col("root").alias("group")).distinct().withColumn("head", F.lit(True))
    grouped = groups.join(heads, "group", "left").where((F.col("copies") > 1) | F.col("linked") | F.col("head"))
    return same.join(grouped.select("digest", "group"), "digest").select("rid", "group")


def keep_one(docs: DataFrame, rid: str = "doc_id", text: str = "text", print_width: int = 3) -> DataFrame:
    """The rows without those that near_duplicates(), by fingerprints and by similarity, groups under another row; the row of
    least rid in a group stays."""
    dropped = cut(near_duplicates(docs, rid, text, print_width=print_width).where("rid <> group").select(F.col("rid").alias("_dropped")).distinct())
    dropped = F.broadcast(dropped) if dropped.count() <= MOST_IDS else dropped
    return docs.join(dropped, docs[rid] == dropped["_dropped"], "left_anti")


def hex16(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked_groups(docs).select(F.col("rid").alias("doc_id"), hex16(F.col("print")).alias("fingerprint"), F.col("component").alias("component_id"))
