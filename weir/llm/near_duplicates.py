"""Operator 7, MinHash near-dedup: chosen-path set similarity join.

1. One pass over the texts gives each document's set size, a content key of its set (equal sets, equal keys) and a
   signature of minwise tokens. Documents of one key are one representative, with a number, from here on.
2. Chosen paths: in each of `trees` independent trees a node picks one or two signature places (4/3 on average,
   one over the threshold), and a representative goes to the child of each place's minwise token. The first `start`
   levels are taken at once; nodes that are still large branch again, up to `depth` levels.
3. Small nodes are compared exhaustively by set sizes and signatures (nodes with the same members, once); candidates
   are linked by a spanning forest, and the forest's links are confirmed on full sets, recomputed from the texts of
   just these representatives. In nodes where a forest link failed, all remaining candidate pairs between different
   components are confirmed as well, inside the node's task, and only links come out: copies are never expanded
   into all pairs, and no candidate link between components is lost.
4. Nodes that stay large at the last level hold many alike texts. They are compared in blocks against a pivot, and
   then whatever isn't in the node's main component against every block, as joins of cells of two blocks. That is
   exact; its work is the product of a node's size and of what its main component leaves over, so that it is small
   where a large node holds copies of one text, and quadratic in a node of many texts that are alike but don't link.
5. Components by alternating large-star and small-star steps, as tables.

A pair at the threshold is missed with a probability of about (1 - 0.48)^12, 0.04 %, in the deepest nodes, and
(1 - 0.53)^12, 0.01 %, in others; more alike pairs far less. A candidate agrees in 55 % of the signature's places; a
pair at the threshold fails that with a probability of about 1e-7, far below what the trees miss. Nothing is collected
to the driver; a group that is collected to a task holds `leaf` rows, or two sides of 5 `leaf` rows at most in step 4.

Cases: ids are of any type that can be sorted; null and empty texts have an empty set, link with nothing and stay; a
text of fewer than `width` words is one shingle; rows of one doc_id are one document: their texts are linked; rows
without doc_id link with nothing and stay; repeated rows give equal rows; other columns are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_column, materialize, sifted, tidied
from .token_counts import slices

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CACHE = 100_000  # words whose hashes a worker keeps
CELL = 1_000_000  # shingles of a side that are compared at once
PRIME = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


@dataclass(frozen=True)
class JoinSetup:
    width: int = 5  # words of a shingle
    percent: int = 75  # similarity that links
    places: int = 128  # of a signature
    trees: int = 12
    start: int = 4
    depth: int = 5
    leaf: int = 200  # rows of a node that are compared exhaustively
    candidate: int = 55  # signature agreement, in per cent, that makes a candidate: 5.2 standard deviations below the threshold


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Shingler:
    """Sets of shingle hashes (sorted, distinct uint64) of texts."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.hash, self.known = width, xxhash.xxh3_64_intdigest, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        words = [t.encode().translate(FOLD).split() if t else [] for t in texts]
        known, fresh = self.known, self.hash
        for w in {w for ws in words for w in ws}.difference(known):
            known[w] = fresh(w)
        flat = np.fromiter((known[w] for ws in words for w in ws), dtype=np.uint64, count=sum(map(len, words)))
        if len(known) > CACHE:
            known.clear()
        k = self.width
        rolled = np.zeros(max(0, len(flat) - k + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                rolled = rolled * PRIME + flat[i : i + len(rolled)]
            rolled = mix(rolled)
            out, at = [], 0
            for ws in words:
                n = len(ws)
                if n >= k:
                    out.append(np.unique(rolled[at : at + n - k + 1]))
                elif n:
                    short = np.zeros(1, dtype=np.uint64)
                    for w in flat[at : at + n]:
                        short = short * PRIME + w
                    out.append(mix(short + U(n)))
                else:
                    out.append(np.zeros(0, dtype=np.uint64))
                at += n
        return out


def _multipliers(places: int) -> np.ndarray:
    return np.random.default_rng(75).integers(1, 1 << 63, places, dtype=np.uint64) * U(2) + U(1)


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """(sets, places) uint16: the least of each place's scrambling over each set, as a 16-bit hash (all sets non-empty)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), places), dtype=np.uint16)
    with np.errstate(over="ignore"):
        for i, m in enumerate(_multipliers(places)):
            least = np.minimum.reduceat(((flat * m) >> U(32)).astype(np.uint32), starts)
            out[:, i] = (least * np.uint32(2654435761)) >> np.uint32(16)
    return out


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, text): h tells the texts of one id apart."""
    said = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(said).alias("h"), said.alias("text"))


def sketch(docs: DataFrame, setup: JoinSetup, doc_id: str, text: str) -> DataFrame:
    """(doc_id, h, n, k1, k2, sig): hash of the text, set size, content key and signature (null for an empty set)."""
    places, width = setup.places, setup.width

    def start():
        shingler = Shingler(width)

        def work(values: list) -> dict[str, pa.Array]:
            n, k1, k2, sig = [], [], [], []
            texts = [t or "" for t in values]
            for a, b in slices(texts, 200_000):
                sets = shingler.sets(texts[a:b])
                some = [s for s in sets if len(s)]
                rows = iter(signatures(some, places)) if some else iter(())
                with np.errstate(over="ignore"):
                    for s in sets:
                        n.append(len(s))
                        k1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
                        k2.append(int(mix(s ^ PRIME).sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
                        sig.append(next(rows).tobytes() if len(s) else None)
            return {"n": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "sig": pa.array(sig, pa.binary())}

        return work

    return map_column(_texts(docs, doc_id, text), "text", start, "n long, k1 long, k2 long, sig binary")


def _branch(nodes: np.ndarray, sigs: np.ndarray, of: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of rows at nodes, with signature sigs[of[row]]: a child is named by a hash of node, place and minwise token."""
    with np.errstate(over="ignore"):
        h = mix(nodes * PRIME + U(1))
        first = (h >> U(8)) % U(places)
        second = (first + U(1) + (h >> U(20)) % U(places - 1)) % U(places)
        two = np.flatnonzero(h % U(3) == 0)
        row = np.r_[np.arange(len(nodes)), two]
        place = np.r_[first, second[two]]
        return row, mix(mix(nodes[row] ^ mix(place + U(77))) + sigs[of[row], place.astype(np.int64)].astype(np.uint64))


def _children(rows: DataFrame, setup: JoinSetup, roots: bool) -> DataFrame:
    """(node, rep) one level down from (node, rep, sig), or `start` levels down from the roots of all trees."""
    places, trees, start = setup.places, setup.trees, setup.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, places)
            reps = batch.column("rep").to_numpy(zero_copy_only=False)
            if roots:
                nodes, of = np.repeat(mix(np.arange(1, trees + 1, dtype=np.uint64)), len(reps)), np.tile(np.arange(len(reps)), trees)
            else:
                nodes, of = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64), np.arange(len(reps))
            for _ in range(start if roots else 1):
                row, nodes = _branch(nodes, sigs, of, places)
                of = of[row]
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(reps[of])], names=["node", "rep"])

    return rows.mapInArrow(tidied(run), "node long, rep long")


def _near_sizes(n: np.ndarray, m: np.ndarray | int, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be as similar as percent."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _forest(sigs: np.ndarray, sizes: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """A forest of greatest agreement among the pairs with at least `least` places in common and near sizes."""
    n = len(sigs)
    out, best, by, todo = [], np.full(n, -1), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    at = 0
    for _ in range(n - 1):
        todo[at] = False
        agree = np.where(_near_sizes(sizes, sizes[at], percent), (sigs == sigs[at]).sum(axis=1), -1)
        nearer = agree > best
        best[nearer], by[nearer] = agree[nearer], at
        at = int(np.argmax(np.where(todo, best, -2)))
        if best[at] >= least:
            out.append((int(by[at]), at))
    return out


def _across(sigs: np.ndarray, side: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links between different components across sides 0 and 1; members that got linked count as one component."""
    comp = comp.copy()
    left, out = np.flatnonzero(side == 0), []
    for j in np.flatnonzero(side == 1):
        near = left[_near_sizes(sizes[left], sizes[j], percent)]
        for i in near[(sigs[near] == sigs[j]).sum(axis=1) >= least]:
            if comp[i] != comp[j] and _similar(sets[i], sets[j], percent):
                out.append((int(i), int(j)))
                comp[comp == comp[i]] = comp[j]
    return out


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _pairs_in(groups: DataFrame, setup: JoinSetup, across: bool) -> DataFrame:
    """(node, a, b) pairs with a < b from groups of members.

    Not across: members are (rep, n, sig), and the candidate pairs of a forest are given. across: members have a
    component, a side and their full set as well, and confirmed links between components across the sides are given.
    """
    places, percent = setup.places, setup.percent
    least = places * setup.candidate // 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, a, b = [], [], []
            for name, group in zip(batch.column("node").to_pylist(), batch.column("members"), strict=True):
                of = {f.name: group.values.field(f.name) for f in group.values.type}
                reps, sizes = of["rep"].to_numpy(), of["n"].to_numpy()
                sigs = np.frombuffer(b"".join(of["sig"].to_pylist()), dtype=np.uint16).reshape(-1, places)
                if across:
                    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in of["shingles"]]
                    pairs = _across(sigs, of["side"].to_numpy(), of["comp"].to_numpy(), sets, sizes, least, percent)
                else:
                    pairs = _forest(sigs, sizes, least, percent)
                for i, j in pairs:
                    x, y = int(reps[i]), int(reps[j])
                    if x != y:
                        node.append(name), a.append(min(x, y)), b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["node", "a", "b"])

    return groups.select("node", "members").mapInArrow(tidied(run), "node long, a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()


def _full_sets(texts: DataFrame, wanted: DataFrame, reps: DataFrame, setup: JoinSetup) -> DataFrame:
    """(rep, shingles, n, sig) of the wanted representatives, from texts(doc_id, h, text) and reps(rep, doc_id, h, n, sig)."""
    width = setup.width

    def start():
        shingler = Shingler(width)

        def work(values: list) -> dict[str, pa.Array]:
            sets = [s.tobytes() for a, b in slices(values, 200_000) for s in shingler.sets(values[a:b])]
            return {"shingles": pa.array(sets, pa.binary())}

        return work

    at = materialize(wanted.join(reps.hint("merge"), "rep"), "wanted")
    # repeated rows meet before the shuffle
    found = sifted(texts, at.select("doc_id", "h"), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    found = found.join(at.hint("merge"), ["doc_id", "h"]).select("rep", "n", "sig", "text")
    return materialize(map_column(found, "text", start, "shingles binary"), "shingle-sets")


def _confirm(pairs: DataFrame, sets: DataFrame, setup: JoinSetup) -> DataFrame:
    """(a, b, linked) for pairs(a, b): by intersection and union of full sets."""
    percent = setup.percent
    # the hints keep one plan for all sizes: sets are large, and so are pairs of them
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the sets are read where they lie in the batch
            xs, ys = batch.column("x"), batch.column("y")
            linked = [_similar(np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64), percent) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return materialize(both.select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long, linked boolean"), "confirmed")


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) of the nodes of links(a, b): the least node that is reachable. Nodes without a link are left out."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    for _ in range(rounds):
        # large star: each node's larger neighbours go to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: each node and its smaller neighbours go to the least of them
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(small, "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _with_counts(rows: DataFrame) -> DataFrame:
    """rows of nodes with two or more representatives, and n, their number."""
    rows = materialize(rows, "paths")
    # a table of its own, so that the join of a large node can be split
    counts = materialize(rows.groupBy("node").agg(F.count("*").alias("n")).filter("n >= 2"), "node-counts")
    return materialize(rows.join(counts, "node"), "nodes")


def _node_rows(reps: DataFrame, setup: JoinSetup) -> DataFrame:
    """(node, rep, size, block) of the nodes that are compared, each set of members once; block is over 0 only in dense nodes."""
    leaf = setup.leaf
    level = _with_counts(_children(reps.select("rep", "sig"), setup, roots=True))
    small = [level.filter(F.col("n") <= leaf)]
    for _ in range(setup.depth - setup.start):
        large = level.filter(F.col("n") > leaf)
        if large.isEmpty():
            break
        level = _with_counts(_children(large.join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig"), setup, roots=False))
        small.append(level.filter(F.col("n") <= leaf))
    rows = small[0]
    for part in small[1:]:
        rows = rows.unionByName(part)
    # nodes with the same members (in several trees) are compared once; they are told by a hash of the members
    lists = rows.groupBy("node").agg(F.sort_array(F.collect_list("rep")).alias("reps"))
    lists = lists.groupBy(F.xxhash64("reps").alias("node"), F.size("reps").alias("size")).agg(F.first("reps").alias("reps"))
    plain = lists.select("node", F.explode("reps").alias("rep"), F.col("size").cast("long").alias("size"), F.lit(0).cast("long").alias("block"))
    dense = level.filter(F.col("n") > leaf).select("node", "rep", F.col("n").alias("size"), F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / leaf)).alias("block"))
    return materialize(plain.unionByName(dense), "node-rows")


def links(reps: DataFrame, texts: DataFrame, setup: JoinSetup = JoinSetup()) -> DataFrame:
    """(a, b) confirmed links between representatives that connect the same components as all links do.

    reps: (rep, n, sig, doc_id, h), the last two of a document that has the set; texts: (doc_id, h, text) of these and
    maybe other documents.
    """
    leaf = setup.leaf
    rows, owners, reps = _node_rows(reps, setup), reps.select("rep", "doc_id", "h", "n", "sig"), reps.select("rep", "n", "sig")
    member, dense = F.struct("rep", "n", "sig"), F.col("size") > leaf
    signed = rows.join(reps, "rep")
    pivots = rows.filter(dense).groupBy("node").agg(F.min("rep").alias("rep")).join(reps, "rep").select("node", F.array(member).alias("pivot"))
    groups = signed.groupBy("node", "block", "size").agg(F.collect_list(member).alias("members"))
    blocks = groups.filter(dense).join(pivots, "node").select("node", F.concat("pivot", "members").alias("members"))
    forest = materialize(_pairs_in(groups.filter(~dense).select("node", "members").unionByName(blocks), setup, across=False), "forest")
    pairs = forest.select("a", "b").distinct()
    sets = _full_sets(texts, _ends(pairs), owners, setup)
    first = _confirm(pairs, sets, setup)
    found = first.filter("linked").select("a", "b")

    failed = forest.join(first.filter("not linked"), ["a", "b"]).select("node").unionByName(rows.filter(dense).select("node")).distinct()
    # the only pair of a node of two is confirmed already
    again = rows.filter("size > 2").join(failed, "node", "left_semi")
    if again.isEmpty():
        return found
    # whatever has a candidate in its block has its set already; members of dense nodes may have one in another block
    missing = again.filter(dense).select("rep").distinct().join(sets, "rep", "left_anti")
    if not missing.isEmpty():
        sets = sets.unionByName(_full_sets(texts, missing, owners, setup))
    comps = components(found)
    again = again.join(sets.select("rep", "n"), "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    again = materialize(again.withColumn("comp", F.coalesce("component", "rep")).drop("component"), "second-look")
    # outside a node's main component: few, and compared with every block of it. One row a node, written, so that the
    # joins of a large node's rows with it can be split. Blocks have as many rows as have CELL shingles together.
    sizes = again.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    nodes = sizes.groupBy("node").agg(F.max(F.struct("c", (-F.col("comp")).alias("back"))).alias("top"), F.sum("c").alias("all"), F.sum("s").alias("s"))
    nodes = nodes.withColumn("cell", F.greatest(F.lit(leaf), F.least(F.lit(5 * leaf), F.floor(F.lit(CELL) * F.col("all") / F.col("s")))))
    nodes = nodes.select("node", (-F.col("top.back")).alias("main"), "cell", F.ceil((F.col("all") - F.col("top.c")) / F.col("cell")).cast("long").alias("u_blocks")).filter("u_blocks > 0")
    nodes = materialize(nodes, "second-look-nodes")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cells = again.join(nodes, "node").withColumn("blocks", F.when(dense, F.ceil(F.col("size") / F.col("cell"))).otherwise(F.lit(1)).cast("long"))
    side0 = cells.withColumns({"u": each(F.col("u_blocks")), "block": F.pmod(F.xxhash64("rep", F.lit(0)), "blocks")}).select("node", "block", "u", "rep", "comp", F.lit(0).alias("side"))
    side1 = cells.filter("comp <> main").withColumns({"u": F.pmod(F.xxhash64("rep", F.lit(1)), "u_blocks"), "block": each(F.col("blocks"))}).select("node", "block", "u", "rep", "comp", F.lit(1).alias("side"))
    second = side0.unionByName(side1).join(sets.hint("merge"), "rep").groupBy("node", "block", "u").agg(F.collect_list(F.struct("rep", "n", "sig", "comp", "side", "shingles")).alias("members"))
    return found.unionByName(_pairs_in(second, setup, across=True).select("a", "b").distinct())


def deduplicate(docs: DataFrame, setup: JoinSetup = JoinSetup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    rows = materialize(sketch(docs, setup, doc_id, text), "signatures")
    some = rows.filter(F.col("k1").isNotNull() & F.col("doc_id").isNotNull())
    reps = some.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "h")).alias("at"), F.first("sig").alias("sig"))
    reps = materialize(reps.select("k1", "k2", "n", "sig", "at.doc_id", "at.h", F.monotonically_increasing_id().alias("rep")), "representatives")
    found = links(reps, _texts(docs, doc_id, text), setup)
    owned = reps.select("k1", "k2", "n", "rep", F.col("doc_id").alias("owner"))
    named = materialize(rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(owned, ["k1", "k2", "n"], "left").select("doc_id", "n", "rep", "owner"), "named")
    # texts of one id are one document
    twice = named.filter("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("doc_id", "a")
    same = named.join(twice, "doc_id").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    comps = materialize(components(found.unionByName(same)).join(owned.select(F.col("rep").alias("node"), "owner"), "node"), "components")
    least = comps.groupBy("component").agg(F.min("owner").alias("least"))
    labelled = materialize(comps.join(least, "component").select(F.col("node").alias("rep"), "least"), "labels")
    component = F.coalesce("least", "owner", "doc_id")
    return named.join(labelled, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
