"""MinHash near-duplicate groups by a chosen-path set similarity join.

A text is the set of its word bigrams (lower-cased; a text of one word is that word). Documents
with equal sets are one *representative*. Every representative keeps ``SIGNATURE`` minwise tokens.
In each of ``trees`` independent trees a node picks ``BRANCHES`` coordinates of the signature by a
hash of its own path, and sends each member to one child per coordinate, named by the member's
minwise token there. Nodes of at most ``leaf`` members are compared exhaustively; a node with one
member ends. In a larger node every dense cluster around a leader is compared with all that the
triangle inequality of the Jaccard distance leaves possible, and then leaves the node; the others
branch on. At ``max_depth`` any node is compared exhaustively, whatever its size. Pairs whose
signatures agree well enough are verified by the exact Jaccard similarity of the sets, and the
groups are the connected components of verified pairs.

No task holds a node of more than ``node_rows`` members (of more than ``LAST_ROWS`` at the last
level). Such a node's rows are dealt to *cells* of bounded size. Each cell gets the node's leaders
and finds the dense clusters around them; what has to be compared in blocks, cluster with
neighbourhood and at the last level all with all, is dealt to one cell for each pair of blocks.

Rows of a node whose signatures agree so well that they are nearly sure to match are a *bundle*,
of which only a spanning forest (or the pairs with the leader) is verified at first. Where one of
these pairs fails, all pairs of the bundle between different components are verified too.

The result has a row for each document of a group: nothing gathers a group's members in one place.

Defined results: rows with null ``doc_id``, null texts and texts without a word are in no group;
rows that repeat an id and its text count once (an id that has a text twice needs another id to be
in a group); ties count as copies; a group's id is its smallest ``doc_id``; an empty table has no
groups; other columns are not read. Where rows with different texts share a ``doc_id``, the id is
in the groups of each of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.tables import batched, dropped, few, free, looked_up, observed, only, table, without, written
from tessera.llm.words import chunked, mix, words

SIGNATURE = 64
BRANCHES = 2
THRESHOLD = 0.6
TREES = 4
LEAF = 96
MAX_DEPTH = 12
#: The most members of a node that one task holds, above the last level and at it, and the rows of a cell.
NODE_ROWS = 50_000
LAST_ROWS = 4_096
CELL_ROWS = 16_384
#: So many leaders of a large node are expected; a few more may be drawn, of which the first 62 count.
LEADERS = 32
#: Signatures estimate the similarity; pairs below the threshold by more than this are dropped, those above it by as much are sure enough to stand for others in a bundle.
SLACK = 0.16
#: A leader's sure neighbours can only match members that agree with the leader at least so far (triangle inequality, less the estimate's error).
SHELL = 0.2

_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(0, 2**31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(0, 2**32, SIGNATURE, dtype=np.uint32)


def shingles(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word bigrams of each text, and where each text's begin."""
    n = np.diff(first)
    if not len(hashes):
        return hashes, np.zeros(len(first), np.int64)
    pair = np.empty_like(hashes)
    pair[:-1] = mix(hashes[:-1] * np.uint64(3) + hashes[1:])
    last = first[1:][n > 0] - 1
    pair[last] = hashes[last]
    keep = np.ones(len(hashes), bool)
    keep[first[1:][n > 1] - 1] = False
    return pair[keep], np.concatenate([[0], np.cumsum(np.where(n > 1, n - 1, n))])


def _sorted_sets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's shingles as a set, and where each set begins."""
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    order = np.lexsort((h, owner)) if len(first) > 2 else np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(first)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in chunked(batch.column(1)):
            w = words(data, offsets)
            h, first = shingles(w.hash, w.first)
            some = np.flatnonzero(np.diff(first))
            if not len(some):
                continue
            at = first[some]
            h, sets = _sorted_sets(h, first)
            at = sets[some]
            low = (h >> np.uint64(17)).astype(np.uint32)
            sig = np.empty((len(some), SIGNATURE), np.uint16)
            for j in range(SIGNATURE):
                least = np.minimum.reduceat((low ^ _XOR[j]) * _MUL[j], at)
                sig[:, j] = ((least * np.uint32(0x9E3779B1)) ^ (least >> np.uint32(7))) >> np.uint32(16)
            raw = pa.Array.from_buffers(pa.binary(SIGNATURE * 2), len(some), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(some)), pa.array(_digests(h, at)), raw], ["doc_id", "digest", "sig"])


def _coordinates(node: np.ndarray) -> np.ndarray:
    """The signature places that each node chose, distinct within the node."""
    a = mix(node + np.uint64(0xA5A5A5A5A5A5A5A5))
    first = a % np.uint64(SIGNATURE)
    second = (first + np.uint64(1) + (a >> np.uint64(32)) % np.uint64(SIGNATURE - 1)) % np.uint64(SIGNATURE)
    return np.stack([first, second], 1).astype(np.int64)


def _children(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for both of each row's branches."""
    where = _coordinates(node)
    rows = np.arange(len(node))
    child = [mix(node * np.uint64(31) + mix((where[:, b].astype(np.uint64) << np.uint64(20)) + sig[rows, where[:, b]].astype(np.uint64) + np.uint64(b + 1))) for b in range(BRANCHES)]
    return np.concatenate([rows] * BRANCHES), np.concatenate(child)


def _matrix(raw: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.uint16).reshape(-1, SIGNATURE) if len(raw) else np.empty((0, SIGNATURE), np.uint16)


def _roots(trees: int):
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, sig, rep = batch.column(1), _matrix(batch.column(1)), batch.column(0)
            for r in range(trees):
                rows, child = _children(np.full(len(sig), mix(np.array([r + 1], np.uint64))[0]), sig)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), rep.take(at), raw.take(at)], ["node", "rep", "sig"])

    return roots


def _root_sizes(trees: int):
    """How many of a batch's rows each child of a root gets."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(0))
            child = [_children(np.full(len(sig), mix(np.array([r + 1], np.uint64))[0]), sig)[1] for r in range(trees)]
            node, n = np.unique(np.concatenate(child), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(n)], ["node", "n"])

    return sizes


def _compare(node: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bundle) of the rows within each run of equal ``node`` that may match; all pairs are looked at.

    Once sure pairs link two rows, other pairs between the same linked rows are left out: they
    can't change a group, unless one of the pairs kept turns out false. ``bundle`` is the least of
    the linked rows, and -1 for pairs that aren't sure.
    """
    n = len(node)
    left, right, same = [], [], []
    alive = np.arange(n)
    for step in range(1, n):
        alive = alive[alive + step < n]
        alive = alive[node[alive] == node[alive + step]]
        if not len(alive):
            break
        for at in range(0, len(alive), 1 << 16):
            i = alive[at : at + (1 << 16)]
            agree = (sig[i] == sig[i + step]).sum(1)
            hit = agree >= (threshold - SLACK) * SIGNATURE
            left.append(i[hit])
            right.append(i[hit] + step)
            same.append(agree[hit])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    i, j, agree = np.concatenate(left), np.concatenate(right), np.concatenate(same)
    sure = agree >= (threshold + SLACK) * SIGNATURE
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, i[sure], label[j[sure]])
        np.minimum.at(least, j[sure], label[i[sure]])
        least = np.minimum(least, least[least])
        if np.array_equal(least, label):
            break
        label = least
    apart = ~sure & (label[i] != label[j])
    # of the sure pairs a spanning forest is enough
    tree_i, tree_j = i[sure], j[sure]
    order = np.lexsort((tree_i, tree_j))
    tree_i, tree_j = tree_i[order], tree_j[order]
    keep = _forest(tree_i, tree_j, n)
    return np.concatenate([tree_i[keep], i[apart]]), np.concatenate([tree_j[keep], j[apart]]), np.concatenate([label[tree_i[keep]], np.full(int(apart.sum()), -1)])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Edges that a union-find takes, in order: a spanning forest."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(k)
    return np.array(kept, np.int64)


def _clusters(sig: np.ndarray, leaf: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray] | np.ndarray]:
    """Takes dense clusters out of a large node: their pairs (i, j, bundle) a part at a time, and at last the rows that stay."""
    stay, tried = np.arange(len(sig)), 0
    while len(stay) > leaf and tried < 4:
        lead = stay[int(mix(np.array([len(stay) * 8 + tried], np.uint64))[0] % np.uint64(len(stay)))]
        agree = (sig[stay] == sig[lead]).sum(1)
        sure = agree >= (threshold + SLACK) * SIGNATURE
        if sure.sum() <= max(8, leaf // 4):
            tried += 1
            continue
        core, shell = stay[sure & (stay != lead)], stay[~sure & (agree >= SHELL * SIGNATURE)]
        yield np.full(len(core), lead), core, np.full(len(core), lead)
        for i, j in _blocks(sig, np.append(core, lead), shell, threshold):
            yield i, j, np.full(len(i), -1)
        stay, tried = stay[~sure], 0
    yield stay


def _blocks(sig: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of the rows of ``left`` and of ``right`` that may match, a part at a time; all pairs are looked at."""
    others, held, n = np.ascontiguousarray(sig[right]), [], 0
    for x in left:
        hit = right[(others == sig[x]).sum(1) >= (threshold - SLACK) * SIGNATURE]
        if len(hit):
            held.append((x, hit))
            n += len(hit)
        if n > 1 << 17:
            yield np.repeat([h[0] for h in held], [len(h[1]) for h in held]), np.concatenate([h[1] for h in held])
            held, n = [], 0
    if held:
        yield np.repeat([h[0] for h in held], [len(h[1]) for h in held]), np.concatenate([h[1] for h in held])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``batches``, which are sorted by their first column, in tables that end where its value does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = batch.column(0)
        if ends[0].as_py() == ends[len(ends) - 1].as_py():
            continue  # the node goes on
        whole = pa.Table.from_batches(held).combine_chunks()
        node = whole.column(0).to_numpy()
        cut = int(np.searchsorted(node, node[-1]))
        held = whole.slice(cut).combine_chunks().to_batches()
        if cut:
            yield whole.slice(0, cut).combine_chunks()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _level(leaf: int, threshold: float, last: bool):
    """Rows sorted by node become pairs (``a``, ``b``, ``bundle``) and, from large nodes, rows of the children."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(node: np.ndarray, rep: np.ndarray, i: np.ndarray, j: np.ndarray, bundle: np.ndarray) -> pa.RecordBatch:
            a, b = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
            name = mix(node[bundle] ^ mix(rep[bundle].view(np.uint64))).view(np.int64)
            keep = np.unique(np.stack([a, b, np.where(bundle < 0, 0, name)], 1), axis=0, return_index=True)[1] if len(a) else np.empty(0, np.int64)
            keep = keep[a[keep] != b[keep]]
            n = len(keep)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(a[keep]), pa.array(b[keep]), pa.array(name[keep], mask=bundle[keep] < 0)], NAMES)

        def work(node: np.ndarray, rep: np.ndarray, raw: pa.Array) -> Iterator[pa.RecordBatch]:
            at = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
            size = np.diff(at)
            sized = np.repeat(size, size)
            small = np.flatnonzero((sized > 1) & ((sized <= leaf) | last))
            if len(small):
                i, j, bundle = _compare(node[small], _matrix(raw.take(pa.array(small))), threshold)
                if len(i):
                    yield pairs(node[small], rep[small], i, j, bundle)
            if last:
                return
            for k in np.flatnonzero(size > leaf):
                rows = np.arange(at[k], at[k + 1])
                sig = _matrix(raw.slice(at[k], size[k]))
                for found in _clusters(sig, leaf, threshold):
                    if isinstance(found, tuple):
                        yield pairs(node[rows], rep[rows], *found)
                    else:
                        stay = found
                which, child = _children(node[rows][stay], sig[stay])
                for lo in range(0, len(which), 20000):
                    take = rows[stay[which[lo : lo + 20000]]]
                    n = len(take)
                    yield pa.RecordBatch.from_arrays([pa.array(child[lo : lo + 20000].view(np.int64)), pa.array(rep[take]), raw.take(pa.array(take)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], NAMES)

        for whole in _whole(batches):
            yield from work(whole.column(0).to_numpy().view(np.uint64), whole.column(1).to_numpy(), whole.column(2).combine_chunks())

    return step


NAMES = ["node", "rep", "sig", "a", "b", "bundle"]
_LEVEL = "node long, rep long, sig binary, a long, b long, bundle long"


def _by_node(df: DataFrame) -> DataFrame:
    # in order of the representatives too, so that trees that find the same rows choose the same forest
    return df.repartition("node").sortWithinPartitions("node", "rep")


def _assign(threshold: float):
    """Rows of cells, a node's leaders (kind 0) before its others, become rows with the first leader that they surely match and the set of leaders that they are near."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole(batches):
            cell, rep, kind = (whole.column(c).to_numpy() for c in (0, 2, 4))
            sig = _matrix(whole.column(3).combine_chunks())
            at = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for lo, hi in zip(at[:-1], at[1:]):
                first = lo + int(np.searchsorted(kind[lo:hi], 1))
                own = sig[first:hi]
                lead, leader, near = np.full(hi - first, -1, np.int32), np.zeros(hi - first, np.int64), np.zeros(hi - first, np.int64)
                for k in range(min(first - lo, 62)):
                    agree = (own == sig[lo + k]).sum(1)
                    here = (lead < 0) & (agree >= (threshold + SLACK) * SIGNATURE)
                    lead[here], leader[here] = k, rep[lo + k]
                    near |= (agree >= SHELL * SIGNATURE).astype(np.int64) << k
                part = whole.slice(first, hi - first)
                yield pa.RecordBatch.from_arrays([part.column(c).combine_chunks() for c in (1, 2, 3)] + [pa.array(lead), pa.array(leader), pa.array(near)], ["node", "rep", "sig", "lead", "leader", "near"])

    return step


def _cells(threshold: float):
    """Rows of cells, those of one block (kind 0) before those of the other, become the pairs between the blocks that may match."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole(batches):
            cell, rep, kind = (whole.column(c).to_numpy() for c in (0, 1, 3))
            sig = _matrix(whole.column(2).combine_chunks())
            at = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            for lo, hi in zip(at[:-1], at[1:]):
                cut = lo + int(np.searchsorted(kind[lo:hi], 1))
                for i, j in _blocks(sig, np.arange(lo, cut), np.arange(cut, hi), threshold):
                    i, j = i[rep[i] != rep[j]], j[rep[i] != rep[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], ["a", "b"])

    return step


def _across(left: DataFrame, right: DataFrame, threshold: float, cell_rows: int) -> DataFrame:
    """(a, b) of the rows of two tables (group, rep, sig) with one group that may match; every pair of blocks is a cell of at most about twice ``cell_rows``."""
    count = lambda df, name: df.groupBy("group").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias(name))
    sizes = few(written(count(left, "lefts").join(count(right, "rights"), "group"), "sizes"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.join(sizes, "group").select("group", "rep", "sig", block("lefts").alias("i"), every("rights").alias("j"), F.lit(0).alias("kind"))
    two = right.join(sizes, "group").select("group", "rep", "sig", every("lefts").alias("i"), block("rights").alias("j"), F.lit(1).alias("kind"))
    rows = one.unionByName(two).select(F.xxhash64("group", "i", "j").alias("cell"), "rep", "sig", "kind")
    return rows.repartition("cell").sortWithinPartitions("cell", "kind", "rep").mapInArrow(_cells(threshold), "a long, b long")


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, child = _children(batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(2)))
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(at), batch.column(2).take(at)], ["node", "rep", "sig"])


def _large_nodes(big: DataFrame, leaf: int, threshold: float, last: bool, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """What ``_level`` makes of small nodes, of rows (node, rep, sig, n) of nodes with ``n`` members: pairs, and rows of the children."""
    salts = F.ceil(F.col("n") / cell_rows).cast("int")
    leaders = big.where(F.pmod(F.xxhash64("node", "rep"), F.col("n")) < LEADERS).select("node", "rep", "sig", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"))
    rows = leaders.unionByName(big.select("node", "rep", "sig", F.pmod(F.xxhash64("rep"), salts).cast("int").alias("salt"), F.lit(1).alias("kind")))
    cells = rows.select(F.xxhash64("node", "salt").alias("cell"), "node", "rep", "sig", "kind").repartition("cell").sortWithinPartitions("cell", "kind", "rep")
    assigned = written(cells.mapInArrow(_assign(threshold), "node long, rep long, sig binary, lead int, leader long, near long"), "assigned")
    led = few(written(assigned.where("lead >= 0").groupBy("node", "lead", "leader").count().where(F.col("count") > max(8, leaf // 4)).drop("count"), "led"))
    core = assigned.join(led, ["node", "lead", "leader"], "left_semi")
    stay = assigned.join(led, ["node", "lead", "leader"], "left_anti").select("node", "rep", "sig")
    group = F.xxhash64("node", "leader")
    star = core.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b"), group.alias("bundle")).where("a <> b")
    shell = assigned.withColumnsRenamed({"lead": "own", "leader": "owner"}).join(led, "node").where("own <> lead and (shiftright(near, lead) & 1) = 1")
    pairs = _across(core.select(group.alias("group"), "rep", "sig"), shell.select(group.alias("group"), "rep", "sig"), threshold, cell_rows)
    if last:
        rest = stay.select(F.xxhash64("node").alias("group"), "rep", "sig")
        pairs = pairs.unionByName(_across(rest, rest, threshold, cell_rows))
    return star.unionByName(pairs.withColumn("bundle", F.lit(None).cast("long"))), stay.mapInArrow(_branch, "node long, rep long, sig binary")


def candidates(reps: DataFrame, threshold: float, trees: int, leaf: int, max_depth: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Distinct pairs (a, b, bundle) that a chosen path brings together; ``bundle`` is null for pairs that stand for no others."""
    last_rows, cell_rows = min(LAST_ROWS, node_rows), min(CELL_ROWS, node_rows)
    level = reps.select("rep", "sig").mapInArrow(_roots(trees), "node long, rep long, sig binary")
    sizes = reps.select("sig").mapInArrow(_root_sizes(trees), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    found, at, any_large = None, None, True
    for depth in range(max_depth):
        last, large = depth == max_depth - 1, None
        if any_large or last:  # children of nodes that aren't large can't be
            counted = sizes if not depth else level.groupBy("node").agg(F.count("*").alias("n"))
            large = written(counted.where(F.col("n") > (last_rows if last else node_rows)), "large")
            any_large = not large.isEmpty()
        rows = level.join(few(large.select("node")), "node", "left_anti") if any_large and large is not None else level
        out, seen = observed(_by_node(rows).mapInArrow(_level(leaf, threshold, last), _LEVEL), f"level{depth}", below=F.count("node"))
        pairs = out.where("a is not null").select("a", "b", "bundle")
        below = out.where("node is not null").select("node", "rep", "sig")
        if any_large and large is not None:
            more, children = _large_nodes(level.join(few(large), "node"), leaf, threshold, last, cell_rows)
            pairs = pairs.unionByName(more)
            below = below if last else below.unionByName(children)
        pairs = written(pairs.distinct(), f"pairs{depth}")
        found = pairs if found is None else found.unionByName(pairs)
        level = below
        if at is not None:
            dropped(at)
        at = out
        if not seen["below"] and not (any_large and large is not None):
            break
    if at is not None:
        dropped(at)
    return found.distinct()


def left_out(pairs: DataFrame, checked: DataFrame, roots: DataFrame, reps: DataFrame, threshold: float, cell_rows: int = CELL_ROWS) -> DataFrame | None:
    """None if every bundle holds, else the pairs (a, b) of bundles with a pair that isn't among the ``checked`` ones that may join two of their components; in cells like those of a large node.

    Of any two components of a bundle one isn't its largest: rows of the others are compared with
    all rows of the bundle.
    """
    bundled = pairs.where("bundle is not null")
    broken, seen = observed(bundled.join(checked, ["a", "b"], "left_anti").select("bundle").distinct(), "broken", n=F.count("*"))
    if not seen["n"]:
        return None
    inside = bundled.join(few(broken), "bundle", "left_semi")
    inside = inside.select("bundle", F.col("a").alias("rep")).unionByName(inside.select("bundle", F.col("b").alias("rep"))).distinct()
    parts = inside.join(roots.select(F.col("v").alias("rep"), "root"), "rep", "left").select("bundle", "rep", F.coalesce("root", "rep").alias("part"))
    rows = written(parts.join(reps.select(F.col("digest").alias("rep"), "sig"), "rep").select(F.col("bundle").alias("group"), "rep", "part", "sig"), "bundles")
    largest = rows.groupBy("group", "part").count().groupBy("group").agg(F.max_by("part", F.struct("count", "part")).alias("largest"))
    others = rows.join(few(largest), "group").where("part <> largest").select("group", "rep", "sig")
    found = _across(others, rows.select("group", "rep", "sig"), threshold, cell_rows).distinct()
    return found.join(pairs.select("a", "b"), ["a", "b"], "left_anti")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's digest and its set, as sorted 32-bit hashes."""
    for batch in batches:
        for lo, hi, data, offsets in chunked(batch.column(1)):
            w = words(data, offsets)
            h, first = _sorted_sets(*shingles(w.hash, w.first))
            some = np.flatnonzero(np.diff(first))
            if not len(some):
                continue
            kept = [np.unique((h[first[k] : first[k + 1]] >> np.uint64(32)).astype(np.uint32)).tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(_digests(h, first[some])), pa.array(kept, pa.binary())], ["digest", "members"])


def _digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (np.add.reduceat(mix(h), at) ^ mix(np.bitwise_xor.reduceat(h, at))).view(np.int64)


def _jaccard(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    keep.append(k)
            at = pa.array(np.array(keep, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return check


def components(edges: DataFrame) -> DataFrame:
    """(v, root): each vertex of the undirected edges (a, b) with the smallest vertex of its component.

    Alternates large-star and small-star steps, each of which is two aggregations over edges
    only; the number of rounds grows with the logarithm of the longest path.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after, state = observed(small, "edges", n=F.count("*"), one=F.sum(F.xxhash64("u", "v") % 1000003), two=F.sum(F.xxhash64("v", "u") % 998244353))
        dropped(edges)
        edges = after
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have the Jaccard similarity of the threshold."""
    ends = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct()
    wanted = written(reps.select("digest", "doc_id").join(ends, "digest", "left_semi"), "wanted")
    # several rows may share an id, so that the digest decides which of their sets is meant
    found = only(docs, "doc_id", wanted.select("doc_id"), exact=False).mapInArrow(_sets, "digest long, members binary")
    members = written(found.join(wanted.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("members").alias("members")), "members")
    side = [members.select(F.col("digest").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab"]
    checked = written(pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "set_a", "set_b").mapInArrow(_jaccard(threshold), "a long, b long"), "checked")
    dropped(members, wanted)
    return checked


def _grouped(docs: DataFrame, text: str, key: str, threshold: float, trees: int, leaf: int, max_depth: int, node_rows: int) -> tuple[DataFrame, DataFrame]:
    """(root, digest, doc_id) of every id with a near copy or an equal text in another row, once for each text; and (digest, links) of the texts with near copies."""
    docs = batched(docs).select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).where("doc_id is not null and text is not null")
    sigs = written(docs.mapInArrow(_signatures, "doc_id long, digest long, sig binary"), "signatures")
    reps = written(sigs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"), F.count("*").alias("n"), F.first("sig").alias("sig")), "reps")
    pairs = written(candidates(reps.select(F.col("digest").alias("rep"), "sig"), threshold, trees, leaf, max_depth, node_rows), "candidates")
    checked = _verified(docs, reps, pairs.select("a", "b").distinct(), threshold)
    roots = components(checked)
    more = left_out(pairs, checked, roots, reps, threshold)
    if more is not None:
        more = written(more, "left_out")
        checked = checked.unionByName(_verified(docs, reps, more, threshold))
        roots = components(checked)
    linked = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct()).withColumnRenamed("v", "digest")
    grouped = written(reps.select("digest", "n", "doc_id", "most").join(linked, "digest", "left").where("root is not null or most > doc_id").select("digest", "n", F.coalesce("root", "digest").alias("root")), "grouped")
    ids = sigs.select("digest", "doc_id")
    rows = written(looked_up(ids, "digest", grouped, "n").select("root", "digest", "doc_id").distinct(), "members")
    links = written(checked.select(F.col("a").alias("digest")).unionByName(checked.select(F.col("b").alias("digest"))).groupBy("digest").agg(F.count("*").alias("links")), "links")
    dropped(sigs, reps, pairs, grouped)
    return rows, links


def _by_root(rows: DataFrame, facts: DataFrame) -> DataFrame:
    return looked_up(rows, "root", written(facts, "groups"), "n_docs")


def near_duplicate_groups(
    docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, max_depth: int = MAX_DEPTH, node_rows: int = NODE_ROWS
) -> DataFrame:
    """(doc_id, group_id, n_docs, links) of each document that has near copies; see the module for what counts.

    ``links`` are the verified pairs of the document's text with other texts: all pairs that the
    trees bring together, but in a dense cluster those of a spanning forest. Copies of one text
    share its links and needn't have any.

    Only ids and 128-byte signatures are shuffled through the trees; sets of hashes move once
    more, for the pairs to verify.
    """
    rows, links = _grouped(docs, text, key, threshold, trees, leaf, max_depth, node_rows)
    linked = rows.join(links, "digest", "left").select("root", "doc_id", F.coalesce("links", F.lit(0)).alias("links"))
    # an id whose texts are all in one group is one document of it
    once = written(linked.groupBy("root", "doc_id").agg(F.sum("links").cast("int").alias("links")), "once")
    groups = once.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.max("doc_id").alias("most"), F.count("*").cast("int").alias("n_docs")).where("most > group_id")
    found = _by_root(once, groups).select("doc_id", "group_id", "n_docs", "links")
    dropped(rows, links)
    return found


def _digested(place: int, name: str):
    """Adds to each row the digest of its text's set, as ``name``; null for texts without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, some = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for lo, _, data, offsets in chunked(batch.column(place)):
                w = words(data, offsets)
                h, first = _sorted_sets(*shingles(w.hash, w.first))
                at = np.flatnonzero(np.diff(first))
                if len(at):
                    digest[lo + at], some[lo + at] = _digests(h, first[at]), True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, mask=~some)], [*batch.schema.names, name])

    return run


def without_near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, max_depth: int = MAX_DEPTH, node_rows: int = NODE_ROWS
) -> DataFrame:
    """``docs`` with one row of each group, all other rows, and one of each repeated row.

    Rows are told apart by id and text: of a group the row of the least id stays, of equal ids that
    of the least digest, of equal digests the least row. Rows with a null id stay as they are, and
    those without a word too, but for repeated ones.
    """
    columns = docs.columns
    grouped, links = _grouped(docs, text, key, threshold, trees, leaf, max_depth, node_rows)
    # one id may be in a group several times, with texts that are near or equal
    least = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count("*").alias("n_docs"))
    id_, digest = free("_id", docs), free("_digest", docs)
    gone = written(_by_root(grouped, least).where(F.struct("doc_id", "digest") != F.col("first")).select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)).distinct(), "gone")
    dropped(grouped, links)
    ids = docs.select(F.col(key).cast("long").alias(id_)).where(F.col(id_).isNotNull())
    repeated = written(ids.groupBy(id_).count().where("count > 1").select(id_), "repeated")
    rows = docs.withColumn(id_, F.col(key).cast("long"))
    # the id alone tells a row that doesn't share it
    once = without(rows, id_, gone.select(id_).unionByName(repeated)).select(columns)
    if repeated.isEmpty():
        return once
    several = only(rows, id_, repeated).select(*columns, id_)
    several = batched(several).mapInArrow(_digested(columns.index(text), digest), StructType([*several.schema.fields, StructField(digest, LongType())]))
    several = several.join(gone, [id_, digest], "left_anti")
    first = several.where(F.col(digest).isNotNull()).groupBy(id_, digest).agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return once.unionByName(first).unionByName(several.where(F.col(digest).isNull()).select(columns).dropDuplicates())


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op5_minhash_near_dup": op5_near_dup}
ORACLE_SQL: dict[str, str] = {}
