"""Near-duplicate detection: a chosen-path set similarity join over word shingles.

Documents with equal shingle sets are collapsed first. Every remaining document is
embedded as TOKENS minwise tokens. In each of TREES independent trees it goes to the node of
one minwise hash; nodes of up to LIMIT documents are compared exhaustively, larger ones are
branched further by tokens that the path chooses, or compared exhaustively inside a task
where branching saves less than half the work. Nodes that don't fit a task (LOCAL) are
branched as a table.

The trees grow in two waves. The first FIRST trees only yield a spanning forest of their
likely links (a node of n similar documents needs n - 1; documents of large nodes meet the
node's centre first, those that agree most with its commonest tokens). Those links are
confirmed on the full sets and contracted to components, which label every document. In the
second wave a node of one label needs no further comparing. Of the others, the documents
that are likely similar to one of another label are brought together with their full sets,
and every two of them that differ in label are compared exactly inside the task. What comes
out is a forest of true links, so no wave ever writes more rows than its nodes have members.

Defined cases: null or blank text gives an empty set, linked with nothing; fully repeated
rows are one class and share its fate (identifiers are else taken as unique); a null
identifier stands alone as its own component; an empty table gives an empty result; other
columns are ignored (`near_duplicates`) or carried (`drop_near_duplicates`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .filters import may_hold
from .hashing import in_slices, minwise, mix, shingle_sets

WORDS = 5
PERCENT = 75
TOKENS = 160
TREES = 12
#: Trees of the first wave.
FIRST = 3
LIMIT = 128
#: Nodes of up to so many documents branch inside a task, larger ones as a table.
LOCAL = 4096
#: (branches, tokens a branch) of the levels below the first: a pair at similarity 0.75 stays together on a level with a
#: chance of 1 - (1 - 0.75**tokens)**branches, which is 0.98 at least. What is left after the last level is compared in full.
BRANCHES = ((4, 1), (5, 2), (12, 4))
#: A large node's branches are compared in full, block by block, where they are more than one in so many of its size.
SHRINK = 4
#: Centres that a large node's documents are compared with first, and rows that tell where a centre is.
CENTRES, SKETCH = 4, 256
#: Pairs that agree on fewer than FEW of the first GLANCE tokens are passed over: five deviations under 0.75.
GLANCE, FEW = 32, 12
#: Estimates below these are not candidates: of the first wave, and of the second, four deviations under 0.75 at TOKENS tokens.
LIKELY, POSSIBLE = 0.7, 0.61
SURE = 0.87
#: Shingles of a node that are compared in one task; nodes with more are dealt into blocks, of which every two meet.
WEIGHT = 4_000_000


def _lowered(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode().lower() for t in texts]


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, the set's digest (two longs), its keys (TREES minwise hashes) and tokens (16 bits of TOKENS minwise hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), _lowered(batch.column(1).to_pylist())
            for a, b in in_slices(texts):
                sets = shingle_sets(texts[a:b], words)
                n = np.array([len(s) for s in sets])
                d1 = np.array([np.add.reduce(s) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) for s in sets], np.uint64).view(np.int64)
                least = minwise(sets, TOKENS, 11)
                keys, tokens = least[:, :TREES].view(np.int64), mix(least).astype(np.uint16).view(np.int16)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (keys, tokens)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), pa.array(d1), pa.array(d2), *lists], names=["doc_id", "n_shingles", "d1", "d2", "keys", "tokens"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, tokens array<short>")


def nodes_of(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, node, doc_id) of every node with several documents that fits a task, and with size of larger ones."""
    keyed = classes.select("doc_id", F.posexplode("keys").alias("tree", "key"))
    rows = keyed.select("tree", F.xxhash64("tree", "key").alias("node"), "doc_id")
    sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    marked = cut(rows.join(sizes, "node").select("tree", "node", "doc_id", "size"))
    return marked.where(F.col("size") <= LOCAL).drop("size"), marked.where(F.col("size") > LOCAL)


def _whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut anew so that no node is in two."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([held, now]) if held is not None else now
        node = now.column(0).to_numpy()
        last = int(np.searchsorted(node, node[-1]))  # the last node may go on in the next batch
        held = now.slice(last)
        if last:
            yield now.slice(0, last)
    if held is not None:
        yield held


def _per_node(rows: DataFrame, work, schema: str) -> DataFrame:
    """work's batches of whole nodes; rows are (node, ..., tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_nodes(batches):
            tokens = table.column("tokens").combine_chunks().flatten().to_numpy().reshape(-1, TOKENS)
            yield work(*[c.to_numpy() for c in table.columns[:-1]], tokens)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


def _bounds(node: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    return zip(edges.tolist(), [*edges[1:].tolist(), len(node)], strict=True)


def _centre(ids: np.ndarray, tokens: np.ndarray) -> tuple[int, int]:
    """Which row agrees most with the commonest tokens, the smallest identifier of equals, and on how many."""
    usual = np.empty(TOKENS, tokens.dtype)
    for t, column in enumerate(tokens[:: max(1, len(tokens) // SKETCH)].T):
        kinds, counts = np.unique(column, return_counts=True)
        usual[t] = kinds[counts.argmax()]
    agree = (tokens == usual).sum(axis=1)
    at = np.lexsort((ids, -agree))[0]
    return int(at), int(agree[at])


def hub_blocks(large: DataFrame, members: DataFrame) -> DataFrame:
    """(node, doc_id): all documents of large nodes in blocks that fit a task, each with its node's centre."""
    block = F.xxhash64("node", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") * 2 / LOCAL)))
    blocks = large.select(block.alias("block"), "node", "doc_id")

    def work(block, node, ids, tokens):
        found = [(int(node[a]), int(ids[a + at]), agree) for a, b in _bounds(block) for at, agree in [_centre(ids[a:b], tokens[a:b])]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["node", "doc_id", "agree"])

    asked = blocks.join(members, "doc_id").select(F.col("block").alias("node"), F.col("node").alias("of"), "doc_id", "tokens")
    hubs = _per_node(asked, work, "node long, doc_id long, agree long")
    hubs = cut(hubs.groupBy("node").agg(F.max_by("doc_id", F.struct("agree", -F.col("doc_id"))).alias("hub")))
    with_hub = blocks.join(hubs, "node").where("doc_id != hub")
    heads = with_hub.groupBy("block").agg(F.first("hub").alias("doc_id"))
    return with_hub.select(F.col("block").alias("node"), "doc_id").unionByName(heads.withColumnRenamed("block", "node"))


def crossings(large: DataFrame, tokens: DataFrame) -> DataFrame:
    """(node, doc_id, label) of nodes that fit a task and hold the pairs of different labels in large nodes (node, doc_id, label).

    Of a node nearly all of one label, the others meet every block of that label. Other nodes
    branch by as many tokens as bring them down to LOCAL documents if these agree on every
    second one, and by so many branches that a pair at the least similarity stays together
    with a chance of 0.98 (1 - e**-4); a document's rows so grow with the size to the power
    0.42. What hardly splits has every two blocks meet.
    """
    done, rows, level = [], large.withColumn("was", F.lit(None).cast("long")), 0
    while True:
        sizes = rows.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node")
        sizes = sizes.agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", "n").alias("main")).where("most < size")  # of one label, nothing is left to join
        rows = cut(rows.join(sizes, "node"))
        fits, few = F.col("size") <= LOCAL, F.col("size") - F.col("most") <= LOCAL // 4
        done.append(rows.where(fits).select("node", "doc_id", "label"))
        blocks = F.ceil(F.col("most") * 2 / LOCAL)
        every = F.sequence(F.lit(0).cast("long"), blocks - 1)
        own = F.array(F.pmod(F.xxhash64("doc_id"), blocks))
        crossed = rows.where(~fits & few).withColumn("block", F.explode(F.when(F.col("label") == F.col("main"), own).otherwise(every)))
        done.append(crossed.select(F.xxhash64("node", "block").alias("node"), "doc_id", "label"))
        rows = rows.where(~fits & ~few)
        alike = F.coalesce(F.col("size") * SHRINK > F.col("was"), F.lit(False))  # branching hardly splits it
        blocks = F.ceil(F.col("size") * 3 / LOCAL)  # two blocks fit a task
        all_ = rows.where(alike).withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        done.append(all_.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "doc_id", "label"))
        rows = rows.where(~alike)
        if not rows.limit(1).count():
            break
        # documents that aren't alike agree on a token less often than every second time, so that many tokens bring a node down to LOCAL
        width = F.least(F.lit(TOKENS // 10), F.greatest(F.lit(4), F.ceil(F.log2(F.col("size") / LOCAL)))).cast("int")
        branches = F.ceil(4 * F.pow(F.lit(100 / PERCENT), width)).cast("int")
        branched = rows.select("node", "doc_id", "label", "size", width.alias("width"), F.explode(F.sequence(F.lit(1), branches)).alias("branch")).join(tokens, "doc_id")
        chosen = F.expr(f"transform(sequence(1, width), j -> element_at(tokens, cast(pmod(xxhash64(node, branch, {level}, j), {TOKENS}) as int) + 1))")
        rows = branched.select(F.xxhash64("node", "branch", F.lit(level), chosen).alias("node"), "doc_id", "label", F.col("size").alias("was"))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _open_pairs(label: np.ndarray) -> int:
    """How many pairs differ in label."""
    counts = np.unique(label, return_counts=True)[1]
    return (len(label) ** 2 - int((counts.astype(np.int64) ** 2).sum())) // 2


def _children(path: int, level: int, rows: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A node's rows split by tokens that its path chooses."""
    branches, width = BRANCHES[min(level, len(BRANCHES) - 1)]
    for branch in range(branches):
        chosen = np.random.default_rng([path & (2**63 - 1), level, branch]).choice(TOKENS, width, replace=False)
        key = tokens[rows, chosen[0]].astype(np.uint64)
        for c in chosen[1:]:
            key = mix(key) + tokens[rows, c].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        kinds, starts = np.unique(key[order], return_index=True)
        for k, part in zip(kinds.tolist(), np.split(order, starts[1:]), strict=True):
            if len(part) > 1:  # a row alone has met the node's centres and goes on in other branches
                yield hash((path, level, branch, k)), rows[part]


def _similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, tokens: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs x, y whose estimates are at least so large, and these."""
    ok = 100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])
    x, y = x[ok], y[ok]
    likely = (tokens[x] == tokens[y]).mean(axis=1) if len(x) else np.zeros(0)
    ok = likely >= least
    return x[ok].astype(np.int32), y[ok].astype(np.int32), likely[ok].astype(np.float32)


def _to_centres(rows: np.ndarray, ids: np.ndarray, n: np.ndarray, label: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of rows with a few centres; what a centre meets takes its label."""
    left = rows
    for _ in range(CENTRES):
        if len(left) < 2:
            return
        centre = left[_centre(ids[left], tokens[left])[0]]
        near = rows[label[rows] != label[centre]]
        x, y, likely = _similar(np.full(len(near), centre), near, n, tokens, LIKELY)
        yield x, y, likely
        label[rows[np.isin(label[rows], label[y])]] = label[centre]
        left = left[label[left] != label[centre]]


def _all_open(rows: np.ndarray, n: np.ndarray, label: np.ndarray, tokens: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Likely ones of all pairs of rows that differ in label."""
    kinds, at, counts = np.unique(label[rows], return_inverse=True, return_counts=True)
    order = np.lexsort((at, counts[at]))  # the commonest label last: its rows begin no pair
    rows, at = rows[order], at[order]
    glance = np.ascontiguousarray(tokens[rows, :GLANCE])
    for i in range(len(rows) - int(counts.max())):
        y = i + 1 + np.flatnonzero((glance[i + 1 :] == glance[i]).sum(axis=1) >= FEW)
        y = y[at[y] != at[i]]
        if len(y):
            yield _similar(np.full(len(y), rows[i]), rows[y], n, tokens, least)


def _forest(low: np.ndarray, high: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Which pairs of documents low < high make a spanning forest.

    Nearly certain links come first, those of small identifiers before others, so that the
    trees that meet a group mostly agree on its links.
    """
    kept, root = [], {}
    for i in np.lexsort((high, low, np.maximum(0, SURE - likely))).tolist():
        a, b = _root(root, int(low[i])), _root(root, int(high[i]))
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append(i)
    return np.array(kept, np.int64)


def _root(root: dict[int, int], i: int) -> int:
    while root.get(i, i) != i:
        root[i] = i = root.get(root[i], root[i])
    return i


def _open_likely(node, ids, n, label, tokens, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of likely pairs of rows of a node that differ in label (rows of a node stand together)."""
    least, parts = LIKELY if first else POSSIBLE, []
    for a, b in _bounds(node):
        open_ = [(int(node[a]), np.arange(a, b), 0)]
        while open_:
            path, rows, level = open_.pop()
            if first and len(rows) > LIMIT:
                yield from _to_centres(rows, ids, n, label, tokens)
            if len(rows) <= LIMIT:
                if (label[rows] != label[rows[0]]).any():  # of one label, nothing is left to join
                    parts.append(rows)
                continue
            work = _open_pairs(label[rows])
            children = list(_children(path, level, rows, tokens)) if work and level < len(BRANCHES) else []
            if children and 2 * sum(_open_pairs(label[c]) for _, c in children) < work:
                open_.extend((p, c, level + 1) for p, c in children)
            elif work:  # branching saves little, so all are compared
                yield from _all_open(rows, n, label, tokens, least)
    sizes = np.array([len(p) for p in parts], np.int64)
    for m in np.unique(sizes[sizes > 1]).tolist():
        own, (i, j) = np.stack([p for p in parts if len(p) == m]), np.triu_indices(m, 1)
        step = max(1, 16_000 // len(i))
        for at in range(0, len(own), step):
            x, y = own[at : at + step, i].ravel(), own[at : at + step, j].ravel()
            ok = label[x] != label[y]
            yield _similar(x[ok], y[ok], n, tokens, least)


def likely_forest(rows: DataFrame) -> DataFrame:
    """Likely pairs (a, b) within the nodes of rows (node, doc_id, n_shingles, tokens), a spanning forest of each node."""

    def work(node, ids, n, tokens):
        found = list(_open_likely(node, ids, n, ids.copy(), tokens, True)) or [(np.zeros(0, np.int32),) * 3]
        x, y, likely = (np.concatenate(c) for c in zip(*found, strict=True))
        low, high = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        kept = _forest(low, high, likely)
        return pa.RecordBatch.from_arrays([pa.array(low[kept]), pa.array(high[kept])], names=["a", "b"])

    return _per_node(rows.select("node", "doc_id", "n_shingles", "tokens"), work, "a long, b long").distinct()


def still_open(rows: DataFrame) -> DataFrame:
    """(node, doc_id) of those rows (node, doc_id, n_shingles, label, tokens) that are likely similar to one of their node with another label."""

    def work(node, ids, n, label, tokens):
        hit = np.zeros(len(node), bool)
        for x, y, _ in _open_likely(node, ids, n, label, tokens, False):
            hit[x] = hit[y] = True
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(ids[hit])], names=["node", "doc_id"])

    return _per_node(rows.select("node", "doc_id", "n_shingles", "label", "tokens"), work, "node long, doc_id long")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows (node, doc_id, n_shingles, ...) with the nodes of more than WEIGHT shingles dealt into blocks, of which every two meet."""
    weights = rows.groupBy("node").agg(F.sum("n_shingles").alias("weight"))
    blocks = F.when(F.col("weight") > WEIGHT, F.ceil(F.col("weight") * 4 / WEIGHT)).otherwise(F.lit(1)).cast("long")
    dealt = rows.join(weights.select("node", blocks.alias("blocks")), "node").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = F.when(F.col("blocks") == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
    return dealt.withColumn("node", met).drop("blocks", "own", "other")


def true_forest(rows: DataFrame) -> DataFrame:
    """Links (a, b) by full sets within the nodes of rows (node, doc_id, label, set), a spanning forest over the labels of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_nodes(batches):
            node, ids, label = (table.column(i).to_numpy() for i in range(3))
            sets = table.column(3)
            links = [link for a, b in _bounds(node) for link in _joined(ids[a:b], label[a:b], [np.frombuffer(s.as_buffer(), np.uint64) for s in sets.slice(a, b - a)])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return rows.select("node", "doc_id", "label", "set").repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long").distinct()


def _joined(ids: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets of different labels that join all labels that links join."""
    _, at, counts = np.unique(label, return_inverse=True, return_counts=True)
    order = np.lexsort((ids, at, counts[at]))  # the commonest label last: its rows begin no pair
    ids, label = ids[order], at[order]
    size = np.array([len(sets[i]) for i in order])
    start = np.concatenate([[0], np.cumsum(size)])
    number = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    marked = np.zeros(int(number.max(initial=0)) + 1, np.uint8)
    links = []
    for i in range(len(ids) - int(counts.max())):
        near = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= PERCENT * np.maximum(size[i + 1 :], size[i])))
        if not len(near):
            continue
        marked[number[start[i] : start[i + 1]]] = 1
        from_, to = int(near[0]), int(near[-1]) + 1
        both = np.add.reduceat(marked[number[start[from_] : start[to]]], start[from_:to] - start[from_], dtype=np.int64)[near - from_]
        marked[number[start[i] : start[i + 1]]] = 0
        for j in near[100 * both >= PERCENT * (size[near] + size[i] - both)].tolist():
            if label[j] != label[i]:
                links.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                label[label == label[j]] = label[i]
    return links


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(doc_id, set) of the wanted documents; one row an identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), _lowered(batch.column(1).to_pylist())
            for a, b in in_slices(texts):
                sets = [s.tobytes() for s in shingle_sets(texts[a:b], words)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.where(may_hold(wanted, "doc_id")("doc_id")).join(wanted, "doc_id", "left_semi")  # most texts stay where they are
    return rows.mapInArrow(run, "doc_id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets have 100 * |intersection| >= 75 * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")
    joined = joined.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest identifier reachable by links) and kept, a row per document."""
    signed = cut(signatures(docs, key, text, words))
    # one representative of all documents with the same set
    classes = cut(
        signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("d1", "d2", "n_shingles")
        .agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("tokens").alias("tokens"))
    )
    members = classes.select("doc_id", "n_shingles", "tokens")
    tokens = classes.select("doc_id", "tokens")
    small, large = nodes_of(classes)
    any_large = large.limit(1).count() > 0
    nodes = small.where(F.col("tree") < FIRST).drop("tree")
    if any_large:
        nodes = nodes.unionByName(hub_blocks(large.where(F.col("tree") < FIRST), tokens))
    first = cut(likely_forest(nodes.join(members, "doc_id")))
    wanted = _ends(first)
    sets = cut(full_sets(docs, wanted, key, text, words).dropDuplicates(["doc_id"]))
    found = components(cut(confirmed(first, sets)))
    labels = found.withColumnsRenamed({"id": "doc_id", "component": "label"})

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))

    rows = labelled(small.drop("tree"))
    open_ = rows.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("node")
    rows = rows.join(open_, "node", "left_semi")
    if any_large:
        rows = rows.unionByName(crossings(labelled(large).select("node", "doc_id", "label"), tokens))
    left = cut(still_open(rows.join(members, "doc_id")))
    new = cut(left.select("doc_id").distinct().join(wanted, "doc_id", "left_anti"))  # no candidates of the first wave
    sets = sets.unionByName(full_sets(docs, new, key, text, words).dropDuplicates(["doc_id"]))
    dealt = _in_blocks(left.join(classes.select("doc_id", "n_shingles"), "doc_id"))
    more = cut(true_forest(labelled(dealt).join(sets, "doc_id")))
    found = components(more.unionByName(found.select(F.col("component").alias("a"), F.col("id").alias("b"))))
    groups = classes.select("d1", "d2", "n_shingles", F.col("doc_id").alias("id")).join(found, "id", "left")
    groups = groups.select("d1", "d2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    placed = signed.join(groups, ["d1", "d2", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest identifier. Columns as they were."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*names.values())
    gone = near_duplicates(renamed, names[key], names[text]).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = cut(gone)
    maybe = may_hold(gone, "__gone")(F.col(names[key]).cast("long"))
    asked = renamed.where(maybe).join(gone, F.col(names[key]) == F.col("__gone"), "left_anti")
    left = renamed.where(~maybe).unionByName(asked)
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
