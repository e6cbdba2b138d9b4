"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A document is its set of shingles of ``k`` words (a shorter text: one shingle of all its words). Documents with equal sets
are one set with a multiplicity; a set's name is a 128-bit hash of its shingles. Each set has a signature of ``trees`` x
``depth`` labels. A tree is the trie of its labels: the sets in the order of their labels, so that those under a trie node lie
side by side. Every set begins with its whole label string as prefix and shortens it, alike in all trees, until a partner that
is as unlike as its size allows (``threshold``, or the least similarity above it that a set of so few shingles can have) shares
it in some tree with probability ``recall``. Sets under the node that both prefixes reach are candidates. Candidates form
components (edges go from the first set under a node to the others, so no node gives all its pairs). Inside a component all
pairs are verified exactly, in blocks; blocks return counts of links and a spanning forest, never the pairs.

The sorted sets are dealt over tasks by ranges, whatever their prefixes, so a node of any size is shared by several tasks;
what lies at the borders of the ranges is joined afterwards, a row a task and depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.components import connected_components, with_group_value
from tidelog.llm.storage import cut, partitions
from tidelog.llm.tables import documents
from tidelog.llm.words import Words, mix, slices

_LABEL = np.uint16


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; no words: an empty set."""
    h = words.hashes()
    g, _, ptr = words.windows(k, h)
    out = []
    for i, n in enumerate(words.counts):
        if n >= k:
            out.append(np.unique(g[ptr[i] : ptr[i + 1]]))
        elif n:
            own = h[words.row_ptr[i] : words.row_ptr[i + 1]]
            out.append(mix(np.array([xxhash.xxh3_64_intdigest(own.tobytes())], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(sets: list[np.ndarray], functions: int, seed: int = 1) -> np.ndarray:
    """MinHash labels (16 bits each) of non-empty sets."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 32, functions, dtype=np.uint32) | np.uint32(1)
    shift = rng.integers(0, 1 << 32, functions, dtype=np.uint32)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), functions), _LABEL)
    for f in range(functions):
        low = np.minimum.reduceat(flat * factor[f] + shift[f], at)
        out[:, f] = (low * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _sign(docs: DataFrame, k: int, functions: int) -> DataFrame:
    """(doc_id, sid, size, labels); sid null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = shingle_sets(Words(data, offsets), k)
                full = [i for i, s in enumerate(sets) if len(s)]
                labels: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], functions), strict=True):
                        labels[i] = row.tobytes()
                sid = [set_id(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sid, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(labels, pa.binary())], names=["doc_id", "sid", "size", "labels"])

    return docs.mapInArrow(run, "doc_id long, sid binary, size int, labels binary")


def _finds(s: float, d: int, trees: int) -> float:
    """Probability that sets of similarity s share a prefix of d labels in some tree."""
    return 1 - (1 - s**d) ** trees


def least_similarity(size: int, threshold: float) -> float | None:
    """The least similarity, of threshold or more, that a set of so many shingles can have with another; None: it has none."""
    found = None
    for union in range(size, int(size / threshold + 1e-9) + 1):
        common = min(size, union - 1)
        while common and (common - 1) / union >= threshold - 1e-9:
            common -= 1
        if common / union >= threshold - 1e-9:
            found = min(found or 1.0, common / union)
    return found


def prefix_depth(similarity: float, recall: float, trees: int, depth: int, least_depth: int) -> int:
    """The longest prefix that finds pairs of a similarity with probability recall."""
    for d in range(depth, least_depth - 1, -1):
        if _finds(similarity, d, trees) >= recall:
            return d
    raise ValueError(f"{trees} trees of depth {least_depth} find pairs of similarity {similarity} with less than probability {recall}")


def _depths(threshold: float, recall: float, trees: int, depth: int, least_depth: int, sizes: int = 64) -> np.ndarray:
    """Prefix length by size of a set, the last one for all greater sizes; 0 for sizes that have no partner."""
    like = [least_similarity(n, threshold) if n else None for n in range(sizes)] + [threshold]
    return np.array([0 if x is None else prefix_depth(x, recall, trees, depth, least_depth) for x in like], np.int8)


def _trie_rows(sets: DataFrame, trees: int, depth: int, depths: np.ndarray) -> DataFrame:
    """(path, d, sid): for each set and tree its tree and labels as bytes in the tree's order, and its prefix length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                d = depths[np.minimum(part.column(1).to_numpy(), len(depths) - 1)]
                part, d = part.filter(pa.array(d > 0)), d[d > 0]
                n = part.num_rows
                path = np.empty((n, trees, 1 + 2 * depth), np.uint8)
                path[:, :, 0] = np.arange(trees)
                labels = np.frombuffer(b"".join(part.column(2).to_pylist()), _LABEL).reshape(n, trees, depth)
                path[:, :, 1:] = labels.astype(">u2").view(np.uint8).reshape(n, trees, 2 * depth)
                width = path.shape[2]
                paths = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n * trees, [None, pa.py_buffer(path.tobytes())]).cast(pa.binary())
                sid = part.column(0).take(pa.array(np.repeat(np.arange(n), trees)))
                yield pa.RecordBatch.from_arrays([paths, pa.array(np.repeat(d, trees), pa.int8()), sid], names=["path", "d", "sid"])

    return sets.select("sid", "size", "labels").mapInArrow(run, "path binary, d tinyint, sid binary")


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading labels that paths, row by row, have in common; -1 in different trees."""
    same = a == b
    labels = same[:, 1::2] & same[:, 2::2]
    return np.where(same[:, 0], np.cumprod(labels, axis=1).sum(axis=1), -1)


_EDGES = "kind int, part int, low binary, high binary, a binary, b binary"


def _candidate_edges(rows: DataFrame, levels: list[int], width: int) -> DataFrame:
    """(a, b): from the first set under every trie node to the others. Only sets whose prefix is d or shorter are under a
    node of depth d, for each depth of levels."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(partitions(spark), "path", "sid").sortWithinPartitions("path", "sid")
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *((c, pa.binary()) for c in ("low", "high", "a", "b"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        low = last = None
        open_: dict[int, bytes | None] = dict.fromkeys(levels)  # first set under the node that the last row is under
        first: dict[int, bytes | None] = {}  # the same of the first row's node, once that node has ended
        for batch in batches:
            if not batch.num_rows:
                continue
            paths = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
            d, sid = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            before = np.concatenate([last if last is not None else paths[:1], paths[:-1]])
            shared = _shared(before, paths)
            low, last = paths[:1] if low is None else low, paths[-1:]
            pairs: list[tuple[bytes, bytes]] = []
            for level in levels:
                node = np.cumsum(shared < level)
                member = np.flatnonzero(d <= level)
                nodes, at, of = np.unique(node[member], return_index=True, return_inverse=True)
                hub = [sid[i] for i in member[at]]
                if len(nodes) and nodes[0] == 0 and open_[level] is not None:
                    hub[0] = open_[level]
                ended = int(node[-1])
                if ended and level not in first:
                    first[level] = hub[0] if len(nodes) and nodes[0] == 0 else open_[level]
                pairs += [(hub[k], sid[i]) for k, i in zip(of.tolist(), member.tolist(), strict=True) if hub[k] != sid[i]]
                if len(nodes) and nodes[-1] == ended:
                    open_[level] = hub[-1]
                elif ended:
                    open_[level] = None
            if pairs:
                a, b = zip(*set(pairs), strict=True)
                none = pa.nulls(len(a), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(a), pa.int32()), pa.array([part] * len(a), pa.int32()), none, none, pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)
        if low is not None:
            yield pa.RecordBatch.from_pylist([{"kind": x, "part": part, "low": low.tobytes(), "high": last.tobytes(), "a": first.get(x, open_[x]), "b": open_[x]} for x in levels], schema=schema)

    found = cut(ordered.mapInArrow(run, _EDGES), "trie-edges")
    borders = found.where("kind > 0").orderBy("kind", "part").collect()  # a row a task and depth
    joints = spark.createDataFrame(_join_borders(borders), "a binary, b binary")
    return found.where("kind = 0").select("a", "b").unionByName(joints).distinct()


def _join_borders(borders: list) -> list[tuple[bytes, bytes]]:
    """Edges between the first sets that tasks know of one node. borders: rows of _EDGES by depth and task."""
    out, level, last, hub = [], None, None, None
    as_path = lambda x: np.frombuffer(x, np.uint8)[None]
    for r in borders:
        if r["kind"] != level:
            level, last, hub = r["kind"], None, None
        if last is None or _shared(as_path(last), as_path(r["low"]))[0] < level:
            hub = None
        if hub is not None and r["a"] is not None and hub != r["a"]:
            out.append((bytes(hub), bytes(r["a"])))
        if _shared(as_path(r["low"]), as_path(r["high"]))[0] < level:
            hub = r["b"]
        elif hub is None:
            hub = r["a"]
        last = r["high"]
    return out


def _jaccard_links(sets: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """Boolean matrix of the pairs at the threshold and above, from exact intersections."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = count[inverse] > 1
    column, owner = number[inverse[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, last, columns):
        i, j = np.searchsorted(column, [c, c + columns])
        m = np.zeros((n, min(columns, last - c)), np.float32)
        m[owner[i:j], column[i:j] - c] = 1
        common += m @ m.T
    out = common >= threshold * (size[:, None] + size[None] - common) - 1e-6
    np.fill_diagonal(out, False)
    return out


def _forest(links: np.ndarray) -> np.ndarray:
    """For each row the least row it is linked with, over any path."""
    n = len(links)
    parent = np.full(n, -1)
    for i in range(n):
        if parent[i] < 0:
            reached = np.zeros(n, bool)
            reached[i] = True
            front = reached
            while front.any():
                front = links[front].any(axis=0) & ~reached
                reached |= front
            parent[reached] = i
    return parent


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, recall: float = 0.999, trees: int = 20, depth: int = 8, least_depth: int = 1, block: int = 256) -> DataFrame:
    """One row a document: (doc_id, class_id, n_links).

    class_id: least id of the documents that links of Jaccard similarity >= threshold reach; n_links: number of documents
    linked directly, copies counted each. Null and empty texts have no shingles: they are linked with nothing and stand for
    themselves. Rows with a null id take no part: class_id is null. Rows that repeat an id count each. Extra columns, whatever
    their names, are ignored. An empty table gives no row. A recall that prefixes of least_depth labels don't reach is an
    error.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    depths = _depths(threshold, recall, trees, depth, least_depth)
    levels = sorted(set(depths.tolist()) - {0})
    depth = levels[-1]
    d0 = documents(docs, id_col, text_col)
    signed = cut(_sign(d0, k, trees * depth), "signed")
    own = signed.where("sid IS NOT NULL AND doc_id IS NOT NULL")
    sets = cut(own.groupBy("sid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("labels").alias("labels")), "sets")
    edges = cut(_candidate_edges(_trie_rows(sets, trees, depth, depths), levels, 1 + 2 * depth), "candidate-edges")
    parts = connected_components(edges)
    sized = with_group_value(parts, "component", "node", "members", F.count("*"), F.sum)
    members = sized.join(sets.select(F.col("sid").alias("node"), "rep", "copies"), "node")
    blocks = F.ceil(F.col("members") / F.lit(block))
    members = members.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = cut(members.select("rep", F.col("node").alias("sid"), "copies", "component", "blocks", "own"), "members")
    # Members grow with the input, so their join is by shuffle at every size.
    texts = d0.join(members.hint("merge"), d0.doc_id == members.rep).select("sid", "copies", "component", "blocks", "own", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = texts.select("sid", "copies", "component", "own", "text", other)
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "copies", "text")
    dealt = dealt.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j", "sid")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}
        rows: list[tuple[bytes, bytes, int]] = []

        def close() -> None:
            if len(group) > 1:
                sids = list(group)
                links = _jaccard_links([group[s][2] for s in sids], threshold)
                _, i, j = key
                if i != j:
                    side = np.array([group[s][0] for s in sids])
                    links &= side[:, None] != side[None]
                copies = np.array([group[s][1] for s in sids], np.int64)
                counts = links.astype(np.int64) @ copies
                parent = _forest(links)
                rows.extend((sids[x], sids[parent[x]], int(counts[x])) for x in np.flatnonzero(counts))
            group.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([dict(zip(("sid", "root", "links"), r, strict=True)) for r in rows], schema=pa.schema([("sid", pa.binary()), ("root", pa.binary()), ("links", pa.int64())]))
            rows.clear()
            return out

        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                sets_ = shingle_sets(Words(data, offsets), k)
                for row, s in zip(part.drop_columns(["text"]).to_pylist(), sets_, strict=True):
                    now = (row["component"], row["i"], row["j"])
                    if now != key:
                        close()
                        key = now
                    if set_id(s) == row["sid"] if len(s) else False:  # another row of a repeated id may have another text
                        group[row["sid"]] = (row["own"], row["copies"], s)
            if len(rows) > 10_000:
                yield flush()
        close()
        yield flush()

    verified = cut(dealt.mapInArrow(verify, "sid binary, root binary, links long"), "verified")
    classes = connected_components(verified.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("sid").agg(F.sum("links").alias("links"))
    named = sets.select("sid", "rep", "copies").join(classes.withColumnRenamed("node", "sid"), "sid", "left")
    named = named.withColumn("component", F.coalesce("component", "sid"))
    named = with_group_value(named, "component", "sid", "class_id", F.min("rep"), F.min)
    named = named.join(links, "sid", "left").select("sid", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = cut(named, "named")  # so that the join below has exchanges of its own, whose large partitions can be split
    known = F.col("doc_id").isNotNull()
    out = signed.select("doc_id", "sid").join(named, "sid", "left")
    return out.select("doc_id", F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"))
