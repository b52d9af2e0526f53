"""N-gram Jaccard join by count-vector R-trees.

A text's set holds the names of its distinct word shingles. Tokens are hashed into groups; the group
counts of a set are a point, and two sets overlap by at most the summed minima of their coordinates. In
an R-tree of points the same sum over a node's upper corner bounds all sets below it. Pairs that the
bound leaves are verified on the sets.

Where one tree holds all points of a task, the tasks are made as follows, without losing a pair:

1. equal sets are one class, named by 64 bits; only classes go on;
2. a set of n tokens shares at least ceil(t * n) of them with any that it is linked with. So of its
   n - ceil(t * n) + s + 1 first tokens in the order of their names at least s + 1 are shared and are
   also among the first of the other. Each class emits these, with s for the size of its largest partner, and
   leaves out the s (for its own size) most frequent, by one order of all tokens: the rarest of the s + 1
   stays on both sides. Classes that share a token then may be linked; from each an edge to the smallest
   of the token is kept. So candidates form connected components: outside them no link is possible.
   Passages that documents share are what is left out, so components are small;
3. a component is dealt to blocks of about `BLOCK` classes, with its `PIVOTS` first classes in each. A
   task joins a block by R-tree; pairs that are connected already need no verifying;
4. where the blocks of a component are not connected by then, it is taken apart as in 2 with a larger s
   (`SPARE_LARGE`), and pairs of the blocks of what remains are joined too, as far as their ranges of
   sizes allow a link.

Tokens frequent in a sample of documents (`heavy_tokens`, a bounded list) are the most frequent of the order. A
class leaves them out first, where it emits; of those that stay a run of documents sends one row each, and an edge
for every other class. So no token gathers all documents that have it in one task.

Verified links and equal classes give components again, and each document its smallest doc_id.

Defined cases: null texts and texts without words are empty and linked with nothing, also among each
other; with fewer words than a shingle the whole sequence is the shingle; rows that share a doc_id are
documents each; null doc_id counts as larger than any other, and its component is null if no other id is
in it; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components, roots
from .sparkkit import NULL_ID, keyed, oid, stage, tag
from .textkit import Prefix, U, chunks, mix, runs, trimmed, utf8, word_names

SHINGLE = 3
PERCENT = 90
#: Token groups of a point, entries of an R-tree node.
GROUPS = 32
FANOUT = 16
BLOCK = 512
PIVOTS = 16


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, offsets): each document's distinct shingle names, ascending."""
    name, _, _, doc = word_names(data, off, lower=True)
    n = len(off) - 1
    count = np.bincount(doc, minlength=n)
    prefix = Prefix(name)
    first = np.cumsum(count) - count
    got, own = [], []
    full = prefix.windows(shingle)
    if len(full):
        ok = doc[: len(full)] == doc[shingle - 1 :]
        got.append(full[ok])
        own.append(doc[: len(full)][ok])
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        got.append(mix(prefix.spans(first[short], first[short] + count[short]) + count[short].astype(U)))
        own.append(short)
    if not got:
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    token, owner = np.concatenate(got), np.concatenate(own)
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    return token, np.searchsorted(owner, np.arange(n + 1), side="left")


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def class_names(token: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    size = np.diff(off).astype(U)
    return mix(_sums(mix(token ^ U(0x51ED270B)), off) + size)


def levels(percent: int, top: int) -> list[tuple[int, int]]:
    """(smallest size, tokens in which linked sets may differ at most) of each level of sizes. Linked
    sets are of one level or of neighbouring ones."""
    low, out = 1, []
    while low <= top:
        high = low * 100 // percent  # a set linked with one of size `low` has no more
        high = max(high, low)
        # union <= 2*high / (1+J), difference <= (1-J) * union
        differ = Fraction(100 - percent, 100) * Fraction(2 * high) / (1 + Fraction(percent, 100))
        out.append((low, int(differ)))
        low = high + 1
    return out


#: Spare tokens: one for each so many of a set, and for classes of large components.
SPARE = 10
SPARE_LARGE = 4
#: Documents of the sample that frequent tokens are told by, and in how many of them a token is frequent: there
#: are at most SAMPLED / OFTEN times as many as a document emits.
SAMPLED = 100_000
SAMPLE = 64
OFTEN = 16
#: Frequent tokens that a worker holds before they go on.
HELD = 500_000


def _heads(token, off, percent: int, spare: int):
    """(places, documents, number to leave out of each document): the tokens that each document emits."""
    n = np.diff(off)
    partner = n * 100 // percent  # of a linked set's size
    count = np.minimum(n, n - (n * percent + 99) // 100 + partner // spare + 1)
    at = np.repeat(off[:-1] - off[0], count) + runs(count)
    return at, np.repeat(np.arange(len(n)), count), n // spare


def head_tokens(token, off, percent: int, heavy: np.ndarray, often: np.ndarray, spare: int = SPARE):
    """(document, token, is it heavy) of what each document emits, and how many more of its most frequent tokens
    it may leave out. token: ascending in each document; heavy (ascending): frequent tokens, often: how frequent
    they are. Heavy ones are left out first, the most frequent before others."""
    at, doc, left = _heads(token, off, percent, spare)
    tk = token[at]
    if not len(heavy) or not len(tk):
        return doc, tk, np.zeros(len(tk), bool), left
    place = np.minimum(np.searchsorted(heavy, tk), len(heavy) - 1)
    hot = heavy[place] == tk
    h = np.flatnonzero(hot)
    order = h[np.lexsort((place[h], -often[place[h]], doc[h]))]
    n = np.bincount(doc[h], minlength=len(left))
    gone = order[runs(n) < left[doc[order]]]
    stay = np.ones(len(tk), bool)
    stay[gone] = False
    return doc[stay], tk[stay], hot[stay], np.maximum(0, left - n)


def _sets_of(batch, shingle):
    """(rows i to j of the batch, their tokens and offsets); shingle None: sets are there as tokens."""
    if shingle is None:
        data, off = utf8(batch.column("tokens"))
        for i, j in chunks(off):
            yield i, j, np.frombuffer(data[off[i] : off[j]].tobytes(), U), (off[i : j + 1] - off[i]) // 8
    else:
        data, off = utf8(batch.column("text"))
        for i, j in chunks(off):
            yield i, j, *shingle_sets(data, off[i : j + 1], shingle)


def _emit_sample(shingle, percent):
    def run(it):
        for batch in it:
            for _, _, token, off in _sets_of(batch, shingle):
                if len(token):
                    at, _, _ = _heads(token, off, percent, SPARE_LARGE)
                    yield pa.RecordBatch.from_arrays([pa.array(token[at].view(np.int64))], names=["key"])

    return run


def heavy_tokens(rows: DataFrame, shingle: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens ascending, how often): those in at least OFTEN documents of a sample of about SAMPLED."""
    n = rows.count()
    share = max(SAMPLE, n // SAMPLED)
    if n < share * OFTEN:
        return np.zeros(0, U), np.zeros(0, np.int64)
    sample = rows.filter(F.pmod(F.xxhash64("oid", "tag"), F.lit(share)) == 0)
    found = sample.mapInArrow(_emit_sample(shingle, percent), "key long").groupBy("key").count().filter(F.col("count") >= OFTEN).toArrow()
    key, often = found.column("key").to_numpy().view(U), found.column("count").to_numpy()
    order = np.argsort(key)
    return key[order], often[order]


def _emit_classes(shingle, percent, heavy):
    def run(it):
        for batch in it:
            for i, j, token, off in _sets_of(batch, shingle):
                left = head_tokens(token, off, percent, *heavy.value)[3]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("doc_id", "oid", "tag")), pa.array(np.diff(off)), pa.array(class_names(token, off).view(np.int64)), pa.array(left)],
                    names=["doc_id", "oid", "tag", "n", "node", "left"],
                )

    return run


def _emit_keys(shingle, percent, heavy, spare):
    """(key, node): the tokens that each class emits. Heavy ones go on once a run of documents, with its first
    class; an edge of the others to it is a key of its own that the two have."""

    def rows(key, node):
        for a in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 100_000].view(np.int64)), pa.array(node[a : a + 100_000])], names=["key", "node"])

    def combined(keys, nodes):
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        least = node[np.flatnonzero(head)][np.cumsum(head) - 1]
        yield from rows(key[head], node[head])
        # what hangs together in the run: one edge a class
        own, root = roots(node, least)
        own, root = own[own != root], root[own != root]
        name = mix(mix(own.view(U) ^ U(0xA0761D6478BD642F)) + root.view(U))
        yield from rows(np.concatenate([name, name]), np.concatenate([own, root]))

    def run(it):
        keys, nodes, held = [], [], 0
        for batch in it:
            for i, j, token, off in _sets_of(batch, shingle):
                if not len(token):
                    continue
                node = batch.column("node").to_numpy()[i:j] if shingle is None else class_names(token, off).view(np.int64)
                _, first = np.unique(node, return_index=True)  # copies in a chunk send once
                once = np.zeros(len(node), bool)
                once[first] = True
                doc, key, hot, _ = head_tokens(token, off, percent, *heavy.value, spare)
                own = once[doc]
                yield from rows(key[own & ~hot], node[doc[own & ~hot]])
                if (own & hot).any():
                    keys.append(key[own & hot])
                    nodes.append(node[doc[own & hot]])
                    held += len(keys[-1])
                if held > HELD:
                    yield from combined(keys, nodes)
                    keys, nodes, held = [], [], 0
        if keys:
            yield from combined(keys, nodes)

    return run


def candidates(keys: DataFrame, left: DataFrame) -> DataFrame:
    """(node, part): connected components of the classes that share a token that both keep. keys: key, node;
    left: node, left, one row a class."""
    # one shuffle: how often a token is emitted, and whether by more than one class
    w = Window.partitionBy("key")
    shared = keys.withColumns({"often": F.count(F.lit(1)).over(w), "a": F.min("node").over(w), "b": F.max("node").over(w)}).filter("a < b").select("key", "node", "often")
    rank = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("often"), "key"))
    kept = shared.join(left, "node").withColumn("r", rank).filter("r > left").select("key", "node")
    kept = stage(kept, "kept")
    least = kept.groupBy("key").agg(F.min("node").alias("dst"))
    edges = kept.join(least, "key").filter("node <> dst").select(F.col("node").alias("src"), "dst").distinct()
    return connected_components(edges).select("node", F.col("component").alias("part"))


def _left_of(heavy, percent, spare):
    def run(it):
        for batch in it:
            for i, j, token, off in _sets_of(batch, None):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.array(head_tokens(token, off, percent, *heavy.value, spare)[3])], names=["node", "left"])

    return run


def _emit_sets(shingle):
    def run(it):
        for batch in it:
            data, off = utf8(batch.column("text"))
            for i, j in chunks(off):
                token, toff = shingle_sets(data, off[i : j + 1], shingle)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("part", "oid", "node")), pa.array([token[a:b].tobytes() for a, b in zip(toff[:-1], toff[1:], strict=True)], pa.binary())],
                    names=["part", "oid", "node", "tokens"],
                )

    return run


#: Bits of the filter that spares other documents a shuffle: 8 MB, whatever the corpus.
BITS = 1 << 26


def _bit_places(oids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    h = mix(oids.view(U) * U(0x9E3779B97F4A7C15) + tags.astype(U))
    return np.stack([h & U(BITS - 1), (h >> U(32)) & U(BITS - 1)])


def _bit_words(it):
    for batch in it:
        at = np.unique(_bit_places(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("oid", "tag"))))
        yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int64)), pa.array((U(1) << (at & U(63))).view(np.int64))], names=["word", "bits"])


def _maybe_in(sent):
    def run(it):
        for batch in it:
            at = _bit_places(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("oid", "tag")))
            hit = ((sent.value[at >> U(6)] >> (at & U(63))) & U(1)).all(0)
            yield batch.filter(pa.array(hit.astype(bool)))

    return run


def only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows that a Bloom filter of keys (oid, tag) lets pass: all that are in keys and few others, so that
    the join that follows shuffles few texts. The filter reaches the driver as BITS / 64 words at most."""
    words = keys.select("oid", "tag").mapInArrow(_bit_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(BITS // 64, U)
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U)
    sent = rows.sparkSession.sparkContext.broadcast(filled)
    return rows.mapInArrow(_maybe_in(sent), rows.schema)


class RTree:
    """Points of token-group counts, packed bottom-up in the order of size and of the largest groups."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        self.point = np.stack([np.bincount((s >> U(59)).astype(np.int64), minlength=GROUPS) for s in sets])
        order = np.lexsort((*self.point[:, :2].T, self.point.argmax(1), self.size))
        self.leaf = [order[a : a + FANOUT] for a in range(0, len(order), FANOUT)]
        corner = np.stack([self.point[x].max(0) for x in self.leaf])
        least = np.array([self.size[x].min() for x in self.leaf])
        self.node = [(np.arange(a, min(a + FANOUT, len(self.leaf))), corner[a : a + FANOUT].max(0), least[a : a + FANOUT].min()) for a in range(0, len(self.leaf), FANOUT)]
        self.corner, self.least = corner, least

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Entries whose overlap bound allows a link with a set of this point and size."""
        out = []
        for leaves, corner, least in self.node:
            if np.minimum(point, corner).sum() * (100 + percent) < percent * (size + least):
                continue
            bound = np.minimum(point, self.corner[leaves]).sum(1)
            for k in leaves[bound * (100 + percent) >= percent * (size + self.least[leaves])]:
                own = self.leaf[k]
                bound_ = np.minimum(point, self.point[own]).sum(1)
                out.append(own[bound_ * (100 + percent) >= percent * (size + self.size[own])])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, for ascending distinct tokens."""
    if len(a) > len(b):
        a, b = b, a
    pos = np.searchsorted(b, a)
    both = int((b[np.minimum(pos, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def join_block(nodes, sets, percent: int, known=None) -> list[tuple[int, int]]:
    """Links that connect what is linked in a block: (node, node). known: components found before,
    whose members need no link among each other."""
    n = len(nodes)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    if known is not None:
        first: dict[int, int] = {}
        for k, c in enumerate(known):
            root[k] = first.setdefault(c, k)
    left = len({find(k) for k in range(n)})
    if left < 2:
        return []
    tree, out = RTree(sets), []
    for k in np.argsort(-tree.size, kind="stable"):
        for o in tree.near(tree.point[k], len(sets[k]), percent):
            if o != k and (a := find(int(k))) != (b := find(int(o))) and linked(sets[k], sets[o], percent):
                root[b] = a
                out.append((int(nodes[k]), int(nodes[o])))
                left -= 1
        if left == 1:
            break
    return out


def _join(percent):
    """Rows sorted by group (part, i, j): each group's links. Streams; holds one group."""

    def close(rows):
        nodes, sets, known = [], [], []
        seen = set()
        for node, tokens, comp in rows:
            if node not in seen:  # pivots of the block itself come twice
                seen.add(node)
                nodes.append(node)
                sets.append(np.frombuffer(tokens, U))
                known.append(comp)
        return join_block(nodes, sets, percent, known) if len(nodes) > 1 else []

    def run(it):
        group, rows = None, []
        for batch in it:
            cols = [batch.column(c).to_pylist() for c in ("part", "i", "j", "node", "tokens", "known")]
            out = []
            for p, i, j, node, tokens, comp in zip(*cols, strict=True):
                if (p, i, j) != group:
                    out += close(rows)
                    group, rows = (p, i, j), []
                rows.append((node, tokens, comp))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["src", "dst"])
        out = close(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["src", "dst"])

    return run


def classes_and_links(docs: DataFrame, shingle: int, percent: int, block: int = BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, oid, tag, n, node; links src, dst between nodes). Links connect exactly what
    is connected; not every linked pair has its own row."""
    rows = keyed(docs)
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_tokens(rows, shingle, percent))
    classes = stage(rows.mapInArrow(trimmed(_emit_classes(shingle, percent, heavy)), "doc_id long, oid long, tag long, n long, node long, left long"), "classes")
    table = levels(percent, int(classes.agg(F.max("n")).first()[0] or 0))
    keys = rows.mapInArrow(trimmed(_emit_keys(shingle, percent, heavy, SPARE)), "key long, node long")
    parts = stage(candidates(keys, classes.filter("n > 0").groupBy("node").agg(F.min("left").alias("left"))), "parts")
    # one document of each class in a part, with its set
    first = classes.join(parts, "node").groupBy("part", "node").agg(F.min(F.struct("oid", "tag")).alias("k")).select("part", "node", "k.oid", "k.tag")
    first = stage(first, "first")
    sets = only(rows, first).join(first, ["oid", "tag"]).select("part", "oid", "node", "text").dropDuplicates(["node"])
    sets = stage(sets.mapInArrow(trimmed(_emit_sets(shingle)), "part long, oid long, node long, tokens binary"), "sets")
    place = sets.select("part", "oid", "node")
    blocks = place.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("oid", "node"))
    pivot = place.withColumn("r", rank).filter(F.col("r") <= pivots).select("node", F.lit(True).alias("pivot"))
    dealt = place.join(blocks, "part").join(pivot, "node", "left").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    dealt = stage(dealt, "dealt")
    tokens = sets.select("node", "tokens")
    everywhere = F.when(F.coalesce("pivot", F.lit(False)), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    ready = dealt.select("part", F.explode(everywhere).alias("i"), F.lit(-1).alias("j"), "node", F.col("node").alias("known")).join(tokens, "node")
    ready = ready.repartition("part", "i").sortWithinPartitions("part", "i", "j", "node")
    links = stage(ready.mapInArrow(trimmed(_join(percent)), "src long, dst long"), "links")
    if dealt.filter("blocks > 1").isEmpty():
        return classes, links
    state = dealt.filter("blocks > 1").join(connected_components(links), "node", "left").select("part", "node", F.coalesce("component", "node").alias("known"))
    state = stage(state.join(tokens.select("node", (F.length("tokens") / 8).cast("long").alias("n")), "node"), "state")
    still = state.groupBy("part").agg(F.min("known").alias("a"), F.max("known").alias("b")).filter("a < b").select("part")
    if still.isEmpty():
        return classes, links
    # taken apart: what shares no rare token is not linked
    state = stage(state.join(stage(still, "still"), "part").drop("part"), "state")
    chosen = stage(tokens.join(state.select("node"), "node"), "chosen")
    left = chosen.mapInArrow(_left_of(heavy, percent, SPARE_LARGE), "node long, left long")
    found = candidates(chosen.mapInArrow(_emit_keys(None, percent, heavy, SPARE_LARGE), "key long, node long"), left)
    state = stage(state.join(found, "node"), "state")
    still = stage(state.groupBy("part").agg(F.min("known").alias("a"), F.max("known").alias("b")).filter("a < b").select("part"), "still")
    if still.isEmpty():
        return classes, links
    # dealt anew by sizes: linked sets are of one level or of neighbouring ones
    level = F.lit(0)
    for k, (low, _) in enumerate(table):
        level = F.when(F.col("n") >= low, F.lit(k)).otherwise(level)
    state = state.join(still, "part").withColumn("level", level)
    many = state.groupBy("part", "level").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    state = state.join(many, ["part", "level"]).withColumn("own", F.col("level") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("blocks")
    state = stage(state, "state")
    # blocks of one and the same component need not meet each other
    kinds = stage(state.groupBy("part", "level", "own").agg(F.min("known").alias("a"), F.max("known").alias("b")), "kinds")
    near = kinds.select("part", F.explode(F.array("level", F.col("level") + 1)).alias("level"), "own", "a", "b")
    pairs = near.alias("x").join(kinds.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.level") == F.col("y.level")) & (F.col("x.own") <= F.col("y.own")))
    pairs = pairs.filter("not (x.a = x.b and y.a = y.b and x.a = y.a)").select(F.col("x.part").alias("part"), F.col("x.own").alias("i"), F.col("y.own").alias("j"))
    sides = stage(pairs.distinct(), "pairs").select("part", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))
    more = state.join(sides, ["part", "own"]).select("part", "i", "j", "node", "known").join(tokens, "node")
    more = more.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "node")
    return classes, stage(links.unionByName(more.mapInArrow(trimmed(_join(percent)), "src long, dst long")), "links")


def near_duplicate_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, oid, tag, n_shingles, component_id, component (the component's node: unlike its smallest doc_id no
    other component has it; of documents without words null)."""
    classes, links = classes_and_links(docs, shingle, percent, block, pivots)
    least = classes.filter("n > 0").groupBy("node").agg(F.min("oid").alias("least"))
    comp = connected_components(links)
    # nodes outside links are components of their own
    least = least.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least")
    least = stage(least, "least")
    smallest = stage(least.groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
    label = stage(least.join(smallest, "component").select("node", "component", "smallest"), "label")
    out = classes.join(label, "node", "left")
    named = F.when(F.col("n") == 0, F.col("oid")).otherwise(F.col("smallest"))
    return out.select("doc_id", "oid", "tag", F.col("n").alias("n_shingles"), F.nullif(named, F.lit(NULL_ID)).alias("component_id"), "component")


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, same columns: of each group the document of the smallest doc_id, and of several rows of this id in the
    group one. Documents without words stay."""
    groups = near_duplicate_groups(docs, shingle, percent)
    groups = groups.withColumn("component_id", F.coalesce("component_id", F.lit(NULL_ID))).filter("n_shingles = 0 or oid = component_id")
    # groups may share their smallest id (null is one id), so each is known by its node
    one = groups.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct("oid", "tag")).alias("k")).select("k.oid", "k.tag")
    keep = one.select(F.col("oid").alias("__oid"), F.col("tag").alias("__tag"), F.lit(True).alias("__one")).distinct()
    empty = groups.filter("n_shingles = 0").select(F.col("oid").alias("__oid"), F.col("tag").alias("__tag"), F.lit(False).alias("__one")).distinct()
    rows = docs.select("*", oid().alias("__oid"), tag().alias("__tag"))
    rows = rows.join(stage(keep.unionByName(empty), "keep"), ["__oid", "__tag"])
    once = rows.filter("__one").dropDuplicates(["__oid", "__tag"])
    return once.unionByName(rows.filter("not __one")).select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_groups(docs, SHINGLE, PERCENT).select("doc_id", "n_shingles", "component_id")
