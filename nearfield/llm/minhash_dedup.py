"""Near-duplicate documents by a signature-coordinate inverted join.

Documents with one shingle set are one class. Each class is posted under the values
of its signature coordinates, two coordinates to a key (one where the threshold is
low). A pair that agrees on ``least`` of the coordinates disagrees on K - least, so
it must share one of the first K - least + 1 keys: only that prefix is posted. Within
a list of postings collisions are counted, and pairs of ``least`` or more are kept.
Lists are not turned into pairs, though: near copies are first joined with the member
that is nearest to the list's most common values, and only members that this leaves apart are
counted against all others, by merging their K - least + 1 shortest coordinate lists and
skipping the long ones, which a pair of enough collisions cannot need. What the kept pairs
connect, a family, then meets as whole texts, and links between members are confirmed
on full shingle sets in the same manner; links that join nothing new are not written.

Keys of very long lists come last in every document's prefix, so that a document posts
under one only where it has too few others. The long lists and large families that are
left are dealt out: all members are held against one central member, part by part, and
only those far from it meet the others, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import checkpointed, grouped, table, texts, unused
from ._text import BYTE_A, U64, WORD_A, Block, Words, blocks, inside, mix, ragged, signed

COORDINATES = 48
#: Chance that a pair at the very threshold falls short of the counted collisions.
MISS = 2e-5
#: Bytes of hashes of one family that meet in one task; larger families are dealt out.
FAMILY_BYTES = 8 << 20
#: A list of more postings is long, and dealt out to several tasks; keys and centres of at most HOT groups are broadcast.
LIST_ROWS, HOT = 1 << 14, 100_000
#: The centre of a dealt-out group is the most central of this many members, the least nodes of as many slots.
SLOTS = 64
#: How often the rest of a group is joined with its most central member.
CENTRES = 3

_rng = np.random.default_rng(1010)
_XOR = _rng.integers(0, 2**64, COORDINATES, dtype=np.uint64)
_TIMES = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)


def least_collisions(percent: int, miss: float = MISS) -> int:
    """The most coordinates that a pair of ``percent`` similarity reaches but with chance ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(COORDINATES + 1):
        below += math.comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if below > miss:
            return max(t, 1)
    return COORDINATES


def shingle_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and the offsets of the documents.

    A text of fewer words than ``size`` has its whole word sequence as its one shingle.
    """
    words = Words(block, lower=True)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(block) + 1, dtype=np.int64)
    hashes = words.hashes(BYTE_A)
    whole = inside(words.at, size)
    start = np.flatnonzero(whole)
    grams = WORD_A.grams(hashes, size)[start]
    at = np.searchsorted(start, words.at)
    count = np.diff(words.at)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        sums = WORD_A.sums(hashes)
        own = mix(WORD_A.spans(sums, words.at[short], words.at[short + 1]) + count[short].astype(np.uint64))
        grams = np.insert(grams, at[short], own)
        add = np.zeros(len(block) + 1, dtype=np.int64)
        add[short + 1] = 1
        at = at + np.cumsum(add)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            grams[a:b].sort()
    new = np.ones(len(grams), dtype=bool)
    new[1:] = grams[1:] != grams[:-1]
    firsts = at[:-1]
    new[firsts[firsts < len(grams)]] = True
    at = np.concatenate([[0], np.cumsum(new)])[at]
    return grams[new], at


def set_sums(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash of each set."""
    out = np.zeros(len(at) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(mix(grams), at[:-1][full])
    return out


def _signed_batches(size: int, keys: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                grams, at = shingle_sets(block, size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sums, xors = np.zeros((2, len(block)), dtype=np.uint64)
                low = np.zeros((len(block), COORDINATES), dtype=np.uint64)
                if len(full):
                    first = at[:-1][full]
                    sums[full] = set_sums(grams, at)[full]
                    xors[full] = np.bitwise_xor.reduceat(mix(grams ^ U64(0x5851F42D4C957F2D)), first)
                    for j in range(COORDINATES):
                        low[full, j] = np.minimum.reduceat((grams ^ _XOR[j]) * _TIMES[j], first)
                pair = low[:, : keys * width : width]
                if width == 2:
                    pair = mix(pair) + low[:, 1 : 2 * keys : 2]
                pair = mix(pair + np.arange(keys, dtype=np.uint64))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, len(block) * keys + 1, keys), type=pa.int32()), pa.array(signed(pair.ravel())))
                sig = (mix(low) & U64(255)).astype(np.uint8)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(block), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.rows.start, len(block)), pa.array(n, type=pa.int64()), pa.array(signed(sums)), pa.array(signed(xors)), packed, flat],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "keys"],
                )

    return run


class _Joined:
    """Union-find over the members of a group, and the links that join them."""

    def __init__(self, n: int):
        self.root, self.u, self.v = np.arange(n), [], []

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = int(self.root[x])
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.u.append(x)
            self.v.append(y)

    def roots(self) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root

    def apart(self) -> np.ndarray:
        """The members outside the largest part: a missing link has one of them at an end."""
        roots = self.roots()
        return np.flatnonzero(roots != np.bincount(roots).argmax()) if len(roots) else roots


def list_links(sig: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links that connect what pairs of at most ``most`` differing coordinates connect."""
    n, width = sig.shape
    if n == 2:
        return ([1], [0]) if (sig[0] != sig[1]).sum() <= most else ([], [])
    joined = _Joined(n)
    left = np.arange(n)
    for _ in range(CENTRES):
        if len(left) < 3:
            break
        common = np.array([np.bincount(c, minlength=256).argmax() for c in sig[left].T], dtype=np.uint8)
        centre = left[np.argmin((sig[left] != common).sum(1))]
        near = (sig[left] != sig[centre]).sum(1) <= most
        for x in left[near].tolist():
            joined.link(x, int(centre))
        left = left[~near]
    rest = joined.apart()
    if len(rest):
        _count_collisions(sig, rest, most, joined)
    return joined.u, joined.v


def _count_collisions(sig: np.ndarray, rest: np.ndarray, most: int, joined: _Joined) -> None:
    """Link each of ``rest`` with all that differ from it in at most ``most`` coordinates, by its shortest coordinate lists."""
    n, width = sig.shape
    order = np.argsort(sig, axis=0, kind="stable")
    size = np.stack([np.bincount(c, minlength=256) for c in sig.T])
    first = np.cumsum(size, axis=1) - size
    each = np.arange(width)
    for x in rest.tolist():
        own = sig[x]
        short = np.argsort(size[each, own], kind="stable")[: min(most + 1, width)]
        lists = [order[first[j, own[j]] : first[j, own[j]] + size[j, own[j]], j] for j in short.tolist() if size[j, own[j]] > 1]
        if not lists:
            continue
        met = np.unique(np.concatenate(lists)) if most < width else np.arange(n)
        met = met[(sig[met] != own).sum(1) <= most]
        for y in met[met != x].tolist():
            joined.link(x, y)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), len(new))


def _signatures(part: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(part["sig"].to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)


def _lists(most: int):
    """Edges between the classes of each list of postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["key"]):
            key, node = (part[k].to_numpy() for k in ("key", "node"))
            sig = _signatures(part)
            edge = _cuts(key)
            start, count = edge[:-1], np.diff(edge)
            twos = start[count == 2]
            twos = twos[(sig[twos] != sig[twos + 1]).sum(1) <= most]
            us, vs = [node[twos + 1]], [node[twos]]
            for a, c in zip(start[count > 2].tolist(), count[count > 2].tolist(), strict=True):
                u, v = list_links(sig[a : a + c], most)
                us.append(node[a + np.array(u, dtype=np.int64)])
                vs.append(node[a + np.array(v, dtype=np.int64)])
            yield table("u:l,v:l", u=np.concatenate(us), v=np.concatenate(vs))

    return run


def set_links(grams: np.ndarray, at: np.ndarray, percent: int, asked: int | None = None) -> tuple[list[int], list[int]]:
    """Spanning links of the documents whose sets reach ``percent`` Jaccard similarity; of the first ``asked`` with all, if given."""
    m, n = len(at) - 1, np.diff(at)
    joined = _Joined(m)
    if m < 2:
        return joined.u, joined.v
    _, token = np.unique(grams, return_inverse=True)
    doc = np.repeat(np.arange(m), n)
    order = np.argsort(token, kind="stable")
    listed = doc[order]
    size = np.bincount(token)
    first = np.concatenate([[0], np.cumsum(size)])

    def alike(x: int) -> np.ndarray:
        own = token[at[x] : at[x + 1]]
        shared = np.zeros(m, dtype=np.int64)
        for a in range(0, len(own), step := max(1, (1 << 21) // m)):
            part = own[a : a + step]
            shared += np.bincount(listed[ragged(first[part], size[part])], minlength=m)
        return (shared > 0) & (100 * shared >= percent * (n + n[x] - shared))

    left = np.ones(m, dtype=bool)
    for _ in range(CENTRES if asked is None else 0):
        if left.sum() < 3:
            break
        held = np.bincount(token[left[doc]], minlength=len(size))
        often = (2 * held > left.sum()).astype(np.int64)
        gain = np.bincount(doc, 2 * often[token] - 1, minlength=m)
        centre = int(np.flatnonzero(left)[np.argmax(gain[left])])
        near = alike(centre)
        for x in np.flatnonzero(near).tolist():
            joined.link(x, centre)
        left &= ~near
    for x in joined.apart().tolist() if asked is None else range(asked):
        for y in np.flatnonzero(alike(x)).tolist():
            joined.link(x, y)
    return joined.u, joined.v


def _sets(part: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of the texts; of rows that repeat an id only those of the class in question count, others are empty."""
    want = part["set_a"].to_numpy()
    sets, lengths = [], []
    for block in blocks(part["text"].combine_chunks()):
        g, at = shingle_sets(block, size)
        other = np.flatnonzero(signed(set_sums(g, at)) != want[block.rows])
        if len(other):
            keep = np.ones(len(g), dtype=bool)
            keep[ragged(at[other], np.diff(at)[other])] = False
            n = np.diff(at)
            n[other] = 0
            g, at = g[keep], np.concatenate([[0], np.cumsum(n)])
        sets.append(g)
        lengths.append(np.diff(at))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])


def _confirm(size: int, percent: int):
    """Links of whole families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["g"]):
            rep = part["id"].to_numpy()
            grams, at = _sets(part, size)
            cut = _cuts(part["g"].to_numpy())
            us, vs = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                u, v = set_links(grams[at[a] : at[b]], at[a : b + 1] - at[a], percent)
                us += [rep[a + x] for x in u]
                vs += [rep[a + x] for x in v]
            yield table("u:l,v:l", u=np.array(us, dtype=np.int64), v=np.array(vs, dtype=np.int64))

    return run


def _central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group's candidates the one nearest to their most common values."""
    for batch in batches:
        heads = []
        for members in batch["members"].to_pylist():
            sig = np.frombuffer(b"".join(m["sig"] for m in members), dtype=np.uint8).reshape(-1, COORDINATES)
            common = np.array([np.bincount(c, minlength=256).argmax() for c in sig.T], dtype=np.uint8)
            heads.append(min((int(d), m["node"]) for d, m in zip((sig != common).sum(1), members, strict=True))[1])
        yield pa.RecordBatch.from_arrays([batch["g"], pa.array(heads, type=pa.int64()), batch["parts"]], names=["g", "head", "parts"])


STAR = "g:l,node:l,u:l,v:l,near:b"


def _list_star(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["g", "i"]):
            g, i, node = (part[k].to_numpy() for k in ("g", "i", "node"))
            sig, cut = _signatures(part), _cuts(g, i)
            head = np.repeat(cut[:-1], np.diff(cut))
            near = (sig != sig[head]).sum(1) <= most
            own = np.flatnonzero(part["kind"].to_numpy() == 1)
            yield table(STAR, g=g[own], node=node[own], u=node[own], v=node[head[own]], near=near[own])

    return run


def _set_star(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["g", "i"]):
            g, i, kind, node, rep = (part[k].to_numpy() for k in ("g", "i", "kind", "node", "id"))
            grams, at = _sets(part, size)
            n, cut = np.diff(at), _cuts(g, i)
            head, shared = np.repeat(cut[:-1], np.diff(cut)), np.zeros(len(g), dtype=np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                first = a + int(np.argmax((kind[a:b] == 0) & (n[a:b] > 0)))
                head[a:b] = first
                hit = np.concatenate([[0], np.cumsum(np.isin(grams[at[a] : at[b]], grams[at[first] : at[first + 1]]))])
                shared[a:b] = hit[at[a + 1 : b + 1] - at[a]] - hit[at[a:b] - at[a]]
            near = 100 * shared >= percent * (n + n[head] - shared)
            own = np.flatnonzero((kind == 1) & (n > 0))
            yield table(STAR, g=g[own], node=node[own], u=rep[own], v=rep[head[own]], near=near[own])

    return run


def _list_rest(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["g", "i", "j"]):
            node, asks, sig = part["id"].to_numpy(), part["kind"].to_numpy() == 0, _signatures(part)
            cut = _cuts(*(part[k].to_numpy() for k in ("g", "i", "j")))
            us, vs = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                joined = _Joined(b - a)
                _count_collisions(sig[a:b], np.flatnonzero(asks[a:b]), most, joined)
                us += [node[a + x] for x in joined.u]
                vs += [node[a + x] for x in joined.v]
            yield table("u:l,v:l", u=np.array(us, dtype=np.int64), v=np.array(vs, dtype=np.int64))

    return run


def _set_rest(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["g", "i", "j"]):
            rep, asks = part["id"].to_numpy(), part["kind"].to_numpy() == 0
            grams, at = _sets(part, size)
            cut = _cuts(*(part[k].to_numpy() for k in ("g", "i", "j")))
            us, vs = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                u, v = set_links(grams[at[a] : at[b]], at[a : b + 1] - at[a], percent, int(asks[a:b].sum()))
                us += [rep[a + x] for x in u]
                vs += [rep[a + x] for x in v]
            yield table("u:l,v:l", u=np.array(us, dtype=np.int64), v=np.array(vs, dtype=np.int64))

    return run


def _sized(df: DataFrame) -> DataFrame:
    """A table of one row a long list or large family, broadcast where it is small."""
    return F.broadcast(df) if df.count() <= HOT else df


def _part(parts: str):
    return F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")


def _all_parts(parts: str):
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def _dealt_out(rows: DataFrame, signatures: DataFrame, limit: int, star, rest) -> DataFrame:
    """Links (u, v) in groups of too many rows (g, node, id, weight, and what ``star`` and ``rest`` read); signatures are (g, node, weight, sig).

    Each part of a group meets the group's centre. Only members that this leaves
    apart are asked for: they meet all others, a part of either in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = signatures.groupBy("g", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SLOTS)).alias("slot"))
    few = slots.agg(F.min(F.struct("node", "sig")).alias("m"), F.sum("weight").alias("weight")).groupBy("g")
    few = few.agg(F.collect_list("m").alias("members"), F.ceil(F.sum("weight") / F.lit(limit)).cast("int").alias("parts"))
    centres = checkpointed(few.mapInArrow(_central, "g long, head long, parts int"))
    parted = rows.join(_sized(centres), "g").withColumn("kind", F.lit(1))
    heads = parted.where("node = head").withColumn("i", _all_parts("parts")).withColumn("kind", F.lit(0))
    met = parted.withColumn("i", _part("parts")).unionByName(heads).drop("head", "parts", "weight")
    stars = met.repartition(n, "g", "i").sortWithinPartitions("g", "i", "kind", "node").mapInArrow(star, "g long, node long, u long, v long, near boolean")
    stars = checkpointed(stars.distinct())
    links = stars.where("near and u <> v").select("u", "v")
    apart = stars.where("not near").select("g", "node")
    if apart.isEmpty():
        return links
    marked = parted.drop("kind").join(apart.withColumn("asks", F.lit(True)), ["g", "node"], "left")
    asking = checkpointed(marked.where("asks").groupBy("g").agg(F.ceil(F.sum("weight") / F.lit(limit)).cast("int").alias("asking")))
    marked = marked.join(_sized(asking), "g")
    asks = marked.where("asks").withColumn("i", _all_parts("parts")).withColumn("j", _part("asking")).withColumn("kind", F.lit(0))
    others = marked.withColumn("i", _part("parts")).withColumn("j", _all_parts("asking")).withColumn("kind", F.lit(1))
    met = asks.unionByName(others).drop("head", "parts", "weight", "asks", "asking")
    return links.union(met.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j", "kind", "node").mapInArrow(rest, "u long, v long"))


def _candidates(classes: DataFrame, most: int) -> DataFrame:
    """Links (u, v) between nodes that connect what pairs of ``least`` collisions or more connect."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def listed(posted: DataFrame) -> DataFrame:
        return posted.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(_lists(most), "u long, v long")

    def long_keys(posted: DataFrame) -> DataFrame:
        return posted.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > LIST_ROWS).select("key")

    posted = classes.select(F.explode(F.slice("keys", 1, most + 1)).alias("key"), "node", "sig")
    long = checkpointed(long_keys(posted))
    if long.isEmpty():
        return listed(posted)
    # a spare key is posted by nodes of long lists alone
    spare = classes.join(posted.join(_sized(long), "key").select("node").distinct(), "node", "left_semi").select(F.explode("keys").alias("key"))
    long = _sized(checkpointed(long.union(long_keys(spare)).distinct()))
    held = classes.select(F.explode("keys").alias("key"), "node").join(long, "key").groupBy("node").agg(F.collect_set("key").alias("long"))
    is_long = F.array_contains("long", F.col("key"))
    last = F.concat(F.filter("keys", lambda k: ~F.array_contains("long", k)), F.filter("keys", lambda k: F.array_contains("long", k)))
    posted = classes.join(held, "node", "left").withColumn("long", F.coalesce("long", F.array().cast("array<long>")))
    posted = checkpointed(posted.select("node", "sig", "long", F.explode(F.slice(last, 1, most + 1)).alias("key")).select("key", "node", "sig", is_long.alias("is_long")))
    rows = posted.where("is_long").select(F.col("key").alias("g"), "node", F.col("node").alias("id"), F.lit(1).alias("weight"), "sig")
    hot = _dealt_out(rows, rows, LIST_ROWS, _list_star(most), _list_rest(most))
    return listed(posted.where("not is_long").select("key", "node", "sig")).union(hot)


def near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80, family_bytes: int = FAMILY_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the link is ``percent`` Jaccard similarity or more.

    Texts are lower-cased (A-Z) and cut into words; the set of a document is its
    distinct shingles of ``shingle_words`` words, or its whole sequence if it has
    fewer. Null and wordless texts have no shingles, link with nothing and are
    their own component, as are rows whose doc_id is null (component null). A doc_id
    is one node: of rows that repeat it, each text brings its own links. No rows in, no rows out.
    Components do not depend on row order or partitioning.
    """
    docs = texts(documents)
    least = least_collisions(percent)
    most = COORDINATES - least
    # two coordinates a key, as long as there are pairs enough for the prefix
    width = 2 if 2 * (most + 1) <= COORDINATES else 1
    schema = "doc_id long, n_shingles long, set_a long, set_b long, sig binary, keys array<long>"
    base = checkpointed(docs.mapInArrow(_signed_batches(shingle_words, COORDINATES // width, width), schema))
    some = base.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "keys")).alias("m")).select("set_a", "set_b", F.col("m.doc_id").alias("rep"), F.col("m.n_shingles").alias("n"), "m.sig", "m.keys")
    same = some.join(classes.select("set_a", "set_b", "rep"), ["set_a", "set_b"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    # a class by one number: should two share it, they only meet as one family more
    classes = classes.withColumn("node", F.xxhash64("set_a", "set_b"))
    family = components(_candidates(classes, most)).withColumnRenamed("component", "g")
    # the bytes of a member's hashes are its weight
    family = family.join(classes.select("node", F.col("rep").alias("id"), "set_a", (8 * F.col("n")).alias("weight"), "sig"), "node")
    large = checkpointed(family.groupBy("g").agg(F.sum("weight").alias("all")).where(F.col("all") > family_bytes).select("g"))

    def members(family: DataFrame) -> DataFrame:
        held = docs.join(family.drop("sig"), docs.doc_id == family.id).withColumn("hash", F.xxhash64("text"))
        return held.dropDuplicates(["id", "set_a", "hash"]).select("g", "node", "id", "set_a", "weight", "text")

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    confirm = _confirm(shingle_words, percent)
    if large.isEmpty():
        met = members(family).repartition(n, "g").sortWithinPartitions("g", "id")
        links = met.mapInArrow(confirm, "u long, v long")
    else:
        large = _sized(large)
        met = members(family.join(large, "g", "left_anti")).repartition(n, "g").sortWithinPartitions("g", "id")
        of_large = checkpointed(family.join(large, "g", "left_semi"))
        hot = _dealt_out(checkpointed(members(of_large)), of_large, family_bytes, _set_star(shingle_words, percent), _set_rest(shingle_words, percent))
        links = met.mapInArrow(confirm, "u long, v long").union(hot)
    found = components(links.union(same))
    return base.join(found, base.doc_id == found.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are not the least doc_id of their component.

    Columns stay as they are. Rows that repeat a kept doc_id, and rows whose
    doc_id is null, stay.
    """
    gone, = unused(documents, "gone")
    found = near_duplicates(documents, shingle_words, percent).where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return documents.join(found, documents["doc_id"].cast("long") == found[gone], "left_anti")


#: DuckDB form of op10's rows (3-word shingles, 85 %); {documents} names the table.
SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM {documents}
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, start, start + 2), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS start FROM texts WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached AS (
  SELECT u AS doc_id, u AS other FROM both_ways UNION SELECT r.doc_id, b.v FROM reached r JOIN both_ways b ON b.u = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, t.doc_id) AS component_id, t.doc_id = coalesce(l.component_id, t.doc_id) AS kept
FROM texts t LEFT JOIN sizes s ON s.doc_id = t.doc_id LEFT JOIN least l ON l.doc_id = t.doc_id
"""
