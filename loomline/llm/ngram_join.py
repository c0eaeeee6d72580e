"""Exact Jaccard join of word-shingle sets by prefix filter and prefix trees.

1. Each text becomes its set of hashed shingles. Tasks deal the shingles to buckets, in packed arrays; a bucket counts in how
   many sets each shingle is and sends back those that are in two sets or more, with that count.
2. The global order of shingles is (count, shingle), rare ones first. Two sets that reach the threshold share a shingle
   among the first n - ceil(t * n) + 1 of either; shingles of one set only can't be shared, so a set with fewer
   than t * n others has no partner. All else is proven to have none without comparing it.
3. Sets that share such a shingle are candidates if their sizes and the places of the shingle allow enough overlap. Each
   shingle's candidates are first compared with one leader only; those that are then in one component need no further
   comparison for the components. What is left after a few leaders is compared in full.
4. The candidates of a set form a prefix tree over the ordered sets. One walk carries the overlap so far down the tree, so
   common beginnings are compared once, and leaves a subtree when the rest of it can't reach the overlap needed.

Equal sets are one class (documents, not classes, are listed in the result). Components grow by contraction of the new links.

Defined cases: a text without words has an empty set and is linked with nothing; a text of fewer than five words is
one shingle; documents of one id are one node; a null id gets the component of its class, null if no document of
it has an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.components import contracted
from loomline.session import discard, materialize, materialize_some, shuffle_width

WORDS, PERCENT = 5, 75
CHUNK_SHINGLES, CHUNK_DOCS = 1_500_000, 16_000
WORD_CACHE = 300_000
STAR_ROUNDS = 4
GROUP = 512
FRAGMENT = 6  # bytes of a shingle's hash beside its bucket


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_word_hash = _WordHash()


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    found = (text or "").encode().lower().split()  # bytes: lower and split know ASCII only
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_word_hash.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    count = len(found) - width + 1
    h = np.full(count, width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + count]
        h ^= h >> np.uint64(29)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ h >> np.uint64(31))


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :FRAGMENT]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // FRAGMENT, 8), np.uint8)
    wide[:, :FRAGMENT] = np.frombuffer(data, np.uint8).reshape(-1, FRAGMENT)
    return wide.view("<u8").ravel()


def _counts(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    counts = np.frombuffer(zlib.decompress(data), "<u4")
    return np.repeat(np.arange(len(counts)), counts)


class _Chunk:
    """Sets of some documents, equal sets once."""

    def __init__(self):
        self.docs: list[tuple[int | None, int]] = []
        self.classes: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, hashes: np.ndarray) -> None:
        key = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
        if key not in self.classes:
            self.classes[key] = len(self.sets)
            self.sets.append(hashes)
            self.size += len(hashes)
        self.docs.append((doc_id, self.classes[key]))

    def rows(self, chunk: int, buckets: int) -> Iterator[pa.RecordBatch]:
        sizes = [len(s) for s in self.sets]
        shingles = np.concatenate(self.sets)
        self.sets = []  # the sets are not needed beside the one array
        shingles %= np.uint64(buckets << 8 * FRAGMENT)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        bucket = (shingles % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        keys = list(self.classes)
        docs = [{"doc_id": d, "key": keys[c], "n": sizes[c]} for d, c in self.docs]
        home = ((chunk >> 24) + chunk) % buckets  # this bucket hands on the table of documents
        shingles //= np.uint64(buckets)
        for b in range(buckets):
            own = order[ends[b]:ends[b + 1]]
            if len(own) or b == home:
                yield pa.RecordBatch.from_pylist([{
                    "bucket": b, "chunk": chunk, "counts": _counts(np.bincount(owner[own], minlength=len(sizes))),
                    "shingles": _pack(shingles[own]), "docs": docs if b == home else None}], schema=_DEALT)


_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64())]))
_DEALT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()), ("shingles", pa.binary()), ("docs", _DOCS)])
_SHARED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()), ("shingles", pa.binary()), ("held", pa.binary()), ("docs", _DOCS)])
_SETS = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("shared", pa.binary()), ("prefix", pa.list_(pa.int64())), ("weight", pa.float64())])
_DOCS_DDL = "docs array<struct<doc_id:long,key:binary,n:long>>"


def _shared_of(table: pa.Table) -> pa.Table:
    """Of one bucket: each chunk's shingles that are in two sets or more, and in how many."""
    rows = table.to_pylist()
    ends = np.cumsum([0, *(len(r["shingles"]) // FRAGMENT for r in rows)])
    values = np.empty(ends[-1], np.uint64)
    for i, r in enumerate(rows):
        values[ends[i]:ends[i + 1]] = _unpack(r["shingles"])
        r["shingles"] = None
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(values) else np.empty(0, np.int64)
    del ordered
    runs = np.diff(np.r_[starts, len(values)])
    held = np.empty(len(values), np.uint16)
    held[order] = np.repeat(np.minimum(runs, 65535).astype(np.uint16), runs)
    del order, starts, runs
    out = []
    for i, r in enumerate(rows):
        mine = held[ends[i]:ends[i + 1]]
        keep = mine > 1
        if keep.any() or r["docs"] is not None:
            sets = len(zlib.decompress(r["counts"])) // 4
            out.append({"bucket": r["bucket"], "chunk": r["chunk"], "docs": r["docs"], "shingles": _pack(values[ends[i]:ends[i + 1]][keep]),
                        "counts": _counts(np.bincount(_spread(r["counts"])[keep], minlength=sets)),
                        "held": mine[keep].astype("<u2").tobytes()})
    return pa.Table.from_pylist(out, schema=_SHARED)


def _sets_of(buckets: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one chunk: its documents, and the ordered shared shingles of sets that can have a partner."""
        rows = table.to_pylist()
        docs = next(r["docs"] for r in rows if r["docs"] is not None)
        place: dict[bytes, int] = {}
        size: list[int] = []
        first: list[int] = []
        for i, d in enumerate(docs):
            c = place.setdefault(d["key"], len(place))
            if c == len(size):
                size.append(d["n"])
                first.append(i)
            elif d["doc_id"] is not None and (docs[first[c]]["doc_id"] is None or d["doc_id"] < docs[first[c]]["doc_id"]):
                first[c] = i
        owner = np.concatenate([_spread(r["counts"]) for r in rows])
        shingle = np.concatenate([_unpack(r["shingles"]) * np.uint64(buckets) + np.uint64(r["bucket"]) for r in rows]).astype(np.int64)
        held = np.concatenate([np.frombuffer(r["held"], "<u2") for r in rows])
        sizes = np.array(size, np.int64)
        shared = np.bincount(owner, minlength=len(sizes))
        able = (sizes > 0) & (100 * shared >= percent * sizes)
        keep = able[owner]
        owner, shingle, held = owner[keep], shingle[keep], held[keep]
        order = np.lexsort((shingle, held, owner))
        owner, shingle, held = owner[order], shingle[order], held[order]
        ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
        out = [{"doc_id": d["doc_id"], "key": d["key"], "n": d["n"]} for d in docs]
        for c in np.flatnonzero(able):
            own, n = shingle[ends[c]:ends[c + 1]], size[c]
            length = n + (-percent * n) // 100 + 1 - (n - len(own))
            if length > 0:
                out[first[c]] |= {"shared": own.tobytes(), "prefix": own[:length], "weight": float(held[ends[c]:ends[c + 1]].sum()) / n}
        return pa.Table.from_pylist(out, schema=_SETS)
    return run


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, key, n, shared, prefix, weight) of every document; the last three only for one document of a set that may have a partner."""
    buckets = min(shuffle_width(docs.sparkSession), 1 << 15)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def deal(batches):
        part, made, chunk = TaskContext.get().partitionId(), 0, _Chunk()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                chunk.add(doc.as_py(), shingle_hashes(text.as_py(), words))
                if chunk.size >= CHUNK_SHINGLES or len(chunk.docs) >= CHUNK_DOCS:
                    yield from chunk.rows(part << 24 | made, buckets)
                    made, chunk = made + 1, _Chunk()
        if chunk.docs:
            yield from chunk.rows(part << 24 | made, buckets)

    dealt = picked.mapInArrow(deal, f"bucket int, chunk long, counts binary, shingles binary, {_DOCS_DDL}")
    shared = dealt.groupBy("bucket").applyInArrow(_shared_of, f"bucket int, chunk long, counts binary, shingles binary, held binary, {_DOCS_DDL}")
    return shared.groupBy("chunk").applyInArrow(
        _sets_of(buckets, percent), "doc_id long, key binary, n long, shared binary, prefix array<long>, weight double")


class PrefixTree:
    """Ordered sets as a tree of runs; common beginnings are stored once."""

    def __init__(self, sets: list[tuple[int, int, list[int]]]):
        """``sets``: (id, size, ordered members that other sets have too)."""
        self.sets = sorted(sets, key=lambda s: s[2])
        self.root = self._node(0, len(self.sets), 0) if sets else None

    def _node(self, low: int, high: int, depth: int) -> tuple:
        """(run, ids that end here, children, least size, most members left below the run)."""
        a, b = self.sets[low][2], self.sets[high - 1][2]
        end, most = depth, min(len(a), len(b))
        while end < most and a[end] == b[end]:
            end += 1
        run, at = a[depth:end], low
        while at < high and len(self.sets[at][2]) == end:
            at += 1
        done, children = self.sets[low:at], []
        while at < high:
            head, to = self.sets[at][2][end], at + 1
            while to < high and self.sets[to][2][end] == head:
                to += 1
            children.append(self._node(at, to, end))
            at = to
        own = self.sets[low:high]
        return run, [(s[0], s[1]) for s in done], children, min(s[1] for s in own), max(len(s[2]) for s in own) - end

    def partners(self, members: list[int], size: int, percent: int = PERCENT) -> Iterator[int]:
        """Ids of sets whose Jaccard index with the given one reaches the threshold."""
        query, stack = set(members), [(self.root, 0)] if self.root else []
        while stack:
            (run, done, children, least, below), overlap = stack.pop()
            overlap += len(query.intersection(run))
            for other, n in done:
                if 100 * overlap >= percent * (size + n - overlap):
                    yield other
            # the most that the rest of the subtree can add
            best = overlap + min(below, len(query) - overlap)
            if children and (100 + percent) * best >= percent * (size + least):
                stack.extend((c, overlap) for c in children)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, bool]:
    """(src, dst) of the pairs (a, b) whose sets reach the threshold, written, and whether there are any; a set is compared
    with one tree of its candidates."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n"))
    salted = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / GROUP)).alias("salt"))
    salted = materialize(salted, "pairs")
    own = sets.select(F.col("doc_id").alias("_id"), "n", "shared")
    heads = salted.select("a", "salt").distinct().join(own, F.col("a") == F.col("_id")).select("a", "salt", F.lit(0).alias("side"), "_id", "n", "shared")
    tails = salted.join(own, F.col("b") == F.col("_id")).select("a", "salt", F.lit(1).alias("side"), "_id", "n", "shared")
    grouped = heads.unionByName(tails).repartition(shuffle_width(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "side")

    def compare(batches):
        key, queries, held = None, [], []

        def links():
            # the tree has the most frequent shingles at its root, where sets share them
            tree = PrefixTree([(i, n, m[::-1].tolist()) for i, n, m in held])
            found = [(q, other) for q, n, m in queries for other in tree.partners(m.tolist(), n, percent)]
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["src", "dst"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["a"], r["salt"]) != key:
                    yield from links()
                    key, queries, held = (r["a"], r["salt"]), [], []
                (held if r["side"] else queries).append((r["_id"], r["n"], np.frombuffer(r["shared"], np.int64)))
        yield from links()

    found = materialize_some(grouped.mapInArrow(compare, "src long, dst long"), "links")
    discard(salted)
    return found


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                             percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    all_sets = materialize(shingle_sets(docs, id_col, text_col, words, percent), "sets")
    classes = all_sets.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    sets = all_sets.filter("prefix IS NOT NULL").join(classes, "key").filter("doc_id = rep")
    sets = materialize(sets.select("doc_id", "n", "shared", "prefix", "weight"), "classes")
    shared = (F.octet_length("shared") / 8).cast("int")
    # a place counts from the end of the ordered set: how many members follow
    entries = sets.select("doc_id", "n", "weight", shared.alias("_m"), F.posexplode("prefix").alias("_i", "shingle"))
    entries = entries.select("shingle", "doc_id", "n", "weight", (F.col("_m") - F.col("_i") - 1).alias("rest"))
    shares = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select("shingle")
    entries = materialize(entries.join(shares, "shingle", "left_semi"), "entries")
    nodes = entries.select(F.col("doc_id").alias("id")).distinct()

    def fits(n, rest, other_n, other_rest):
        best = F.least(rest, other_rest) + 1
        return ((100 * F.least(n, other_n) >= percent * F.greatest(n, other_n))
                & ((100 + percent) * best >= percent * (n + other_n)))

    label = materialize(nodes.select("id", F.col("id").alias("component")), "label")
    for turn in range(STAR_ROUNDS + 1):
        now = entries.join(label, F.col("doc_id") == F.col("id")).drop("id")
        rank = F.col("weight") if turn == 0 else F.xxhash64("doc_id", F.lit(turn)).cast("double")
        groups = now.groupBy("shingle").agg(F.min("component").alias("_a"), F.max("component").alias("_b"),
                                            F.max(F.struct(rank.alias("w"), "doc_id", "n", "rest", "component")).alias("lead")).filter("_a < _b")
        if turn < STAR_ROUNDS:
            lead = F.col("lead")
            pairs = now.join(groups, "shingle").filter(F.col("component") != lead["component"]).filter(
                fits(F.col("n"), F.col("rest"), lead["n"], lead["rest"])).select(lead["doc_id"].alias("a"), F.col("doc_id").alias("b"))
        else:
            left = now.join(groups.select("shingle"), "shingle", "left_semi")
            right = left.select("shingle", *[F.col(c).alias(f"_{c}") for c in ("doc_id", "n", "rest", "component")])
            pairs = left.join(right, "shingle").filter("doc_id < _doc_id AND component <> _component").filter(
                fits(F.col("n"), F.col("rest"), F.col("_n"), F.col("_rest"))).select(F.col("doc_id").alias("a"), F.col("_doc_id").alias("b"))
        pairs, any_pair = materialize_some(pairs.distinct(), "candidates")
        if any_pair:
            found, any_link = _verified(pairs, sets, percent)
            if any_link:
                label = contracted(label, found)
            discard(found)
        discard(pairs)
    # what follows needs no sets; they would stay on disk as long as the result is read
    narrow = materialize(all_sets.select("doc_id", "n", "key"), "keys")
    discard(all_sets, sets, entries)
    all_sets = narrow
    classes = all_sets.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    joined = all_sets.select(F.col("doc_id").alias("_doc"), "n", "key").join(classes, "key", "left")
    joined = joined.join(label, F.col("rep") == F.col("id"), "left")
    return joined.select(F.col("_doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                         F.when(F.col("n") == 0, F.col("_doc")).otherwise(F.coalesce("component", "rep")).alias("component_id"))


def oracle() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS h FROM d),
s AS MATERIALIZED (SELECT doc_id, len(h) AS n, unnest(h) AS g FROM h),
link AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2) WHERE 100 * c >= 75 * (n + m - c)),
adj AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
r(id, node) AS (SELECT DISTINCT x, x FROM adj UNION SELECT r.id, adj.y FROM r JOIN adj ON adj.x = r.node)
SELECT h.doc_id, len(h) AS n_shingles, coalesce(c.component, h.doc_id) AS component_id
FROM h LEFT JOIN (SELECT id, min(node) AS component FROM r GROUP BY 1) c ON c.id = h.doc_id"""
