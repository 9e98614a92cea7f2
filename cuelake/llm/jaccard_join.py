"""N-gram Jaccard self-join with set-relation skipping (operator 8).

A document's set holds its distinct shingles of ``n`` words; with fewer words,
the whole sequence is one shingle; without words (null and empty texts) the
set is empty and links with nothing. Two documents link when
``den * |intersection| >= num * |union|``; the result are the classes of the
links' transitive closure. No pair is lost and none is guessed: candidates come from
prefix lists that every linked pair meets in, and each link is verified on
the whole sets.

How it runs:

1. Equal sets become one node (a 128-bit set hash, its size), so that copies,
   however many, are never compared.
2. Shingles found in many nodes are counted over all nodes; the global order puts them
   after the others, and the prefix of each set goes to inverted lists. A
   passage that many documents share leaves their prefixes that way. Tasks get the common shingles by
   broadcast while they are few, and each set's own by a join beyond that; the prefixes are the same.
3. Answers from a similar set: nodes whose first shingles agree are verified against one hub each;
   a node that is similar to its hub takes over the hub's class, and only answers
   outside of that class are computed for it. Its intersection with another set is the hub's with that set,
   corrected by the shingles in which node and hub differ: the hub's set is sent once, the node's differences alone.
4. Lists are sorted by size and position and cut in blocks with bounds of both; two blocks whose bounds rule
   links out are skipped before any pair is formed. Long lists are cut over tasks and compare parity
   sketches (which never underrate a similarity); of the links that a list
   suggests it gives a spanning forest first, and after those are verified, whatever
   still joins two classes. Pairs from short lists pass the sketches once, before whole sets are sent to be compared.

Ids may be null or repeat: documents are told apart by their sets, a null id
is never a class's id while another is there; ``component_id`` names a class, and where ids are null or repeat
two classes may bear one name, so what keeps a document of each class goes by the internal label. Ties and repeated rows fall
into one node; rows equal in id and text are read once. Very long texts count as a whole. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import BROADCAST_KEYS, arrow_task, connected_components, materialize, restored, sheltered
from cuelake.llm.words import SPACED, Words, mix, words

N, NUM, DEN = 4, 85, 100
#: A shingle of so many nodes or more is common.
COMMON = 32
#: Common shingles (16 bytes each) that are sent to all tasks; more are joined with the sets they are in.
COMMON_SENT = 1_000_000
#: Entries of a list that meet in one task.
BLOCK = 1024
#: First shingles by which a node looks for its hub.
HUB_SHINGLES = 3
#: Members verified against one copy of a hub's set.
SALT = 128
#: Entries of a list whose bounds are kept together.
SPAN = 128

#: Documents whose sets are in a task's memory at once.
ROWS = 256

_SALT2 = np.uint64(0x9FB21C651E98DF25)


def _row_sets(s: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each row of a slice."""
    grams = {k: s.grams(k)[0] for k in range(1, n + 1)}
    for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True):
        k = min(n, b - a)
        yield np.unique(grams[k][a : b - k + 1]) if k else np.zeros(0, np.uint64)


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    for s in words(texts, SPACED):
        yield from _row_sets(s, n)


def _map(df: DataFrame, schema: str, make) -> DataFrame:
    """mapInArrow by ``make(batch) -> dict of arrays``, with the schema's types."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                made = make(whole.slice(first, ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(made[c], t) for c, t in zip(names, types, strict=True)], names=names)

    return df.mapInArrow(arrow_task(run), schema)


def _identified(docs: DataFrame) -> DataFrame:
    """_id and _h tell documents apart (but for equal rows); a null id gives way to the text's hash."""
    h = F.xxhash64("text")
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), h), "_h": h})


def set_signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, _id, _h, n (size of the set), s1, s2 (its hash) of each row."""

    def make(batch: pa.RecordBatch) -> dict:
        sizes, s1, s2 = [], [], []
        for h in _sets(batch.column("text"), n):
            sizes.append(len(h))
            s1.append(int(h.sum(dtype=np.uint64).view(np.int64)))
            s2.append(int(mix(h ^ _SALT2).sum(dtype=np.uint64).view(np.int64)))
        return {"doc_id": batch.column("doc_id"), "_id": batch.column("_id"), "_h": batch.column("_h"), "n": sizes, "s1": s1, "s2": s2}

    rows = _identified(docs.select("doc_id", "text")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return _map(rows, "doc_id long, _id long, _h long, n int, s1 long, s2 long", make)


def _once(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """doc_id, text of docs, rows that are equal in both once."""
    rows = docs.select("doc_id", "text")
    again = signed.groupBy("_id", "_h").count().where("count > 1").select(F.col("_id").alias("_kid"), F.col("_h").alias("_kh"))
    again = materialize(again, "jaccard-repeated")
    if again.isEmpty():
        return rows
    rows = _identified(rows)
    same = (rows["_id"] == again["_kid"]) & (rows["_h"] == again["_kh"])
    one = rows.join(again, same, "left_semi").dropDuplicates(["_id", "_h"])
    return rows.join(again, same, "left_anti").union(one).select("doc_id", "text")


def _by_key(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts of the rows that keys (_id, _h and more) name: by broadcast while
    keys are few, by shuffle beyond."""
    side = keys.withColumnsRenamed({"_id": "_kid", "_h": "_kh"})
    side = F.broadcast(side) if keys.count() <= BROADCAST_KEYS else side
    rows = _identified(docs.select("doc_id", "text"))
    return rows.join(side, (rows["_id"] == side["_kid"]) & (rows["_h"] == side["_kh"])).drop("_kid", "_kh", "_id", "_h", "doc_id")


def _prefix(n: int | np.ndarray, num: int, den: int):
    """Of so many first shingles, a linked set shares one at least."""
    return n + (-n * num) // den + 1


def _cut(num: int, den: int) -> np.uint64:
    """Shingles whose hash is below this come first: twice as many as a prefix
    takes, so that it holds no common shingle unless half of a set's are common."""
    return np.uint64(min(2**64 - 1, 2 * (den - num) * 2**64 // den))


def _first(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of a sorted set the shingles that may be in its prefix."""
    return h[: max(int(np.searchsorted(h, _cut(num, den))), min(len(h), 2 * _prefix(len(h), num, den)))]


def _decisive(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of a sorted set the shingles that decide its prefix: those below the cut, which come before
    all others, or the whole set if they are fewer than a prefix takes."""
    below = int(np.searchsorted(h, _cut(num, den)))
    return h[:below] if below >= _prefix(len(h), num, den) else h


def _common(nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """token, c: the common shingles among those that may be in prefixes, and in how many nodes each is."""

    def make(batch: pa.RecordBatch) -> dict:
        return {"token": np.concatenate([np.zeros(0, np.uint64), *(_first(h, num, den) for h in _sets(batch.column("text"), n))]).view(np.int64)}

    counts = _map(_by_key(docs, nodes.select("_id", "_h")), "token long", make).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") >= COMMON)
    return materialize(counts, "jaccard-common")


def _marked(nodes: DataFrame, docs: DataFrame, common: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """nodes with hot, cuts: the common shingles among those that decide each set's prefix (in order) and their counts."""

    def make(batch: pa.RecordBatch) -> dict:
        sets = [_decisive(h, num, den) for h in _sets(batch.column("text"), n)]
        return {"node": np.repeat(batch.column("node").to_numpy(), [len(h) for h in sets]), "token": np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)}

    held = _map(_by_key(docs, nodes.select("node", "_id", "_h")), "node long, token long", make).join(common, "token")
    held = held.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("token", "c"))).alias("m"))
    return nodes.join(held, "node", "left").withColumns({"hot": F.coalesce(F.col("m.token"), F.array().cast("array<long>")), "cuts": F.coalesce(F.col("m.c"), F.array().cast("array<long>"))}).drop("m")


def _sketch_bytes(n: int) -> int:
    return max(64, 1 << max(0, (n // 2 - 1).bit_length() - 3))


def _sketch(h: np.ndarray) -> bytes:
    bits = 8 * _sketch_bytes(len(h))
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _in_order(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes as they are sorted in sets, and their counts."""
    tokens = tokens.view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _prefixes(nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, n, tokens (the prefix, in the global order), blocks (for each of them, in how many its list is
    cut; 0: not common), hot (a token is common), sketch."""
    first, common = _cut(num, den), _common(nodes, docs, n, num, den)
    sent = common.count() <= COMMON_SENT
    if sent:
        held = common.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(_in_order(held["token"].to_numpy(), held["c"].to_numpy()))
    else:
        nodes, shared = _marked(nodes, docs, common, n, num, den), None

    def make(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"node": batch.column("node"), "n": [], "tokens": [], "blocks": [], "hot": [], "sketch": []}
        for k, h in enumerate(_sets(batch.column("text"), n)):
            tokens, counts = shared.value if sent else _in_order(*(np.array(batch.column(c)[k].as_py(), np.int64) for c in ("hot", "cuts")))
            blocks = np.zeros(len(h), np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
                blocks = np.where(tokens[at] == h, -(-counts[at] // BLOCK), 0)
            order = np.argsort((h >= first) * 2 + (blocks > 0), kind="stable")[: _prefix(len(h), num, den)]
            out["n"].append(len(h))
            out["tokens"].append(h[order].view(np.int64))
            out["blocks"].append(blocks[order])
            out["hot"].append(int((blocks[order] > 0).any()))
            out["sketch"].append(_sketch(h))
        return out

    rows = _by_key(docs, nodes.select("node", "_id", "_h", *([] if sent else ["hot", "cuts"])))
    return materialize(_map(rows, "node long, n int, tokens array<long>, blocks array<long>, hot int, sketch binary", make), "jaccard-prefixes")


def _shared(small: np.ndarray, large: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (small, large) if len(small) <= len(large) else (large, small)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int, members: DataFrame | None = None) -> DataFrame:
    """Of distinct pairs (a, b) those that link, with the shingles of b that a has not (plus) and of a that b has not (minus).

    Whole sets meet in a task: that of a, once for each SALT of its partners, and that of each base. The base of b is b itself, or,
    for members (b with its hub a, plus and minus, as found before), the hub: then b's
    intersection with a is the base's, and what plus adds and minus takes away."""
    pairs = materialize(pairs, "jaccard-pairs")
    if pairs.isEmpty():
        return pairs.withColumns({"plus": F.lit(None).cast("binary"), "minus": F.lit(None).cast("binary")})
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("s"))
    asked = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("salt"))
    no, empty = F.lit(None).cast("long"), F.lit(b"")
    if members is None:
        asked = asked.withColumns({"base": F.col("b"), "plus": empty, "minus": empty})
    else:
        by_hub = members.select(F.col("a").alias("_hub"), F.col("b").alias("_b"), "plus", "minus")
        asked = asked.join(by_hub, F.col("b") == F.col("_b"), "left")
        asked = asked.select("a", "b", "salt", F.coalesce("_hub", "b").alias("base"), F.coalesce("plus", empty).alias("plus"), F.coalesce("minus", empty).alias("minus"))
    asked = materialize(asked, "jaccard-asked")
    bases = asked.select("a", "salt", "base").distinct().select("a", "salt", "base", F.col("base").alias("node"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("salt"), no.alias("base"), F.col("a").alias("node"))
    keys = materialize(bases.union(hubs).join(nodes.select("node", "_id", "_h"), "node"), "jaccard-keys")

    def sets(batch: pa.RecordBatch) -> dict:
        return {"a": batch.column("a"), "salt": batch.column("salt"), "base": batch.column("base"), "plus": [h.tobytes() for h in _sets(batch.column("text"), n)]}

    whole = _map(_by_key(docs, keys), "a long, salt int, base long, plus binary", sets)
    rows = whole.select("a", "salt", "base", no.alias("b"), "plus", F.lit(None).cast("binary").alias("minus"))
    rows = rows.union(asked.select("a", "salt", "base", "b", "plus", "minus"))
    # the set of a, and then each base's before those that are told by it
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("base"), F.asc_nulls_first("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = base = np.zeros(0, np.uint64)
        both = 0
        for batch in batches:
            is_a, is_set = batch.column("base").is_null().to_pylist(), batch.column("b").is_null().to_pylist()
            plus, minus = batch.column("plus"), batch.column("minus")
            took: list[tuple[int, bytes, bytes]] = []
            for k in range(batch.num_rows):
                h = np.frombuffer(plus[k].as_buffer(), np.uint64)
                if is_a[k]:
                    own = h
                elif is_set[k]:
                    base, both = h, _shared(h, own)
                else:
                    less = np.frombuffer(minus[k].as_buffer(), np.uint64)
                    shared = both + _shared(h, own) - _shared(less, own)
                    size = len(base) + len(h) - len(less)
                    if den * shared >= num * (len(own) + size - shared):
                        b = base if not len(h) and not len(less) else np.union1d(np.setdiff1d(base, less, assume_unique=True), h)
                        took.append((k, np.setdiff1d(b, own, assume_unique=True).tobytes(), np.setdiff1d(own, b, assume_unique=True).tobytes()))
            at = pa.array([k for k, *_ in took], pa.int64())
            made = [batch.column("a").take(at), batch.column("b").take(at), pa.array([x for _, x, _ in took], pa.binary()), pa.array([x for *_, x in took], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["a", "b", "plus", "minus"])

    return materialize(rows.mapInArrow(arrow_task(check), "a long, b long, plus binary, minus binary"), "jaccard-links")


def _plausible(pairs: DataFrame, prefixes: DataFrame, num: int, den: int) -> DataFrame:
    """pairs (a, b) without those that sizes or sketches rule out."""
    own = prefixes.select("node", "n", "sketch").distinct()
    rows = pairs.join(own.withColumnsRenamed({"node": "a", "n": "na", "sketch": "sa"}), "a").join(own.withColumnsRenamed({"node": "b", "n": "nb", "sketch": "sb"}), "b")
    rows = rows.where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num)).select("a", "b", "na", "nb", "sa", "sb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            size = np.minimum([len(x) for x in sa], [len(x) for x in sb])
            odd = np.zeros(len(n), np.int64)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                odd[at] = np.bitwise_count(_folded([sa[i] for i in at], int(k)) ^ _folded([sb[i] for i in at], int(k))).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(odd <= n - 2 * -((-num * n) // (num + den))))

    return rows.mapInArrow(arrow_task(keep), "a long, b long")


def _hub_pairs(prefixes: DataFrame) -> DataFrame:
    """Each node with at most one hub: the least node among those of about its
    size that share one of its first shingles."""
    band = F.floor(F.log(F.col("n").cast("double")) * 4).cast("int")
    first = prefixes.select("node", band.alias("band"), F.explode(F.slice("tokens", 1, HUB_SHINGLES)).alias("token"))
    hubs = first.groupBy("token", "band").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    votes = first.join(hubs, ["token", "band"]).where("a < node").groupBy("node", "a").agg(F.count("*").alias("v"))
    return votes.groupBy("node").agg(F.min(F.struct(-F.col("v"), "a"))["a"].alias("a")).select("a", F.col("node").alias("b"))


def _entries(prefixes: DataFrame, classes: DataFrame) -> DataFrame:
    """token, pair (of blocks), own (block), node, class, n, pos, sketch: an
    entry for each shingle of a prefix, and list or pair of blocks of its list."""
    rows = prefixes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    rows = rows.select("node", "class", "n", "sketch", F.posexplode(F.arrays_zip("tokens", "blocks")).alias("pos", "e"))
    rows = rows.select("node", "class", "n", "pos", F.col("e.tokens").alias("token"), F.col("e.blocks").alias("blocks"), F.when(F.col("e.blocks") > 0, F.col("sketch")).alias("sketch"))
    rows = rows.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1)))).otherwise(0).cast("int"))
    own = F.col("own").cast("long")
    other = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pair = F.transform(other, lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    return rows.withColumn("pair", F.explode(F.when(F.col("blocks") <= 1, F.array(F.lit(0).cast("long"))).otherwise(pair))).drop("blocks")


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(sketches), size // 8), np.uint64)
    for k, x in enumerate(sketches):
        words64 = np.frombuffer(x, np.uint64)
        while len(words64) > size // 8:
            half = len(words64) // 2
            words64 = words64[:half] ^ words64[half:]
        out[k] = words64
    return out


def _met(n: np.ndarray, pos: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, c, d): entries a..b and c..d of a list, in its order, that may link. Blocks of SPAN entries whose bounds of
    size and position rule that out are skipped."""
    cut = np.arange(0, len(n), SPAN)
    ends = np.append(cut[1:], len(n))
    low, high = np.minimum.reduceat(n, cut), np.maximum.reduceat(n, cut)
    far, rest = np.maximum.reduceat(pos, cut), np.maximum.reduceat(n - pos, cut)
    need = -((-num * (low[:, None] + low)) // (num + den))
    may = (np.minimum(far[:, None], far) + np.minimum(rest[:, None], rest) >= need) & (num * low[:, None] <= den * high) & (num * low <= den * high[:, None])
    for i, j in zip(*np.nonzero(np.triu(may)), strict=True):
        yield int(cut[i]), int(ends[i]), int(cut[j]), int(ends[j])


def _similar_sketches(i: np.ndarray, j: np.ndarray, n: np.ndarray, sketches: list, num: int, den: int) -> np.ndarray:
    """Which pairs (i, j) of entries their sketches do not rule out."""
    most_odd = n[i] + n[j] - 2 * -((-num * (n[i] + n[j])) // (num + den))
    ok = np.zeros(len(i), bool)
    sizes = np.array([len(s) for s in sketches])
    smaller = np.minimum(sizes[i], sizes[j])
    for size in np.unique(smaller):
        at = np.flatnonzero(smaller == size)
        used = np.unique(np.concatenate([i[at], j[at]]))
        flat = _folded([sketches[k] for k in used], int(size))
        odd = np.bitwise_count(flat[np.searchsorted(used, i[at])] ^ flat[np.searchsorted(used, j[at])]).sum(1)
        ok[at] = odd <= most_odd[at]
    return ok


def _list_pairs(node: np.ndarray, group: np.ndarray, n: np.ndarray, pos: np.ndarray, own: np.ndarray, sketches: list | None, num: int, den: int, forest: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one list that may link and are of two classes."""
    out = []
    group, apart = group.copy(), (own != own[0]).any()  # two blocks: pairs inside one of them meet elsewhere
    if len(n) > SPAN:  # entries of about one size by position, so that blocks have close bounds
        order = np.lexsort((n, pos, np.floor(np.log(n) * (2 / np.log(den / num)))))
        node, group, n, pos, own = node[order], group[order], n[order], pos[order], own[order]
        sketches = [sketches[k] for k in order] if sketches is not None else None
    for a, b, c, d in _met(n, pos, num, den):
        if (group[a:b] == group[a]).all() and (group[c:d] == group[a]).all():
            continue
        x, y = slice(a, b), slice(c, d)
        need = -((-num * (n[x, None] + n[None, y])) // (num + den))
        most = np.minimum(pos[x, None], pos[None, y]) + np.minimum((n[x] - pos[x])[:, None], (n[y] - pos[y])[None, :])
        may = (most >= need) & (num * n[None, y] <= den * n[x, None]) & (num * n[x, None] <= den * n[None, y]) & (group[x, None] != group[None, y])
        if a == c:
            may = np.triu(may, 1)
        if apart:
            may &= own[x, None] != own[None, y]
        i, j = np.nonzero(may)
        i, j = i + a, j + c
        if sketches is not None and len(i):
            ok = _similar_sketches(i, j, n, sketches, num, den)
            i, j = i[ok], j[ok]
            if forest and len(i):
                keep_i, keep_j = [], []
                starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                for s, e in zip(starts, np.r_[starts[1:], len(i)], strict=True):
                    mine, partners = i[s], j[s:e]
                    other, where = np.unique(group[partners], return_index=True)
                    new = other != group[mine]
                    if new.any():
                        keep_i += [mine] * int(new.sum())
                        keep_j += partners[where[new]].tolist()
                        group[np.isin(group, other[new])] = group[mine]
                i, j = np.array(keep_i, np.int64), np.array(keep_j, np.int64)
        if len(i):
            out.append((node[i], node[j]))
    return out


def _list_candidates(entries: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Distinct pairs a < b of nodes that lists suggest."""
    rows = entries.repartition("token", "pair").sortWithinPartitions("token", "pair", "n", "pos", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(found: list) -> pa.RecordBatch:
            x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            key = _starts(held)
            if len(key) > 1:
                yield pairs(_lists(held.slice(0, int(key[-1])), num, den, forest))
                held = held.slice(int(key[-1]))
        if held is not None and held.num_rows:
            yield pairs(_lists(held, num, den, forest))

    return rows.select("token", "pair", "own", "node", "class", "n", "pos", "sketch").mapInArrow(arrow_task(scan), "a long, b long").distinct()


def _starts(table: pa.Table) -> np.ndarray:
    """Where another list begins."""
    token, pair = table["token"].to_numpy(), table["pair"].to_numpy()
    return np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (pair[1:] != pair[:-1])]) if len(token) else np.zeros(0, np.int64)


def _lists(table: pa.Table, num: int, den: int, forest: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    starts = _starts(table)
    ends = np.r_[starts[1:], table.num_rows].astype(np.int64)
    node, group = table["node"].to_numpy(), table["class"].to_numpy()
    n, pos = table["n"].to_numpy().astype(np.int64), table["pos"].to_numpy().astype(np.int64)
    own = table["own"].to_numpy()
    out, sketch = [], table["sketch"].combine_chunks()
    long = ends - starts > 2
    two = starts[ends - starts == 2]
    if len(two):  # lists of two, the most by far, all at once
        need = -((-num * (n[two] + n[two + 1])) // (num + den))
        most = np.minimum(pos[two], pos[two + 1]) + np.minimum(n[two] - pos[two], n[two + 1] - pos[two + 1])
        two = two[(most >= need) & (num * n[two + 1] <= den * n[two]) & (group[two] != group[two + 1]) & (node[two] != node[two + 1])]
        out.append((node[two], node[two + 1]))
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        sketches = sketch.slice(a, b - a).to_pylist() if sketch[a].is_valid else None
        out += _list_pairs(node[a:b], group[a:b], n[a:b], pos[a:b], own[a:b], sketches, num, den, forest)
    return out


def _classes(links: DataFrame) -> DataFrame:
    return connected_components(links).select("node", F.col("component").alias("class"))


def similarity_classes(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs (doc_id, text) to doc_id, _id, _h, n_shingles, component_id, class: a row
    for each document; component_id is the smallest doc_id of its class. Where ids
    are null or repeat, classes may share it; ``class`` tells them apart (null: no words)."""
    signed = materialize(set_signatures(docs, n), "jaccard-signatures")
    docs = _once(docs, signed)
    # sets that small only link with equal ones
    own = signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("_id", "_h")).alias("r"), F.min("doc_id").alias("least"))
    nodes = materialize(own.select("n", "s1", "s2", "least", F.col("r._id").alias("_id"), F.col("r._h").alias("_h"), F.monotonically_increasing_id().alias("node")), "jaccard-nodes")
    able = nodes.where(F.col("n") * (den - num) >= num)
    prefixes = _prefixes(able, docs, n, num, den)

    members = _verified(_plausible(_hub_pairs(prefixes), prefixes, num, den), able, docs, n, num, den)
    links = members.select("a", "b")
    classes = _classes(links)
    for forest in (True, False):
        # what is not common needs no second look: its lists gave every pair
        rows = prefixes if forest else prefixes.where("hot = 1")
        if rows.isEmpty():
            break
        entries = _entries(rows, classes)
        found = _list_candidates(entries if forest else entries.where("sketch is not null"), num, den, forest)
        links = links.union(_verified(_plausible(found, prefixes, num, den), able, docs, n, num, den, members).select("a", "b"))
        classes = _classes(links)
    labels = nodes.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    labels = materialize(labels, "jaccard-labels")
    least = labels.groupBy("class").agg(F.min("least").alias("component_id"))
    place = labels.join(least, "class").select(F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "component_id", "class")
    out = signed.join(place, (signed["n"] == place["_n"]) & (signed["s1"] == place["_s1"]) & (signed["s2"] == place["_s2"]), "left")
    return out.select("doc_id", "_id", "_h", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class")


def jaccard_report(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return similarity_classes(docs, n, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each class: that of the smallest id (of rows
    that share it, the one with the smallest text hash, once). Documents
    without words all stay."""
    classes = materialize(similarity_classes(docs, n, num, den), "jaccard-classes")
    linked = classes.where("n_shingles > 0")
    first = linked.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "_id", "_h")).alias("r"))
    chosen = first.select(F.col("r._id").alias("_kid"), F.col("r._h").alias("_kh"))
    kept = materialize(chosen.union(classes.where("n_shingles = 0").select("_id", "_h")).distinct(), "jaccard-kept")
    side = F.broadcast(kept) if kept.count() <= BROADCAST_KEYS else kept
    rows = _identified(sheltered(docs, "doc_id", "text"))
    rows = rows.join(side, (rows["_id"] == side["_kid"]) & (rows["_h"] == side["_kh"]), "left_semi")
    # rows with words that are equal in id and text: one of them stays
    again = linked.groupBy("_id", "_h").count().where("count > 1").select(F.col("_id").alias("_kid"), F.col("_h").alias("_kh"))
    again = materialize(again, "jaccard-again")
    if again.isEmpty():
        return restored(rows, docs, "doc_id", "text")
    same = (rows["_id"] == again["_kid"]) & (rows["_h"] == again["_kh"])
    one = rows.join(again, same, "left_semi").dropDuplicates(["_id", "_h"])
    return restored(rows.join(again, same, "left_anti").union(one), docs, "doc_id", "text")
