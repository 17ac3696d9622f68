"""Near-duplicate documents by ProbMinHash, banding and exact verification.

A document is a weighted set: its shingles of five words (lower case, split at
white space), weighted by 1 + ln(count) / 2.  Every shingle is a Poisson
process whose rate is its weight; its arrivals fall into registers at random,
and each register keeps the first arrival's shingle.  Two documents' registers
agree with their probability Jaccard similarity.  All shingles of a batch of
documents draw their first arrivals, then those still below their document's
slowest register draw their next, and so on: that is the early termination.
With unit weights, probability Jaccard is the plain Jaccard similarity of the
sets.  So each document has two signatures, by unit weights and by its own;
they differ only where a text repeats a shingle.  Both are banded and compared:
what is missed has a bound that follows from the links' own measure, however
often texts repeat what they share.

Two documents are linked if the Jaccard similarity of their shingle sets
reaches ``threshold``.  (With plain counts as weights, documents that have
nothing in common but one line repeated hundreds of times would be alike;
hence the damped weights, and the verification on sets.)

1. One pass over the texts: content hash, bands and, of each register, four
   bits.  Equal word sequences meet by a 128-bit content hash and go on as one.
2. Bands of registers are buckets.  Each member of a bucket is compared with
   the bucket's least member only, so a bucket of n has n - 1 candidates.
   Those whose registers agree enough are verified on the texts, gathered round
   the least member in groups of bounded size; links become components.
3. Where a bucket still holds several components, members outside its largest
   one are compared with the members of other components by their registers,
   block against block inside tasks.  A spanning forest of the pairs that agree
   enough joins components to families; every such pair is within a family.
4. Inside each family, members outside the largest component are compared with
   all others on their texts, again block against block, likeliest pairs first
   and passing over pairs that verified links have connected meanwhile.  So no
   pair that shares a bucket is passed over, however large the bucket, and no
   list of all pairs is written.

Four bits of a register agree wherever the register does, so what they pass
holds all that whole registers would.  Only texts of candidates are shuffled:
a filter of bounded size on their keys goes over the documents first.

Defined results: documents are told apart by doc_id (null ids too) and text (by
128 bits of both), and unlike texts of one id don't join their classes.  A class is named by its least
doc_id, null only if none of its documents has an id; each document gives its
(doc_id, class_id), alike ones once.  Documents without words (null, empty,
blank) are classes of their own; those of fewer than five words have one
shingle, all their words; extra columns go no further; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotlens.llm.common import arrays_to_batch, batch_rows, discard, forget_vocabularies, lasting, release_memory, slices, small_batches, stored, temporary, text_of

WORDS = 5
BANDS, ROWS = 26, 5                  # a pair of similarity 0.8 misses all buckets in 3 of 100,000 cases
REGISTERS = BANDS * ROWS
NO_ID = -(2**63)                     # stands for a null doc_id
MARGIN = 0.16                        # four standard deviations of the registers' estimate at 0.8
BLOCK = 256                          # members of a block of a large bucket
BLOCK_BYTES = 4 << 20                # of texts in a block
KEY = ["k1", "k2"]                   # what tells documents apart
FILTER_WORDS = 1 << 22               # of 64 bits, at most, in the filter of keys

_M, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWER = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x + _M
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many each text has."""
    canon = [" ".join(t.lower().split()) for t in texts]
    n = np.array([c.count(" ") + 1 if c else 0 for c in canon], np.int64)
    raw = np.frombuffer(" ".join(c for c in canon if c).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), n
    gap = raw == 32
    starts = np.concatenate(([0], np.flatnonzero(gap) + 1))
    lengths = np.diff(np.append(starts, len(raw) + 1))
    place = np.arange(len(raw) + 1) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _POWER, np.uint64))
    value = (raw.astype(np.uint64) + np.uint64(1)) * powers[place[:-1]]
    value[gap] = 0
    return mix(np.add.reduceat(value, starts)), n


def content_hashes(texts: list[str]) -> np.ndarray:
    """128 bits of each text's words, as two numbers (0, 0: no words)."""
    canon = [" ".join(t.lower().split()) for t in texts]
    raw = b"".join(hashlib.blake2b(c.encode("utf-8", "surrogatepass"), digest_size=16).digest() if c else bytes(16) for c in canon)
    return np.frombuffer(raw, "<i8").reshape(-1, 2)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, text number) sorted by text and shingle, each once in a
    text."""
    words, n = word_hashes(texts)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    at = np.arange(len(words)) - first[doc] if len(words) else doc
    size = np.minimum(n, WORDS)
    starts = np.flatnonzero(at <= (n - size)[doc]) if len(words) else doc
    s = np.zeros(len(starts), np.uint64)
    own = doc[starts]
    for k in range(WORDS):
        inside = k < size[own]
        s[inside] = mix(s[inside] * _POWER + words[starts[inside] + k])
    order = np.lexsort((s, own))
    s, own = s[order], own[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    heads = np.flatnonzero(new)
    weight = 1 + np.log(np.diff(np.append(heads, len(s)))) / 2
    return s[heads], weight, own[heads]


def sets_and_registers(texts: list[str], sign: bool = True):
    """Each text's shingle set, and all texts' registers (if asked for)."""
    sets, sigs = [], [np.zeros((0, 2, REGISTERS), np.uint32)]
    for i, j in slices(texts):
        s, w, own = shingles(texts[i:j])
        cut = np.searchsorted(own, np.arange(j - i + 1))
        sets += [s[a:b] for a, b in zip(cut, cut[1:])]
        if sign:
            sigs.append(signatures(s, w, own, j - i))
    return sets, np.concatenate(sigs)


def registers(s: np.ndarray, weight: np.ndarray, own: np.ndarray, n_texts: int) -> np.ndarray:
    """Each text's registers: low 32 bits of the shingle that arrived first."""
    q = np.full((n_texts, REGISTERS), np.inf)
    sig = np.zeros((n_texts, REGISTERS), np.uint32)
    flat_q, flat_s = q.reshape(-1), sig.reshape(-1)
    h, step = np.zeros(len(s)), 0
    while len(s):
        step += 1
        r = mix(s ^ mix(np.full(1, step, np.uint64)))
        h = h - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        at = own * REGISTERS + (mix(r) % np.uint64(REGISTERS)).astype(np.int64)
        better = np.flatnonzero(h < flat_q[at])
        np.minimum.at(flat_q, at[better], h[better])
        won = better[h[better] == flat_q[at[better]]]
        flat_s[at[won]] = s[won].astype(np.uint32)
        slowest = q[np.unique(own)].max(axis=1) if len(s) < n_texts else q.max(axis=1)
        limit = np.full(n_texts, np.inf)
        limit[np.unique(own) if len(s) < n_texts else slice(None)] = slowest
        on = h < limit[own]
        s, weight, own, h = s[on], weight[on], own[on], h[on]
    return sig


def signatures(s: np.ndarray, weight: np.ndarray, own: np.ndarray, n_texts: int) -> np.ndarray:
    """Each text's registers by unit weights, and by its own weights."""
    sig = np.repeat(registers(s, np.ones(len(s)), own, n_texts)[:, None], 2, axis=1)
    repeats = np.unique(own[weight > 1])
    if len(repeats):
        at = np.isin(own, repeats)
        sig[repeats, 1] = registers(s[at], weight[at], np.searchsorted(repeats, own[at]), len(repeats))
    return sig


def pack(sig: np.ndarray) -> list[bytes]:
    """Four bits of each register, two registers a byte; signatures that are
    alike once."""
    low = (sig & np.uint32(15)).astype(np.uint8)
    low = low[..., ::2] | low[..., 1::2] << 4
    return [x[0].tobytes() if (x[0] == x[1]).all() else x.tobytes() for x in low]


def unpack(packed: list[bytes]) -> np.ndarray:
    return np.array([np.resize(np.frombuffer(x, np.uint8), REGISTERS) for x in packed], np.uint8).reshape(-1, 2, REGISTERS // 2)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many registers agree, for rows of a and of b, by the better signature."""
    if a.dtype == np.uint8:      # packed by fours
        x = a ^ b
        return (((x & 15) == 0).sum(axis=-1) + (x < 16).sum(axis=-1)).max(axis=-1)
    return (a == b).sum(axis=-1).max(axis=-1)


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for each of a with each of b."""
    return np.array([agreement(x, b) for x in a])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted shingle sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def document_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """What tells documents apart: 128 bits of doc_id and text (k1, k2)."""
    both = [F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), text_of(docs, text_col)]
    return [F.xxhash64(*both).alias("k1"), F.xxhash64(F.lit("2"), *both).alias("k2")]


def key_filter(keys: DataFrame) -> Column:
    """A condition on (k1, k2) that holds for all of ``keys`` and for few others
    (two bits of one word a key).  The words' number is bounded: beyond some 60
    million keys more others pass, which costs work, not results."""
    n = keys.count()
    words = 1 << int(np.clip(np.ceil(np.log2(max(n, 1) / 4)), 8, np.log2(FILTER_WORDS)))
    bit = lambda low: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("k2", low).bitwiseAND(63).cast("int"))
    rows = (keys.select(F.pmod("k1", F.lit(words)).cast("int").alias("word"), bit(0).bitwiseOR(bit(6)).alias("bits"))
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    table = np.zeros(words, np.uint64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    @F.arrow_udf("boolean")
    def held(k1: pa.Array, k2: pa.Array) -> pa.Array:
        a, b = np.asarray(k1), np.asarray(k2).view(np.uint64)
        one, six, low = np.uint64(1), np.uint64(6), np.uint64(63)
        bits = one << (b & low) | one << (b >> six & low)
        return pa.array(table[a % words] & bits == bits)

    return held("k1", "k2")


def texts_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(doc, text) of the documents in ``nodes`` (doc, k1, k2), each once:
    repeated rows meet inside tasks first."""
    small_batches(docs.sparkSession)
    texts = docs.select(*document_key(docs, id_col, text_col), text_of(docs, text_col).alias("text")).filter(key_filter(nodes.select(*KEY)))
    return stored(texts.dropDuplicates(KEY).join(nodes, KEY).select("doc", "text"), name)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, k1, k2, id, c1, c2, bands, sig): a number for each row, its key and
    content hash (0, 0: no words), buckets and registers."""
    small_batches(docs.sparkSession)
    rows = docs.select(*document_key(docs, id_col, text_col), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), text_of(docs, text_col).alias("text"))

    def sketch(batches):
        import pyarrow as pa
        forget_vocabularies()
        schema = pa.schema([*((c, pa.int64()) for c in ("k1", "k2", "id", "c1", "c2")), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])
        for b in batches:
            texts = b.column(3).to_pylist()
            for i, j in slices(texts):
                s, w, own = shingles(texts[i:j])
                sig, content = signatures(s, w, own, j - i), content_hashes(texts[i:j])
                yield arrays_to_batch(schema, [*(b.column(c).slice(i, j - i) for c in range(3)), content[:, 0].copy(), content[:, 1].copy(), bands(sig), pack(sig)])

    made = rows.mapInArrow(sketch, "k1 long, k2 long, id long, c1 long, c2 long, bands array<long>, sig binary")
    return made.select(F.monotonically_increasing_id().alias("doc"), "*")


def bands(sig: np.ndarray) -> list[np.ndarray]:
    """Each document's buckets: one a band of each signature, alike ones once."""
    rows = sig.astype(np.uint64).reshape(-1, 2, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:3]).copy()
    for k in range(ROWS):
        key = mix(key * _POWER + rows[..., k])
    return [x[0] if (x[0] == x[1]).all() else np.concatenate([x[0], x[1][x[0] != x[1]]]) for x in key.view(np.int64)]


def buckets(sketched: DataFrame) -> DataFrame:
    """(bucket, doc)."""
    return sketched.select(F.explode("bands").alias("bucket"), "doc")


def agreeing(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers agree enough."""
    least = _least(threshold)
    sig = {c: reps.select(F.col("doc").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab"}

    @F.arrow_udf("boolean")
    def enough(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(agreement(unpack(x.to_pylist()), unpack(y.to_pylist())) >= least)

    return pairs.join(sig["b"], "b").join(sig["a"], "a").filter(enough("sig_a", "sig_b")).select("a", "b")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose texts are similar: each b comes to a copy of its a's
    text, one for every BLOCK of them."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    texts = texts_of(stored(nodes.join(reps.select("doc", *KEY), "doc"), "nodes"), docs, id_col, text_col, "candidates")
    parts = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "a")
    rows = stored(parts.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b"), "parts")
    heads = rows.select("a", "part").distinct().join(texts.withColumnRenamed("doc", "a"), "a").select("a", "part", F.col("a").alias("b"), F.lit(0).alias("kind"), "text")
    members = rows.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "part", "b", F.lit(1).alias("kind"), "text")
    by = ["a", "part", "kind"]

    def compare(batches):
        import pyarrow as pa
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        made = np.zeros(0, np.uint64)
        release_memory()
        for batch in batches:
            a, b, kind, texts = (batch.column(k).to_pylist() for k in range(4))
            sets, keep = sets_and_registers(texts, sign=False)[0], []
            del texts
            for i, k in enumerate(kind):
                if k == 0:           # the texts after it are its own
                    made = sets[i]
                elif similarity(made, sets[i]) >= threshold:
                    keep.append(i)
            yield arrays_to_batch(schema, [[a[i] for i in keep], [b[i] for i in keep]])

    return (heads.unionByName(members).repartition("a", "part").sortWithinPartitions(*by)
            .select("a", "b", "kind", "text").mapInArrow(compare, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes with
    edges but the roots.  Each node hooks to its least smaller neighbour, paths
    are halved to their roots, edges move to the roots; rounds are few as roots
    merge.  What a round leaves behind is removed."""
    with temporary(edges.sparkSession):
        return lasting(_components(edges), "roots")


def _components(edges: DataFrame) -> DataFrame:
    def ordered(e):
        return (e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    left = stored(ordered(edges), "links")
    found = None
    while not left.isEmpty():
        hooks = stored(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "hooks")
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = stored(hooks.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = hooks
        else:
            new = hooks.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            found = stored(found.join(new, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).unionByName(hooks), "roots")
        def at_root(e, side):
            return e.join(hooks.select(F.col("node").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
        left = stored(ordered(at_root(at_root(left, "a"), "b")), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if found is None else found


def _blocks(df: DataFrame, by: str, member, name: str) -> DataFrame:
    """Members in lists of about BLOCK and BLOCK_BYTES: (``by``, main, ms); ``n``
    and ``size`` are a group's members and the bytes of their texts."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_BYTES))
    rows = df.select(by, "main", F.pmod(F.xxhash64("doc"), blocks).alias("block"), member.alias("m"))
    return stored(rows.groupBy(by, "main", "block").agg(F.collect_list("m").alias("ms")).drop("block"), name)


def _block_pairs(every: DataFrame, by: str) -> DataFrame:
    """Each block's members outside the main component (qs) with each block (ms)."""
    outside = every.select(by, F.filter("ms", lambda m: m["root"] != F.col("main")).alias("qs")).filter(F.size("qs") > 0)
    return outside.join(every.select(by, "ms"), by).select("qs", "ms")


def _open(rows: DataFrame, by: str, members: int = 2) -> DataFrame:
    """Groups of at least ``members`` and more than one root: n, bytes, and the largest root."""
    sizes = rows.groupBy(by, "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return stored(sizes.groupBy(by).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by("root", F.struct("n", "root")).alias("main"))
                  .filter(f"kinds > 1 and n >= {members}").drop("kinds"), "open")


def _least(threshold: float) -> int:
    return int(np.ceil((threshold - MARGIN) * REGISTERS))


def _roots_of(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))


def _likely(rows: DataFrame, roots: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Of each open bucket's pairs whose registers agree enough, a spanning
    forest over the components, block against block: (a, b)."""
    labelled = stored(_roots_of(rows, roots).withColumn("size", F.lit(0)), "bucket-roots")
    # two members of a bucket were compared, as one of them is the least
    part = labelled.drop("size").join(_open(labelled, "bucket", 3), "bucket").join(reps.select("doc", "sig"), "doc")
    every, least = _blocks(part, "bucket", F.struct("doc", "root", "sig"), "blocks"), _least(threshold)
    discard(labelled)

    def compare(batches):
        import pyarrow as pa
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def members(ms):
            return np.array([m["doc"] for m in ms]), np.array([m["root"] for m in ms]), unpack([m["sig"] for m in ms])

        for batch in batches:
            a, b = [], []
            for q, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (qd, qr, qs), (md, mr, ms) = members(q), members(m)
                for i, j in _forest(qr, mr, agreements(qs, ms), least, lambda i, j: True):
                    a.append(qd[i])
                    b.append(md[j])
            yield arrays_to_batch(schema, [a, b])

    with batch_rows(rows.sparkSession, 64):
        out = stored(_block_pairs(every, "bucket").mapInArrow(compare, "a long, b long"), "likely")
    discard(every)
    return out


def _forest(qr, mr, agree, least, linked):
    """Pairs (i, j) that connect roots, the most agreeing first; ``linked`` says
    whether a pair does connect them."""
    parent: dict[int, int] = {}

    def find(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    i, j = np.nonzero((agree >= least) & (mr[None, :] != qr[:, None]))
    order = np.argsort(-agree[i, j], kind="stable")
    for k, n in zip(i[order].tolist(), j[order].tolist()):
        x, y = find(int(qr[k])), find(int(mr[n]))
        if x != y and linked(k, n):
            parent[x] = y
            yield k, n


def _links_within(families: DataFrame, roots: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Links between the components of each family, verified on the texts in
    tasks, block against block: (a, b)."""
    labelled = _roots_of(families.select(F.col("node").alias("doc"), F.col("root").alias("family")), roots)
    kinds = labelled.groupBy("family", "root").agg(F.count("*")).groupBy("family").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    nodes = stored(labelled.join(kinds.select("family"), "family", "left_semi").join(reps.select("doc", *KEY), "doc"), "families")
    texts = texts_of(nodes.select("doc", *KEY), docs, id_col, text_col, "family-texts")
    sized = nodes.drop(*KEY).join(texts.select("doc", F.octet_length("text").alias("size")), "doc")
    part = nodes.drop(*KEY).join(_open(sized, "family"), "family").join(texts, "doc")
    every, least = _blocks(part, "family", F.struct("doc", "root", "text"), "blocks"), _least(threshold)
    discard(texts)

    def compare(batches):
        import pyarrow as pa
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def members(ms):
            sets, sigs = sets_and_registers([m["text"] for m in ms])
            return np.array([m["doc"] for m in ms]), np.array([m["root"] for m in ms]), sigs, sets

        for batch in batches:
            a, b = [], []
            for q, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (qd, qr, qs, qset), (md, mr, ms, mset) = members(q), members(m)
                for i, j in _forest(qr, mr, agreements(qs, ms), least, lambda i, j, x=qset, y=mset: similarity(x[i], y[j]) >= threshold):
                    a.append(qd[i])
                    b.append(md[j])
            yield arrays_to_batch(schema, [a, b])

    with batch_rows(docs.sparkSession, 4):       # a row is two blocks of texts
        out = stored(_block_pairs(every, "family").mapInArrow(compare, "a long, b long"), "verified")
    discard(every)
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): the least doc_id of each document's class.  The
    result is a written table; the tables it was made from are removed."""
    with temporary(docs.sparkSession):
        out = _classes(docs, threshold, id_col, text_col).select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.nullif("head.id", F.lit(NO_ID)).alias("class_id"))
        return lasting(out.distinct(), "classes")


def first_documents(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2): the ``document_key`` of one document of each class, that of least doc_id."""
    with temporary(docs.sparkSession):
        out = _classes(docs, threshold, id_col, text_col).filter("k1 = head.k1 and k2 = head.k2").select(*KEY)
        return lasting(out.distinct(), "first-documents")


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, head): each row's document and its class's first one."""
    sketched = stored(sketches(docs, id_col, text_col), "sketches")
    worded, content = sketched.filter("c1 <> 0 or c2 <> 0"), ["c1", "c2"]
    order = F.struct((F.col("id") == NO_ID).alias("no_id"), "id", *KEY)
    first = stored(worded.groupBy(*content).agg(F.min("doc").alias("rep"), F.min(order).alias("least")), "contents")
    reps = stored(worded.select("doc", *KEY, "bands", "sig").join(first.select(F.col("rep").alias("doc")), "doc", "left_semi"), "representatives")
    rows = buckets(reps)
    centres = stored(rows.groupBy("bucket").agg(F.min("doc").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"), "centres")
    shared = stored(rows.join(centres, "bucket").select("bucket", "doc", "a"), "shared-buckets")
    discard(centres)
    pairs = stored(shared.filter("doc <> a").select("a", F.col("doc").alias("b")).distinct(), "pairs")
    alike = stored(agreeing(pairs, reps, threshold), "agreeing")
    discard(pairs)
    with temporary(docs.sparkSession):
        links = lasting(verified(alike, reps, docs, threshold, id_col, text_col), "verified")
    discard(alike)
    roots = components(links)
    likely = _likely(shared.select("bucket", "doc"), roots, reps, threshold)
    discard(shared)
    if not likely.isEmpty():
        families = components(links.unionByName(likely))
        families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
        more = _links_within(families, roots, reps, docs, threshold, id_col, text_col)
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    discard(reps)
    at_root = stored(first.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
                     .select(*content, "least", F.coalesce("root", "rep").alias("root")), "content-roots")
    heads = at_root.join(at_root.groupBy("root").agg(F.min("least").alias("head")), "root").select(*content, "head")
    return (sketched.select(*KEY, "id", *content).join(heads, content, "left")
            .select(*KEY, "id", F.coalesce("head", order).alias("head")))
