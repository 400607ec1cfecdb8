"""Near-duplicate groups: a multi-index Hamming join of MinHash signatures, confirmed on full sets.

1. A document's set holds the hashes of its distinct word shingles. Documents with equal sets form
   one class, which its smallest doc_id represents; only representatives go on.
2. A signature has ``CHUNKS`` x ``LANES`` minima. For every chunk, every lane but one in turn gives
   a key: documents that differ in at most one lane of some chunk share a key. By the pigeonhole
   principle that finds every pair at a distance of at most ``2 * CHUNKS - 1`` lanes; of pairs of
   similarity 0.8 it misses (P(two or more of six lanes differ)) ** 14 = 3e-7.
3. Star round: each document of a bucket is compared with the bucket's pivot only (the smallest in
   a scrambled order), so a group of n near copies gives n pairs a bucket and not n * n.
   Pairs whose 4-bit signatures differ in more than ``FAR`` lanes are dropped (similarity 0.8 exceeds
   that with a probability of 4e-10), the others count the common shingles of their full sets.
4. Rest round: buckets whose documents are in different components by then hold undecided pairs.
   Their documents are cut into blocks of bounded size, near ones together, and every two blocks that
   share such a bucket meet in one task with their texts. It counts the common shingles of all
   its pairs at once, as a product of incidence matrices, and only links that join components
   leave it: however many pairs a group has, it emits fewer rows than documents.

Hot buckets: counts and pivots are aggregated before the shuffle and joins can be split by Spark.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import arrow_rows, documents, kept, sliced, stage_columns
from barloom.llm.components import components

CHUNKS, LANES = 14, 6
N_LANES = CHUNKS * LANES
FAR = 40
BATCH_ROWS = 1000  # rows that go to a Python worker together
#: A block of the rest round holds about this many documents and shingles; matrices have so many columns.
BLOCK_DOCS, BLOCK_SHINGLES, MATRIX_COLUMNS = 1024, 1 << 19, 4096
WORDS = 6  # longs that hold the 4-bit lanes, 16 in each

_RANDOM = np.random.RandomState(20240229)
_ODD = lambda n: _RANDOM.randint(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _KEY, _DROP = _ODD(N_LANES), _ODD(N_LANES), _ODD(N_LANES), _ODD(N_LANES)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: doc_id <-> scrambled number, a bijection of 64-bit integers
_SPREAD = 0x9E3779B97F4A7C15
_BACK = pow(_SPREAD, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > self.limit:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words. Words are split at ASCII
    white space after A-Z became a-z; a text of fewer words is one shingle, one without words none."""
    raw = text.encode() if isinstance(text, str) else text
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = kept(("words",), _WordHashes)
    own = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    width = min(size, len(words))
    n = len(own) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit lanes taken from the minima of ``N_LANES`` hashes."""
    least = np.full(N_LANES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at : at + 2048, None] * _A + _B).min(axis=0))
    return (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def lane_words(sig: np.ndarray) -> np.ndarray:
    """The low 4 bits of each lane, 16 lanes to a long."""
    lanes = np.zeros(WORDS * 16, np.uint64)
    lanes[:N_LANES] = sig & 15
    return (lanes.reshape(WORDS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def bucket_keys(sigs: np.ndarray) -> np.ndarray:
    """[row, chunk x dropped lane] 64-bit keys of signatures [row, lane]."""
    terms = sigs.astype(np.uint64) * _KEY
    chunks = terms.reshape(len(sigs), CHUNKS, LANES)
    rest = chunks.sum(axis=2, dtype=np.uint64)[:, :, None] - chunks
    return _mix(rest.reshape(len(sigs), N_LANES) + _DROP).view(np.int64)


def _scrambled(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.int64).view(np.uint64) * np.uint64(_SPREAD)).view(np.int64)


def _unscrambled(nodes: np.ndarray) -> np.ndarray:
    return (nodes.astype(np.int64).view(np.uint64) * np.uint64(_BACK)).view(np.int64)


_SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, sig binary"


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in sliced(batches):
            counts, first, second, sigs = [], [], [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                own = shingle_set(raw, size)
                counts.append(len(own))
                if len(own):
                    d1, d2 = np.frombuffer(xxh3_128_digest(own.tobytes()), np.int64)
                    first.append(int(d1))
                    second.append(int(d2))
                    sigs.append(signature(own).tobytes())
                else:
                    first.append(None)
                    second.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in (counts, first, second)),
                    pa.array(sigs, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )

    return documents(docs).mapInArrow(sign, _SIGNED)


def _keyed(heads: DataFrame) -> DataFrame:
    """``key, node`` of every representative."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sigs = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, N_LANES)
                nodes = _scrambled(part.column("rep").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket_keys(sigs).ravel()), pa.array(np.repeat(nodes, N_LANES))], names=["key", "node"]
                )

    return heads.select("rep", "sig").mapInArrow(keys, "key long, node long")


def _sketches(heads: DataFrame) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, N_LANES)
            words = np.array([lane_words(s) for s in sigs], np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rep"),
                    pa.array(_scrambled(batch.column("rep").to_numpy())),
                    batch.column("n_shingles"),
                    *(pa.array(words[:, k]) for k in range(WORDS)),
                ],
                names=["rep", "node", "size", *(f"w{k}" for k in range(WORDS))],
            )

    columns = ", ".join(f"w{k} long" for k in range(WORDS))
    return heads.select("rep", "n_shingles", "sig").mapInArrow(sketch, f"rep long, node long, size long, {columns}")


def _near(left: str, right: str) -> Column:
    """Sizes and 4-bit lanes of two sketches allow a similarity of 0.8."""
    ones = F.lit(0x1111111111111111)

    def differing(k: int) -> Column:
        x = F.col(f"{left}.w{k}").bitwiseXOR(F.col(f"{right}.w{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones))

    distance = reduce(lambda a, b: a + b, (differing(k) for k in range(WORDS)))
    small, large = F.least(f"{left}.size", f"{right}.size"), F.greatest(f"{left}.size", f"{right}.size")
    return (small * 5 >= large * 4) & (distance <= FAR)


def _confirmed(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` (doc_ids) among ``pairs`` of nodes, counted on the full sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = zstandard.ZstdDecompressor().decompress
        held: dict[int, tuple[bytes, np.ndarray]] = {}

        def own_set(node: int, body: bytes) -> np.ndarray:
            found = held.get(node)
            if found is None or found[0] != body:
                if len(held) >= 64:
                    held.clear()
                held[node] = found = (body, shingle_set(restore(body), size))
            return found[1]

        for batch in sliced(batches, "body_a"):
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "body_a", "body_b")]
            links = []
            for a, b, body_a, body_b in zip(*columns, strict=True):
                x, y = own_set(a, body_a), own_set(b, body_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
            found = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(_unscrambled(found[:, 0])), pa.array(_unscrambled(found[:, 1]))], names=["a", "b"])

    left = bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a"))
    right = bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(count, "a long, b long")


def _bodies(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, body``: the compressed lower-case text of the documents in ``pairs`` (``a``, ``b``)."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()

    own = documents(docs).where("doc_id is not null").mapInArrow(_squeeze, "node long, body binary")
    return own.join(nodes, "node", "left_semi").dropDuplicates(["node", "body"])


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (``doc_id``, ``text``).

    Two documents are linked when the sets of their ``size``-word shingles share at least
    ``percent`` of their union (80 or more: the signatures are laid out for that). A null text is
    empty; a document without words has an empty set and is linked with nothing. Rows that share a
    ``doc_id`` are one document with several texts. A row without ``doc_id`` takes no part: its
    component is null and it is kept. Repeated rows give repeated results; other columns are ignored.
    """
    if percent < 80:
        raise ValueError("signatures are laid out for a similarity of 80 percent or more")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _grouped(docs, size, percent)


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    signed = stage_columns(_signed(docs, size), "signed")
    with_set = signed.where("d1 is not null and doc_id is not null")
    classes = with_set.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    # the signature is carried on by representatives only
    members = stage_columns(
        with_set.join(classes, ["d1", "d2"]).select(
            "doc_id", "rep", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig")
        ),
        "members",
    )
    heads = stage_columns(members.where("sig is not null").dropDuplicates(["rep", "sig"]), "heads")
    keys = _keyed(heads)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot"), F.max("node").alias("other"))
    shared = shared.where("pivot <> other").drop("other")
    rows = stage_columns(keys.join(shared, "key"), "buckets")
    nodes = rows.select("node").distinct()
    sketches = stage_columns(_sketches(heads).join(nodes, "node", "left_semi"), "sketches")

    stars = rows.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = stars.alias("p").join(sketches.alias("x"), F.col("p.a") == F.col("x.node"))
    stars = stars.join(sketches.alias("y"), (F.col("p.b") == F.col("y.node")) & _near("x", "y"))
    stars = stage_columns(stars.select("p.a", "p.b").distinct(), "stars")
    links = _confirmed(stars, _bodies(docs, stars), size, percent)
    links = stage_columns(links.union(_repeated_ids(members)), "links")
    groups = stage_columns(components(links), "groups")

    more = _rest_links(docs, rows.where("n > 2"), groups, sketches, size, percent)
    if more is not None:
        known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = stage_columns(components(known.union(more)), "groups")

    placed = members.select("doc_id", "rep", "n_shingles").join(groups, members["rep"] == groups["node"], "left")
    placed = placed.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.where("d1 is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeated_ids(members: DataFrame) -> DataFrame:
    """Links between the classes of one doc_id that came with different texts."""
    spread = members.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b")
    return members.select("doc_id", "rep").join(spread.select("doc_id", "b"), "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")


def _rest_links(docs: DataFrame, rows: DataFrame, groups: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame | None:
    """Links between components among the pairs that share a bucket; None where no pair is undecided."""
    placed = sketches.join(groups, F.col("rep") == groups["node"], "left").select(
        sketches["node"], sketches["size"], F.coalesce("component", "rep").alias("component")
    )
    own = rows.select("key", "node", "pivot").join(placed, "node")
    mixed = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    own = stage_columns(own.join(mixed.select("key"), "key"), "rest-rows")
    if own.isEmpty():
        return None
    blocks = stage_columns(_blocks(own), "rest-blocks")
    keyed = own.select("key", "node").join(blocks.select("node", "block"), "node").select("key", "block").distinct()
    x, y = keyed.alias("x"), keyed.alias("y")
    meets = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") <= F.col("y.block")))
    meets = stage_columns(meets.select(F.col("x.block").alias("left"), F.col("y.block").alias("right")).distinct(), "rest-meets")
    sides = meets.select("left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    sent = sides.join(blocks, "block")
    bodies = documents(docs).where("doc_id is not null").mapInArrow(_squeeze, "node long, body binary")

    def compare(table: pa.Table) -> pa.Table:
        names = ["a", "b"]
        found = np.array(_joining(table, size, percent), np.int64).reshape(-1, 2)
        return pa.table([pa.array(_unscrambled(found[:, k])) for k in range(2)], names=names)

    return bodies.join(sent, "node").groupBy("left", "right").applyInArrow(compare, "a long, b long")


def _blocks(own: DataFrame) -> DataFrame:
    """``node, component, block``: documents that can be reached from each other through buckets are one
    cluster, and a cluster beyond the limits is cut, documents with the same smallest pivot together."""
    near = own.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    clusters = components(near).withColumnRenamed("component", "cluster")
    nodes = own.groupBy("node").agg(F.min("pivot").alias("home"), F.min("size").alias("size"), F.min("component").alias("component"))
    nodes = stage_columns(nodes.join(clusters, "node"), "rest-nodes")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    homes = nodes.groupBy("cluster", "home").agg(parts.alias("home_parts"), F.count(F.lit(1)).alias("m"))
    whole = nodes.groupBy("cluster").agg(parts.alias("parts"))
    nodes = nodes.join(homes, ["cluster", "home"]).join(whole, "cluster")
    alone = (F.col("home_parts") > 1) | (F.col("m") * 2 > BLOCK_DOCS)
    block = (
        F.when(F.col("parts") <= 1, F.xxhash64("cluster"))
        .when(alone, F.xxhash64("cluster", "home", F.pmod(F.xxhash64("node"), F.col("home_parts"))))
        .otherwise(F.xxhash64("cluster", F.lit("others"), F.pmod(F.xxhash64("home"), F.col("parts"))))
    )
    return nodes.select("node", "component", block.alias("block"))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, body``: the compressed words of documents."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in sliced(batches):
        raws = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(_scrambled(batch.column("doc_id").to_numpy())),
                pa.array([pack(b" ".join(r.lower().split())) for r in raws], pa.binary()),
            ],
            names=["node", "body"],
        )


def _joining(table: pa.Table, size: int, percent: int) -> list[tuple[int, int]]:
    """Links of nodes of two blocks (or of one) that join their components, at most one fewer than these."""
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    restore = zstandard.ZstdDecompressor().decompress
    held = {}
    for node, component, block, body in zip(*(table.column(c).to_pylist() for c in ("node", "component", "block", "body")), strict=True):
        held.setdefault((node, body), (node, component, block))
    own = sorted((where[2] != left, where[0], where[1], body) for (_, body), where in held.items())
    sets = [shingle_set(restore(body), size) for *_, body in own]
    nodes = [node for _, node, _, _ in own]
    sizes = np.array([len(s) for s in sets], np.int64)
    first = len(own) if left == right else sum(not other for other, *_ in own)
    ends = (0, first), (first if left != right else 0, len(own))
    parent = {component: component for _, _, component, _ in own}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    numbers = {c: i for i, c in enumerate(parent)}
    label = np.array([numbers[component] for _, _, component, _ in own])
    common = _common(sets, *ends)
    (x0, x1), (y0, y1) = ends
    linked = 100 * common >= percent * (sizes[x0:x1, None] + sizes[None, y0:y1] - common)
    linked &= (label[x0:x1, None] != label[None, y0:y1]) & (common > 0)
    found = []
    for i, j in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
        a, b = root(own[x0 + i][2]), root(own[y0 + j][2])
        if a != b:
            parent[a] = b
            found.append((nodes[x0 + i], nodes[y0 + j]))
    return found


def _common(sets: list[np.ndarray], x: tuple[int, int], y: tuple[int, int]) -> np.ndarray:
    """[x, y] sizes of the intersections of the sets in two ranges."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    # only shingles that both ranges hold (of one range: that two sets hold) can be common
    in_x, in_y = (owner >= x[0]) & (owner < x[1]), (owner >= y[0]) & (owner < y[1])
    count = np.bincount(column, minlength=len(values))
    both = (np.bincount(column[in_x], minlength=len(values)) > 0) & (np.bincount(column[in_y], minlength=len(values)) > 0) & (count > 1)
    number = np.cumsum(both) - 1
    kept = both[column]
    owner, column = owner[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((x[1] - x[0], y[1] - y[0]))
    for at in range(0, int(both.sum()), MATRIX_COLUMNS):
        low, high = np.searchsorted(column, [at, at + MATRIX_COLUMNS])
        part = np.zeros((len(sets), MATRIX_COLUMNS), np.float32)
        part[owner[low:high], column[low:high] - at] = 1
        out += part[x[0] : x[1]] @ part[y[0] : y[1]].T  # whole numbers, exact
    return out.astype(np.int64)


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each near-duplicate group is kept: the one
    with the smallest ``doc_id``, once. Texts that share a ``doc_id`` are documents of their own; rows
    equal in ``doc_id`` and text are one, of which the one with the least hash of its other columns
    stays. All columns as they are, whatever their names; rows without ``doc_id`` stay."""
    text = F.col("text").cast("string")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    # a row travels as one struct, so that its columns meet no name used here
    keyed = docs.where("doc_id is not null").select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
        F.xxhash64(text.isNull(), F.coalesce(text, F.lit(""))).alias("digest"),
        (F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)).cast("long").alias("turn"),
    )
    # staged, so that Spark measures how few there are
    several = keyed.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    several = stage_columns(several.where("least <> most").drop("most"), "several-texts")
    if several.isEmpty():
        known = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select("doc_id").distinct()
        rows = keyed.join(known, "doc_id", "left_semi").groupBy("doc_id")
    else:
        # further texts of an id take part under a number of their own
        further = F.col("least").isNotNull() & (F.col("least") != F.col("digest"))
        node = F.when(further, F.xxhash64("doc_id", "digest", F.lit("further text"))).otherwise(F.col("doc_id"))
        keyed = keyed.join(several, "doc_id", "left").withColumn("node", node)
        groups = near_duplicates(keyed.select(F.col("node").alias("doc_id"), "text"), size, percent)
        groups = groups.select(F.col("doc_id").alias("node"), "component_id").distinct()
        ids = keyed.select("node", "doc_id", "digest").distinct().join(groups, "node")
        first = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "node")).alias("first"))
        rows = keyed.join(first.select("first.node"), "node", "left_semi").groupBy("node")
    rows = rows.agg(F.min_by("row", "turn").alias("row")).select("row.*")
    return rows.unionByName(docs.where("doc_id is null"))
