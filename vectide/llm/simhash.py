"""Near duplicates by SimHash, compared exactly, tile by tile.

A text's words, A-Z in lower case, form shingles (repeats count; too few words make one shingle).
The XXH64 of the shingles vote on each bit of the fingerprint.  With more than 64 bits, further
words of bits come from the same hashes, mixed anew.

Distinct fingerprints are sorted into classes by their population counts: for one word and a small
radius by the counts of both halves, else by bands of the whole count.  Classes are cut into tiles
of about ``TILE`` fingerprints.  Two tiles meet only where their counts don't differ beyond the
radius; then all their pairs are compared by exclusive-or and bit counts of numpy arrays.  A tile
pair gives a spanning forest of its links, so a group of ``n`` gives ``n - 1`` rows, not the square.
Components of the links are found by ``graph.connected_components``.

The comparison is exact, so its work grows with the square of the distinct fingerprints; the
classes divide that by a constant (by 3 for 64 bits and radius 4).  Tiles grow with the work up to
``LARGE_TILE``, and what is moved is the square of the fingerprints over the tile's size.  Only a
table of the classes is broadcast, of which there are 33 x 33 at most.

``similar_duplicates`` links by the exact Jaccard similarity of the sets of shingles; there the
fingerprints, at a wider radius, only choose the candidates.  At such a radius population counts tell
little, but a similarity bounds the ratio of the sets' sizes: items are sorted into bands of sizes
too, and a band meets only itself and the next.

Nulls and odd input.  A null text is the empty text.  Texts without words have fingerprint zero and
are linked like any other.  Null ids count last as a component's smallest.  Repeated rows share a
fingerprint.  Empty tables give no rows.  Of a hot fingerprint only one item is compared.  Other
columns pass through; those that are named like the added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vectide.llm.common import cleared, stored
from vectide.llm.graph import connected_components

#: Fingerprints of a tile: the least, and where there are very many.
TILE, LARGE_TILE = 4096, 65_536
#: Shingle hashes of a block of items that are compared by their whole sets, about; a larger set is alone.
BLOCK_HASHES = 1 << 19
#: Comparisons, and bytes of tiles, that a task has about.
WORK, BYTES = 500_000_000, 16_000_000
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _hashes(text: str | None, width: int) -> list[int]:
    """The XXH64 of a text's shingles, repeats included."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [hashed(joined, 42)]
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return [hashed(joined[a:b], 42) for a, b in zip(at[:-width].tolist(), (at[width:] - 1).tolist())]


def fingerprint(text: str | None, width: int, n_words: int = 1) -> list[int]:
    """The fingerprint of a text as unsigned 64-bit words."""
    import numpy as np

    hashes = _hashes(text, width)
    if not hashes:
        return [0] * n_words
    h, out = np.array(hashes, np.uint64), []
    for k in range(n_words):
        if k:
            h = (h ^ (h >> np.uint64(31))) * np.uint64(_MIX[1]) + np.uint64(_MIX[0])
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[2])
            h ^= h >> np.uint64(32)
        votes = np.zeros(64, np.int64)
        for i in range(0, len(h), 8192):
            votes += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        out.append(int(np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(df: DataFrame, text_col: str, width: int, n_words: int = 1, words_col: str = "words") -> DataFrame:
    """df without its text, with the fingerprint as ``words array<long>``."""
    row = lambda t: ([w - (w >> 63 << 64) for w in fingerprint(t, width, n_words)],)
    return _mapped(df, text_col, [T.StructField(words_col, T.ArrayType(T.LongType()))], row)


#: Numbers that a Python worker holds as output at once, about.
_HELD = 1_000_000


def _mapped(df: DataFrame, text_col: str, added: list[T.StructField], row) -> DataFrame:
    """df without its text and with the columns ``added``, from ``row(text)``, in small Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    df = cleared(df, *[f.name for f in added])
    kept = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(df.schema[c] for c in kept), *added])
    text_at = df.columns.index(text_col)
    keep_at = [df.columns.index(c) for c in kept]

    def run(batches):
        import pyarrow as pa

        kinds = [to_arrow_schema(schema).field(f.name).type for f in added]
        for batch in batches:
            rows, first, held = [], 0, 0
            for i in range(batch.num_rows):
                rows.append(row(batch.column(text_at)[i].as_py()))
                held += sum(len(v) for v in rows[-1] if hasattr(v, "__len__"))
                if held >= _HELD or i == batch.num_rows - 1:
                    part = batch.slice(first, len(rows))
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep_at), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=schema.names)
                    rows, first, held = [], i + 1, 0

    return df.mapInArrow(run, schema)


def link_forest(a, b, same: bool, radius: int) -> Iterator[tuple[int, int]]:
    """Rows (i of a, j of b) of a spanning forest of all pairs within the radius; arrays (n, words) of uint64."""
    import numpy as np

    n, m, whole = len(a), len(b), a.shape[1]
    root = np.arange(n if same else n + m)
    shift = 0 if same else n
    dense = min(whole, (radius + 16) // 32 + 1)  # words counted for all pairs; more bits apart than the radius there are no link
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    step = max(1, (1 << 18) // max(1, m))
    for i in range(0, n, step):
        start = i if same else 0
        d = np.bitwise_count(a[i : i + step, 0][:, None] ^ b[None, start:, 0])
        if dense > 3:  # beyond 255 bits
            d = d.astype(np.int32)
        for w in range(1, dense):
            d += np.bitwise_count(a[i : i + step, w][:, None] ^ b[None, start:, w])
        ii, jj = np.nonzero(d <= radius)
        if not len(ii):
            continue
        if whole > dense:
            total = d[ii, jj].astype(np.int32)
            for w in range(dense, whole):
                total += np.bitwise_count(a[ii + i, w] ^ b[jj + start, w])
            near = total <= radius
            ii, jj = ii[near], jj[near]
        ii, jj = ii + i, jj + start
        ra, rb = root[ii], root[jj + shift]
        new = ra != rb
        if not new.any():
            continue
        ii, jj, ra, rb = ii[new], jj[new], ra[new], rb[new]
        _, at = np.unique(np.minimum(ra, rb) * len(root) + np.maximum(ra, rb), return_index=True)
        for k in at.tolist():
            x, y = top(int(ra[k])), top(int(rb[k]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield int(ii[k]), int(jj[k])
        known = np.arange(len(root))
        changed = list(parent)
        known[changed] = [top(x) for x in changed]
        root = known[root]


def _class(radius: int, n_words: int, similarity: float | None = None):
    """Columns of a fingerprint's class; the offsets of the classes that it may link to, each pair of classes once."""
    if n_words == 1 and radius <= 8:
        word = F.element_at("words", 1)
        high, low = F.bit_count(F.shiftrightunsigned(word, 32)), F.bit_count(word.bitwiseAND(0xFFFFFFFF))
        offsets = [(h, w) for h in range(-radius, radius + 1) for w in range(-radius, radius + 1) if abs(h) + abs(w) <= radius and (h, w) >= (0, 0)]
        return high, low, offsets
    count = sum(F.bit_count(F.element_at("words", k + 1)) for k in range(n_words))
    band = F.floor(count / (radius + 1)).cast("int")
    if similarity is None:
        return band, F.lit(0), [(0, 0), (1, 0)]
    # sets of that similarity differ in size by that ratio at most; bands are a little wider, for rounding
    size = F.when(F.col("n") > 0, F.floor(F.ln("n") / F.lit(-math.log(similarity) * 1.0001))).otherwise(F.lit(-9)).cast("int")
    return band, size, [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def classes(items: DataFrame, radius: int, n_words: int = 1, similarity: float | None = None) -> tuple[DataFrame, dict[tuple[int, int], int], list[tuple]]:
    """Items with their class ``(h, w)``, the classes' sizes, and the pairs of classes that meet.

    The sum of the products of met classes' sizes is what ``links`` compares.
    """
    high, low, offsets = _class(radius, n_words, similarity)
    items = items.select("id", "words", high.alias("h"), low.alias("w"))
    sizes = {(r.h, r.w): r.n for r in items.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).collect()}  # 33 x 33 classes, or bands by logarithms of sizes
    return items, sizes, [(c, d) for c in sizes for o in offsets if (d := (c[0] + o[0], c[1] + o[1])) in sizes]


def links(items: DataFrame, radius: int, n_words: int = 1, similarity: float | None = None) -> DataFrame:
    """Links ``(u, v)`` among ``items(id long, words array<long>)`` within the radius: enough to connect all that are linked.

    With ``similarity`` the items also have ``n``, the size of their set, and pairs whose sizes rule
    that similarity out need not be linked.
    """
    spark = items.sparkSession
    items, sizes, met = classes(items, radius, n_words, similarity)
    work = sum(sizes[c] * sizes[d] for c, d in met)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # larger tiles where there are many, so that what is moved grows slower than the comparisons
    size = min(LARGE_TILE, max(TILE, math.isqrt(max(1, work // (64 * least)))))
    tiles = {c: -(-n // size) for c, n in sizes.items()}
    moved = sum(tiles[c] * tiles[d] * 8 * (n_words + 1) * (sizes[c] / tiles[c] + sizes[d] / tiles[d]) for c, d in met)
    tasks = int(max(least, work / WORK, moved / BYTES))
    # one row a class, of which there are 33 x 33 at most, with the classes that it meets: 41 at most
    after, before = {c: [] for c in sizes}, {c: [] for c in sizes}
    for c, d in met:
        after[c].append((*d, tiles[d]))
        before[d].append((*c, tiles[c]))
    kind = "array<struct<h:int,w:int,tiles:int>>"
    table = spark.createDataFrame([(*c, tiles[c], after[c], before[c]) for c in sizes] or [(0, 0, 1, [], [])], f"h int, w int, tiles int, after {kind}, before {kind}").coalesce(1)

    cut = items.join(F.broadcast(table.select("h", "w", "tiles")), ["h", "w"]).withColumn("k", F.pmod(F.xxhash64("words", F.lit(7)), F.col("tiles")).cast("int"))
    tile = cut.groupBy("h", "w", "k").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("words")).alias("all"))
    tile = stored(tile, "tiles").join(F.broadcast(table), ["h", "w"])
    every = lambda classes: F.explode(F.flatten(F.transform(classes, lambda c: F.transform(F.sequence(F.lit(0), c.tiles - 1), lambda k: F.struct(c.h.alias("h"), c.w.alias("w"), k.alias("k"))))))
    # dealt by both tiles of a pair, so that tiles of a large class don't meet in one task
    keys, once = ["h2", "w2", "k2", "k", "h", "w"], "h <> h2 or w <> w2 or k <= k2"
    left = tile.select("h", "w", "k", "ids", "all", every(F.col("after")).alias("x"))
    left = left.select("h", "w", "k", "ids", "all", F.col("x.h").alias("h2"), F.col("x.w").alias("w2"), F.col("x.k").alias("k2")).where(once).repartition(tasks, *keys)
    right = tile.select(F.col("h").alias("h2"), F.col("w").alias("w2"), F.col("k").alias("k2"), F.col("ids").alias("ids2"), F.col("all").alias("all2"), every(F.col("before")).alias("x"))
    right = right.select("h2", "w2", "k2", "ids2", "all2", F.col("x.h").alias("h"), F.col("x.w").alias("w"), F.col("x.k").alias("k")).where(once).repartition(tasks, *keys)
    met_tiles = left.join(right.hint("shuffle_hash"), keys)
    same = (F.col("h") == F.col("h2")) & (F.col("w") == F.col("w2")) & (F.col("k") == F.col("k2"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        flat = lambda column, i: column.slice(i, 1).flatten().to_numpy(zero_copy_only=False)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ids2 = flat(batch.column(0), i), flat(batch.column(2), i)
                a, b = (flat(batch.column(k), i).view(np.uint64).reshape(-1, n_words) for k in (1, 3))
                found = list(link_forest(a, b, batch.column(4)[i].as_py(), radius))
                if found:
                    x, y = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[list(x)]), pa.array(ids2[list(y)])], schema=schema)

    return met_tiles.select("ids", "all", "ids2", "all2", same.alias("same")).mapInArrow(run, "u long, v long")


def near_duplicates(prints: DataFrame, radius: int, n_words: int = 1, id_col: str = "doc_id") -> DataFrame:
    """``prints`` (with ``words`` and an id) with ``component_id``: the smallest id of all that can be reached by links."""
    prints = cleared(prints, "component_id")
    items = prints.groupBy("words").agg(F.min(id_col).alias("least"))
    items = stored(items.withColumn("id", F.monotonically_increasing_id()), "fingerprints")
    parts = connected_components(links(items.select("id", "words"), radius, n_words))
    labelled = items.join(parts.withColumnRenamed("node", "id"), "id", "left").select("words", "least", F.coalesce("component", "id").alias("part"))
    # written, so that the join reads both sides by an exchange and Spark can split a large component's rows
    least = stored(labelled.groupBy("part").agg(F.min("least").alias("component_id")), "components")
    named = labelled.join(least, "part").select("words", "component_id")
    return prints.join(named, "words")


def shingle_hashes(text: str | None, width: int):
    """The distinct hashes of a text's shingles, sorted."""
    import numpy as np

    return np.unique(np.array(_hashes(text, width), np.uint64))


def shingle_sets(df: DataFrame, text_col: str, width: int, n_words: int, words_col: str = "words") -> DataFrame:
    """df without its text, with the fingerprint, ``same long``, a hash of the set of shingles, and ``n long``, its size."""
    added = [T.StructField(words_col, T.ArrayType(T.LongType())), T.StructField("same", T.LongType()), T.StructField("n", T.LongType())]
    return _mapped(df, text_col, added, lambda t: _print_and_set(t, width, n_words))


def _print_and_set(text: str | None, width: int, n_words: int) -> tuple:
    import xxhash

    signed, found = lambda w: w - (w >> 63 << 64), shingle_hashes(text, width)
    return [signed(w) for w in fingerprint(text, width, n_words)], signed(xxhash.xxh64_intdigest(found.tobytes(), 1)), len(found)


def similar(a, b, similarity: float) -> bool:
    """Whether two sorted arrays of distinct hashes have the Jaccard similarity or more; two empty ones have."""
    import numpy as np

    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def similar_links(sets: list, groups: list[int], first: list[bool], second: list[bool], similarity: float) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join ``groups`` of sets further: pairs of one of ``first`` and one of ``second`` by exact similarity.

    The shared hashes are counted by an inverted list.  Pairs whose groups are joined already are
    passed over, so there is less than one link for each set.
    """
    import numpy as np

    parent = {g: g for g in groups}

    def top(g: int) -> int:
        while parent[g] != g:
            parent[g] = g = parent[parent[g]]
        return g

    sizes = np.array([len(x) for x in sets])
    holders = [i for i, f in enumerate(first) if f]
    values = np.concatenate([sets[i] for i in holders]) if holders else np.zeros(0, np.uint64)
    owner = np.repeat(holders, sizes[holders]) if holders else np.zeros(0, int)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for j, asked in enumerate(second):
        if not asked:
            continue
        lo, hi = np.searchsorted(values, sets[j], "left"), np.searchsorted(values, sets[j], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.sum() else np.zeros(0, int)
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((both > 0) & (both >= similarity * (sizes + sizes[j] - both)))
        for i in near.tolist():
            a, b = top(groups[i]), top(groups[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield i, j


def similar_duplicates(docs: DataFrame, text_col: str, key_col: str, width: int, similarity: float, radius: int, n_words: int) -> DataFrame:
    """``(key, component_id)``: the smallest key that links of exact Jaccard ``similarity`` or more reach.

    1. Texts with equal shingle sets are one item.
    2. Fingerprints within ``radius``, which is wide, make candidate groups (``links`` and components).
    3. The candidate links that were found are tried by the exact similarity; those that hold join
       items to parts.
    4. A candidate group of one part is done.  In the others all pairs of items of different parts
       are tried, in blocks of about ``BLOCK_HASHES`` hashes, sorted by part, so that pairs of blocks of one part
       drop out.  Groups of copies thus cost a link for each item; only parts that are near each
       other and yet not linked cost all their pairs.

    ``docs`` must give the same rows each time it is read.
    """
    prints = stored(shingle_sets(docs.select(key_col, text_col), text_col, width, n_words), "shingle-sets")
    items = prints.groupBy("words", "same").agg(F.min(key_col).alias("least"), F.max("n").alias("n"))
    items = stored(items.withColumn("id", F.monotonically_increasing_id()), "items")
    found = stored(links(items.select("id", "words", "n"), radius, n_words, similarity), "candidate-links")
    group = stored(connected_components(found).select(F.col("node").alias("id"), F.col("component").alias("group")), "candidate-groups")
    # the sets of items that have a candidate, each from the text of the item's smallest key
    wanted = items.join(group, "id").select("id", "least")
    texts = docs.select(F.col(key_col).alias("least"), F.col(text_col).alias("text")).join(wanted, "least")
    sets = stored(_mapped(texts.select("id", "text"), "text", [T.StructField("hashes", T.ArrayType(T.LongType()))], lambda t: (shingle_hashes(t, width).view("int64"),)), "sets")

    def tried(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v")

    sure = stored(tried(found.select("u", "v").distinct()), "links")
    part = connected_components(sure).select(F.col("node").alias("id"), F.col("component").alias("part"))
    grouped = group.join(part, "id", "left").join(items.select("id", "n"), "id")
    grouped = stored(grouped.select("id", "group", F.coalesce("part", "id").alias("part"), F.greatest("n", F.lit(1)).alias("size")), "parts")
    split = grouped.groupBy("group").agg((F.min("part") < F.max("part")).alias("several"), F.sum("size").alias("n")).where("several").drop("several")
    more = stored(_across_parts(stored(grouped.join(split, "group"), "split-groups"), sets, similarity), "more-links")
    joined = connected_components(sure.unionByName(more))
    labelled = items.join(joined.withColumnRenamed("node", "id"), "id", "left").select("words", "same", "least", F.coalesce("component", "id").alias("part"))
    least = stored(labelled.groupBy("part").agg(F.min("least").alias("component_id")), "components")
    named = labelled.join(least, "part").select("words", "same", "component_id")
    return prints.join(named, ["words", "same"]).select(key_col, "component_id")


def _across_parts(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between different parts of the groups of ``members(id, group, part, size, n)``, block by block; ``n`` hashes a group."""
    blocks = F.ceil(F.col("n") / BLOCK_HASHES).cast("int")
    large = members.where(blocks > 1)
    # places in order of parts: hashes of the parts before, and a part's items in any order
    sizes = large.groupBy("group", "part").agg(F.sum("size").alias("c"))
    ahead = sizes.withColumn("ahead", F.sum("c").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = large.join(ahead.select("group", "part", "c", F.coalesce("ahead", F.lit(0)).alias("ahead")), ["group", "part"])
    # within a part blocks are dealt by hash, so that no task sorts a large part
    start, end = F.floor(F.col("ahead") / BLOCK_HASHES), F.floor((F.col("ahead") + F.col("c") - 1) / BLOCK_HASHES)
    placed = placed.withColumn("block", (start + F.pmod(F.xxhash64("id"), (end - start + 1))).cast("int")).select("id", "group", "part", "block", blocks.alias("blocks"))
    small = members.where(blocks <= 1).select("id", "group", "part", F.lit(0).alias("block"), F.lit(1).alias("blocks"))
    rows = stored(placed.unionByName(small), "blocks")
    kept = rows.groupBy("group", "block").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.first("blocks").alias("blocks"))
    kept = stored(kept, "block-parts")
    left = kept.select("group", F.col("block").alias("b1"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("b2"))
    pairs = left.join(kept.select("group", F.col("block").alias("b2"), "low", "high"), ["group", "b2"])
    pairs = stored(pairs.where("low1 <> high1 or low <> high or low1 <> low").select("group", "b1", "b2"), "block-pairs")
    sides = pairs.select("group", "b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    met = sides.join(rows.select("id", "group", "part", "block"), ["group", "block"]).join(sets, "id")

    def run(_, table):
        import numpy as np
        import pyarrow as pa

        ids, parts = table["id"].to_pylist(), table["part"].to_pylist()
        block, one, two = (table[c].to_pylist() for c in ("block", "b1", "b2"))
        hashes = [np.array(x.as_py(), np.int64).view(np.uint64) for x in table["hashes"]]
        found = list(similar_links(hashes, parts, [b == k for b, k in zip(block, one)], [b == k for b, k in zip(block, two)], similarity))
        return pa.table({"u": pa.array([ids[i] for i, _ in found], pa.int64()), "v": pa.array([ids[j] for _, j in found], pa.int64())})

    return met.groupBy("group", "b1", "b2").applyInArrow(run, "u long, v long")
