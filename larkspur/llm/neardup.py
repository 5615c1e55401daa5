"""Near-duplicate documents by MinHash with tensored banding.

Documents are compared by the sets of their k-word shingles. Two small collections of `bands` keys each, a key of `rows`
minhashes, are computed; the table keys are all pairs of one key from each, so bands^2 tables of 2 * rows
hashes cost 2 * bands * rows minhashes. With 20 bands of 5, a pair of similarity 0.8 meets in a table with
probability 0.9993, one of 0.5 with 0.22, one of 0.3 with 0.002. A fixed-size bitmap of the keys that occur twice tells which
classes can meet others at all.

Texts with equal sets are one class from the start. In the tables of the i-th key of either collection every class is paired with the bucket's least; these
pairs are verified on the full sets, which gives components. All other tables are gone through by their first key: classes of
different components that share a key x are dealt into blocks of bounded size with their keys, and a product of key matrices
finds those that share a second key too, so that a pair is looked at in the least x it shares only. Their full sets then
travel to the block, where a product of shingle matrices counts what two sets have in common. A block returns at most a link for each member. So no pair within a
component and no list of a group's pairs is ever made, and no link that a table holds is lost. Components are
found by alternating large-star and small-star steps, on tables; nothing but counts and a fixed-size bitmap comes to the driver.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer than k words
are one shingle; rows with the same id are one document, so its texts are linked with each other; a row whose id is null has no component and is kept; an empty
table gives an empty result; other columns are not looked at. remove_near_duplicates works on texts instead of ids: see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._shared import bit_array, bitmap, bucket_count, is_set, passing, unpacked
from larkspur.llm._words import hashes_of, mixed, over_chunks, window_hashes, words_of
from larkspur.session import cut

BANDS, ROWS = 20, 5
#: Members and shingles of a block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Members and shingles that one call of a grouped function gets on average, columns of a matrix, and bytes of text worked on at once.
CALL_MEMBERS, CALL_SHINGLES, COLUMNS, TEXT_BYTES = 8192, 1 << 19, 2048, 2 << 20


def _shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    w = words_of([t.lower() for t in texts])
    h = hashes_of(w.distinct)[w.ids]
    rolled = window_hashes(h, k)
    out, at = [], 0
    for n in w.counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[at : at + n].tobytes(), n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())


def _signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int) -> np.ndarray:
    """Of each set that isn't empty: 2 * bands keys, each of `rows` minhashes of 32 bits."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.empty((0, 2 * bands), np.int64)
    base = (mixed(np.concatenate(full)) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, full[:-1])])
    rng = np.random.default_rng(seed)
    factors = rng.integers(1 << 31, size=2 * bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(1 << 32, size=2 * bands * rows, dtype=np.uint32)
    out, scratch = np.empty((len(full), 2 * bands), np.uint64), np.empty_like(base)
    with np.errstate(over="ignore"):
        for b in range(2 * bands):
            key = np.full(len(full), np.uint64(b))
            for r in range(b * rows, (b + 1) * rows):
                np.multiply(base, factors[r], out=scratch)
                np.add(scratch, shifts[r], out=scratch)
                key = mixed(key * np.uint64(31) + np.minimum.reduceat(scratch, starts))
            out[:, b] = key
    return out.view(np.int64)


def _sketches(docs: DataFrame, k: int, bands: int, rows: int, seed: int) -> DataFrame:
    """docs' columns before the last, text, with n, digest and keys."""
    carried = docs.schema.fields[:-1]
    schema = T.StructType([*carried, T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def sketched(batch: pa.RecordBatch, texts: list[bytes]) -> list[pa.RecordBatch]:
        sets = _shingles(texts, k)
        keys = _signatures(sets, bands, rows, seed)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, 2 * bands, 0))]).astype(np.int32)
        return [pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(n), _digests(sets), pa.ListArray.from_arrays(offsets, keys.reshape(-1))], schema.names)]

    return docs.mapInArrow(lambda batches: over_chunks(batches, "text", sketched, TEXT_BYTES), schema)


def _sides(classes: DataFrame, bands: int) -> DataFrame:
    """(digest, id, n, keys) of the classes that may share a key of either collection; keys that no other class has are null."""
    schema = T.StructType([classes.schema[c] for c in ("digest", "id", "n", "keys")])
    repeated = classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    known = classes.sparkSession.sparkContext.broadcast(bit_array(bitmap(repeated, "key")))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column("keys").flatten().to_numpy().reshape(len(batch), 2 * bands)
            hit = is_set(known.value, keys)
            both = hit[:, :bands].any(1) & hit[:, bands:].any(1)
            own = pa.array(keys[both].reshape(-1), mask=~hit[both].reshape(-1))
            lists = pa.ListArray.from_arrays(np.arange(int(both.sum()) + 1, dtype=np.int32) * 2 * bands, own)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).filter(pa.array(both)) for c in ("digest", "id", "n")], lists], schema.names)

    out = cut(classes.select("digest", "id", "n", "keys").mapInArrow(marked, schema), "sides")
    known.destroy()
    return out


def _set_table(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(digest, set) of the wanted (digest, id): all shingles, 8 bytes each."""
    ids = wanted.select("id").distinct()
    hashed = docs.withColumn("hash", F.xxhash64("id"))
    # the bitmap keeps most texts home; the join is exact, and a merge join at every size, so that its cost follows the input
    some = passing(hashed, "hash", bitmap(ids.select(F.xxhash64("id").alias("hash")), "hash")).select("id", "text")
    some = some.join(ids.hint("merge"), "id", "left_semi").select("text")

    def made(_: pa.RecordBatch, texts: list[bytes]) -> list[pa.RecordBatch]:
        sets = _shingles(texts, k)
        return [pa.RecordBatch.from_arrays([_digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "set"])]

    sets = some.mapInArrow(lambda batches: over_chunks(batches, "text", made, TEXT_BYTES), "digest binary, set binary").join(wanted.select("digest").distinct(), "digest", "left_semi")
    return cut(sets.groupBy("digest").agg(F.min("set").alias("set")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of digests (a, b) whose sets have at least so many percent of their union in common."""
    named = lambda x: sets.select(F.col("digest").alias(x), F.col("set").alias(f"set_{x}"), F.octet_length("set").alias(f"n_{x}"))
    sized = pairs.join(named("a").hint("merge"), "a").join(named("b").hint("merge"), "b")
    sized = sized.filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("n_a") > 0))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                stays.append(100 * both >= percent * (len(x) + len(y) - both))
            stays = pa.array(stays, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(stays) for c in ("a", "b")], ["a", "b"])

    return sized.select("a", "b", "set_a", "set_b").mapInArrow(compared, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the least id that can be reached."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _linked(docs: DataFrame, classes: DataFrame, given: DataFrame | None, k: int, percent: int, bands: int) -> DataFrame:
    """(digest, component) of the classes that are linked with others; given: links (a, b) that hold anyway."""
    sides = _sides(classes, bands)
    table = lambda i: F.when(F.get("keys", i).isNotNull() & F.get("keys", i + bands).isNotNull(), F.xxhash64(F.get("keys", i), F.get("keys", i + bands)))
    tables = sides.select("digest", "id", F.explode(F.array_compact(F.array(*[table(F.lit(i)) for i in range(bands)]))).alias("table"))
    least = tables.groupBy("table").agg(F.min(F.struct("digest", "id")).alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("table", "least")
    stars = cut(tables.join(least, "table").filter("digest <> least.digest").select("least", F.struct("digest", "id").alias("other")).distinct(), "stars")
    ends = stars.select(F.explode(F.array("least", "other")).alias("e")).select("e.*").distinct()
    links = cut(_verified(stars.select(F.col("least.digest").alias("a"), F.col("other.digest").alias("b")), _set_table(docs, ends, k), percent), "links")
    if given is not None:
        links = links.unionByName(given)
    known = cut(components(links).withColumnRenamed("id", "digest"), "components")
    met = _met(sides, known, bands)
    if met.isEmpty():
        return known
    sets = _set_table(docs, met.select("digest", "id").distinct(), k)
    more = cut(_compared(met, sets, percent), "links")
    return components(known.select(F.col("digest").alias("a"), F.col("component").alias("b")).unionByName(more)).withColumnRenamed("id", "digest")


def _met(sides: DataFrame, known: DataFrame, bands: int) -> DataFrame:
    """(pair, first, one, digest, id, n, component): by pair of blocks, the classes that share a table with one of another component.

    first: the class stands in the pair's first block; one: both blocks are the same. Only keys travel here, not sets.
    """
    keys = lambda lo: F.array_compact(F.slice("keys", lo + 1, bands))
    named = sides.join(known, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    named = named.select("digest", "id", "n", "component", keys(0).alias("xs"), keys(bands).alias("ys")).select("*", F.explode("xs").alias("x"))
    open_ = named.groupBy("x").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("size")).filter("lo < hi").select("x", "members", "size")
    named = cut(named.join(open_, "x"), "open")
    # a component of a bucket is dealt into blocks of its own if it is large, else with others
    inside = named.groupBy("x", "component").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("own_size"))
    parts = lambda members, size: F.ceil(F.greatest(F.col(members) / BLOCK, F.col(size) / BLOCK_SHINGLES))
    large = parts("own", "own_size") > 1
    dealt = named.join(inside, ["x", "component"]).withColumn("alone", F.when(large, F.col("component")))
    block = F.when(large, F.xxhash64("component", F.pmod(F.xxhash64("digest"), parts("own", "own_size")))).otherwise(F.pmod(F.xxhash64("component"), parts("members", "size")))
    dealt = cut(dealt.withColumn("block", block).select("x", "block", "alone", "digest", "id", "n", "component", "xs", "ys"), "dealt")
    blocks = dealt.groupBy("x", "block").agg(F.first("alone").alias("alone"))
    other = blocks.select("x", F.col("block").alias("with"), F.col("alone").alias("with_alone"))
    both = blocks.join(other, "x").filter("block <= with and not (alone <=> with_alone and alone is not null)").select("x", "block", "with")
    halves = both.select("x", "block", "with", F.explode(F.when(F.col("block") == F.col("with"), F.array(F.col("block"))).otherwise(F.array("block", "with"))).alias("own"))
    pair = F.xxhash64("x", "block", "with").alias("pair")
    groups = halves.join(dealt.withColumnRenamed("block", "own"), ["x", "own"]).select(pair, (F.col("own") != F.col("with")).alias("first"), (F.col("block") == F.col("with")).alias("one"), "digest", "id", "n", "component", "x", "xs", "ys")
    calls = bucket_count(groups.count(), CALL_MEMBERS)
    out = ["pair", "first", "one", "digest", "id", "n", "component"]

    def meeting(table: pa.Table) -> pa.Table:
        x = table.column("x").to_numpy()
        xs, ys = ([np.sort(np.array(v, np.int64)) for v in table.column(c).to_pylist()] for c in ("xs", "ys"))
        component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        stays = np.zeros(len(x), bool)
        for rows, left, right in _pairs_of_blocks(table):
            shared = _common([ys[r] for r in rows], left, right) > 0
            shared &= component[rows[left]][:, None] != component[rows[right]]
            if shared.any():  # in an earlier key too: then not here
                shared &= _common([xs[r][xs[r] < x[r]] for r in rows], left, right) == 0
            stays[rows[left]] |= shared.any(1)
            stays[rows[right]] |= shared.any(0)
        return table.select(out).filter(pa.array(stays))

    schema = T.StructType([groups.schema[c] for c in out])
    return cut(groups.groupBy(F.pmod("pair", F.lit(calls)).alias("call")).applyInArrow(meeting, schema), "met")


def _compared(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what the pairs of blocks in met connect: at most one for each member and pair."""
    calls = bucket_count(met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], CALL_SHINGLES)

    def compared(table: pa.Table) -> pa.Table:
        digests = table.column("digest").combine_chunks()
        component = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        a, b = [], []
        for rows, left, right in _pairs_of_blocks(table):
            both = _common([sets[r] for r in rows], left, right)
            near = 100 * both >= percent * (n[rows[left]][:, None] + n[rows[right]] - both)
            near &= component[rows[left]][:, None] != component[rows[right]]
            root = _roots(len(rows), left, right, near)
            gone = np.flatnonzero(root != np.arange(len(rows)))
            a.append(rows[gone])
            b.append(rows[root[gone]])
        take = lambda at: digests.take(pa.array(np.concatenate(at) if at else np.empty(0, np.int64)))
        return pa.table({"a": take(a), "b": take(b)})

    groups = met.join(sets.hint("merge"), "digest").groupBy(F.pmod("pair", F.lit(calls)).alias("call"))
    return groups.applyInArrow(compared, "a binary, b binary").distinct()


def _pairs_of_blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair in table: its rows, and which of them stand on the left and on the right."""
    pair, first, one = (table.column(c).to_numpy() for c in ("pair", "first", "one"))
    order = np.argsort(pair, kind="stable")
    starts = np.append(np.flatnonzero(np.append(True, np.diff(pair[order]) != 0)), len(order))
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        rows = order[lo:hi]
        left = np.arange(len(rows)) if one[rows[0]] else np.flatnonzero(first[rows])
        right = left if one[rows[0]] else np.flatnonzero(~first[rows])
        if len(left) and len(right):
            yield rows, left, right


def _roots(n: int, left: np.ndarray, right: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each of n members the least that near, a matrix of left by right, connects it with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        lows = np.where(near, root[left][:, None], n).min(0)
        root[right] = np.minimum(root[right], lows)
        lows = np.where(near, root[right][None, :], n).min(1)
        root[left] = np.minimum(root[left], lows)
        if (root == before).all():
            return root


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many numbers each two of the sets share; a set has a number once."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    column = (np.cumsum(times > 1) - 1)[which]
    again = times[which] > 1
    owner, column = owner[again], column[again]
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        some = (column >= at) & (column < at + COLUMNS)
        matrix = np.zeros((len(sets), min(COLUMNS, int(column.max()) + 1 - at)), np.float32)
        matrix[owner[some], column[some] - at] = 1
        out += (matrix[left] @ matrix[right].T).astype(np.int64)
    return out


def _classes(table: DataFrame) -> DataFrame:
    # equal sets have equal keys: any row's will do, and the least id stands for the class
    return cut(table.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; kept: it is the document that stays of its component."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = cut(_sketches(texts, shingle, bands, rows, seed), "sketches")
    named = table.filter("id is not null and n > 0").select("id", "digest")
    classes = _classes(table.filter("id is not null"))
    several = named.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").select("id", "lo")
    same_id = cut(named.join(several, "id").filter("digest <> lo").select(F.col("digest").alias("a"), F.col("lo").alias("b")).distinct(), "same-id")
    linked = _linked(texts.filter("id is not null"), classes, same_id, shingle, percent, bands)
    of = classes.select("digest", "id", "copies").join(linked, "digest", "left")
    least = of.filter("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    of = of.join(least, "component", "left").filter("copies > 1 or component is not null").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    of = cut(of, "classes-linked")
    full = table.filter("id is not null and n > 0").select("id", "n", "digest").join(of, "digest", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    # rows without words follow the other rows of their id
    bare = table.filter("id is not null and n = 0").select("id", "n")
    others = named.join(bare.select("id").distinct(), "id", "left_semi").join(of, "digest", "left").groupBy("id").agg(F.min(F.coalesce("component_id", "id")).alias("component_id"))
    bare = bare.join(others, "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    rest = table.filter("id is null").select("id", "n", F.col("id").alias("component_id"))
    out = full.unionByName(bare).unionByName(rest)
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def remove_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> DataFrame:
    """The rows of docs that stay, with docs' columns: one of each group of near-duplicate texts.

    Groups are of texts, whatever their ids, so a text stays even if another text of its id goes. The row that stays has the least id
    (null first), then the least MD5 of its text; of rows with the same id and text the one with the least hash of all columns stays. Texts without words
    are in no group and stay, those that repeat with their id once.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a row is known by its id and its text's checksum, together
    ident = F.struct(F.col(id_col).alias("own"), F.unhex(F.md5(text.cast("binary"))).alias("key")).alias("id")
    texts = docs.select(ident, text.alias("text"))
    table = cut(_sketches(texts, shingle, bands, rows, seed), "sketches").filter("n > 0")
    classes = _classes(table)
    linked = _linked(texts, classes, None, shingle, percent, bands)
    of = classes.filter("copies > 1").select("digest").unionByName(linked.select("digest")).distinct().join(linked, "digest", "left")
    of = cut(of.select("digest", F.coalesce("component", "digest").alias("component")), "classes-linked")
    # tables, so that a large group's rows can be split
    members = cut(table.select("id", "digest").join(of, "digest").select("id", "component"), "members")
    first = cut(members.groupBy("component").agg(F.min("id").alias("first")), "firsts")
    gone = members.join(first, "component").filter("id <> first").select(F.col("id").alias("gone")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), ident)
    # the join's partitioning and order serve the step that keeps one row of each id and text
    stays = keyed.join(gone.hint("merge"), F.col("id") == F.col("gone"), "left_anti")
    hashed = [F.lit(0) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col("row").getField(f.name) for f in docs.schema]
    once = stays.groupBy("id").agg(F.min_by("row", F.xxhash64(*hashed)).alias("row"))
    return once.select(*unpacked("row", docs.columns))
