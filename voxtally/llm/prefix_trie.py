"""Conversation prefix trie with count-min screening.

Every conversation is a path of turns from a common root, and conversations that begin with
the same turns share these nodes. A prefix is told by a digest that follows its turns one by
one. All digests are counted in a count-min sketch first. It never counts too little: a
prefix estimated at one is a single conversation's, and so is every longer one, whose nodes
are emitted where they stand. Only prefixes that may be shared are shuffled and grouped.

Long conversations and prefixes that most conversations share are hot keys. Running digests
and sums go by blocks of a conversation, counts and sums over a prefix are added up before
they are shuffled, members are digested from chunks, and what a hot prefix gives to its
children is broadcast: at most `HOT` prefixes can hold more than their share of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.llm.common import mix64, settle

GROUP = 5
DEPTHS = 9
BLOCK = 1024
HOT = 500
LINES = 4
LEAST_CELLS = 1 << 16
MOST_CELLS = 1 << 24
SLICE = 1 << 16
CHUNK = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def crc(conv: str) -> Column:
    """How many turns conversation `conv` takes from the first of its group, at most."""
    return (F.crc32(F.col(conv).cast("string").cast("binary")) % DEPTHS).cast("long")


def by_key(rows: DataFrame, few: DataFrame, key: list[str], counts: DataFrame, how: str = "inner") -> DataFrame:
    """`rows` joined with `few`, which has one row a key; `counts` (key, n) tells how many rows a key has.

    Keys with more than a share of 1 / HOT of all rows are at most HOT, and their rows of
    `few` are broadcast; the other rows meet by a shuffle in which no key is hot.
    """
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = F.broadcast(counts.where(F.col("n") > total / HOT).select(*key, F.lit(True).alias("__hot")))
    marked, known = rows.join(often, key, "left"), few.join(often, key, "left")
    hot = marked.where("__hot").drop("__hot").join(F.broadcast(known.where("__hot").drop("__hot")), key, how)
    rest = marked.where("__hot is null").drop("__hot").join(known.where("__hot is null").drop("__hot"), key, how)
    return hot.unionByName(rest)


def running(rows: DataFrame, key: str, place: str, totals: dict[str, tuple[str, str]], block: int = BLOCK) -> DataFrame:
    """`rows` with running totals by `place` within `key`: name -> (aggregate, column), of rows up to and with this one.

    A window over a key would put a long one into one task, so totals run within blocks of
    `block` places, and over one row a block.
    """
    tools = {"bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)), "sum": (F.sum, lambda a, b: a + b)}
    cut = rows.withColumn("__block", F.floor(F.col(place) / block))
    inner = Window.partitionBy(key, "__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, "__block").agg(*[tools[a][0](c).alias(name) for name, (a, c) in totals.items()])
    entry = sums.select(key, "__block", *[F.coalesce(tools[a][0](name).over(before), F.lit(0)).alias(f"__{name}") for name, (a, _) in totals.items()])
    entry = entry.where(" or ".join(f"__{name} <> 0" for name in totals))
    local = cut.select("*", *[tools[a][0](c).over(inner).alias(name) for name, (a, c) in totals.items()])
    joined = local.join(entry, [key, "__block"], "left")
    whole = {name: tools[a][1](F.col(name), F.coalesce(f"__{name}", F.lit(0))) for name, (a, _) in totals.items()}
    return joined.select(*rows.columns, *[c.alias(name) for name, c in whole.items()])


def turns_in_order(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, at, x, y, n_bytes) of every turn: its place from 0, the digest of its role and text, the text's bytes.

    The digest is two 64-bit words hashed from a SHA-256. Turns of one number, or of none,
    are in the order of their digests.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    word = lambda seed: F.xxhash64(F.lit(seed), "digest")
    rows = settle(rows.where("conv_id is not null").select("conv_id", "turn", word(1).alias("x"), word(2).alias("y"), "n_bytes"), "turns")
    # turns are numbered within blocks of turn numbers, and over one row a block
    cut = rows.withColumn("__block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    sizes = cut.groupBy("conv_id", "__block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    entry = sizes.select("conv_id", "__block", before.alias("__before")).where("__before > 0")
    inner = F.row_number().over(Window.partitionBy("conv_id", "__block").orderBy(F.asc_nulls_first("turn"), "x", "y")) - 1
    placed = cut.withColumn("at", inner.cast("long")).join(entry, ["conv_id", "__block"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("__before", F.lit(0))).alias("at"), "x", "y", "n_bytes")


def rebuilt(turns: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows, lengths) of the conversations with their first turns taken from the first of their group.

    The rows are (conv_id, place, x, y, n_bytes), the lengths (conv_id, n_turns), also of
    conversations without any turn left.
    """
    sizes = settle(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    head = (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("head")
    plans = sizes.select("conv_id", head, crc("conv_id").alias("taken"), "n")
    given = sizes.select(F.col("conv_id").alias("head"), F.col("n").alias("given"))
    plans = plans.join(given, "head", "left").withColumn("given", F.least("taken", F.coalesce("given", F.lit(0))))
    plans = settle(plans.withColumn("n_turns", F.col("given") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))), "plans")
    firsts = turns.where(F.col("at") < DEPTHS).select(F.col("conv_id").alias("head"), F.col("at").alias("place"), "x", "y", "n_bytes")
    taken = plans.where("given > 0").select("conv_id", "head", "given").join(firsts, "head").where("place < given")
    own = by_key(turns.where(F.col("at") >= crc("conv_id")), plans.select("conv_id", "taken", "given"), ["conv_id"], sizes)
    own = own.select("conv_id", (F.col("at") - F.col("taken") + F.col("given")).alias("place"), "x", "y", "n_bytes")
    return taken.select("conv_id", "place", "x", "y", "n_bytes").unionByName(own), plans.select("conv_id", "n_turns")


def prefixes(rows: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, n_bytes, ends) of every prefix of every conversation, the root's included.

    (a, b) is the digest of the prefix and (pa, pb) that of its parent; `ends` tells whether
    the conversation is over. A digest is two 64-bit words, the exclusive or of words hashed
    from the turns' digests and places; the root's is (0, 0).
    """
    word = lambda seed: F.xxhash64(F.lit(seed), "x", "y", "place")
    mixed = rows.select("conv_id", "place", "n_bytes", word(1).alias("x"), word(2).alias("y"))
    run = running(mixed, "conv_id", "place", {"a": ("bit_xor", "x"), "b": ("bit_xor", "y")}, block)
    depth = (F.col("place") + 1).alias("depth")
    run = run.select("conv_id", depth, "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "n_bytes")
    counts = run.groupBy("conv_id").agg(F.count("*").alias("n"))
    run = by_key(run, lengths, ["conv_id"], counts).withColumn("ends", F.col("depth") == F.col("n_turns")).drop("n_turns")
    none = F.lit(None).cast("long")
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), none.alias("pa"), none.alias("pb"), F.lit(0).cast("long").alias("n_bytes"), (F.col("n_turns") == 0).alias("ends"))
    return run.select(*root.columns).unionByName(root)


def cells_of(words: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each word in each line of the sketch, as rows."""
    return np.stack([(mix64(words ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) % np.uint64(cells)).astype(np.int64) + k * cells for k in range(LINES)])


def sketch(rows: DataFrame, cells: int) -> np.ndarray:
    """The count-min sketch of the words `a` of the rows, its counts held at 2, as `LINES` lines of `cells`.

    Tasks count into sketches of their own and send the slices they touched; equal slices are
    added up in tasks. The size is set, so what the driver gets and broadcasts is bounded.
    """
    piece = min(SLICE, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(LINES * cells, dtype=np.uint8)
        for batch in batches:
            for line in cells_of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), cells):
                at, n = np.unique(line, return_counts=True)
                held[at] = np.minimum(held[at] + np.minimum(n, 2), 2)
        for k, part in enumerate(held.reshape(-1, piece)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(part, dtype=np.uint8)
                held[k] = np.minimum(held[k] + new, 2) if k in held else new
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["slice", "counts"])

    schema = "slice long, counts binary"
    out = np.zeros(LINES * cells, dtype=np.uint8).reshape(-1, piece)
    for r in rows.select("a").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.ravel()


def screened(rows: DataFrame, counts: np.ndarray, cells: int) -> DataFrame:
    """The rows with `alone` and `parent_alone`: the sketch proves that no other conversation has the prefix."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    schema = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", alone boolean, parent_alone boolean"
    at, parent = rows.columns.index("a"), rows.columns.index("pa")

    def proven(column: pa.Array) -> pa.Array:
        words = column.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array((shared.value[cells_of(words, cells)].min(0) == 1) & (words != 0))  # the root's, 0, is not counted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, proven(batch.column(at)), proven(batch.column(parent))], names=[*batch.schema.names, "alone", "parent_alone"])

    return rows.mapInArrow(run, schema)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): the SHA-256 of each prefix's conversations `conv_id`, ascending, joined by commas.

    Ranges of the sorted rows are joined into chunks first, so that a prefix in which many
    conversations end is a few chunks to the task that digests them one after the other.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, first, ",".join(held).encode())], schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("chunk", pa.binary())]))

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and (key != (a, b) or size > CHUNK):
                    yield flush()
                    key = None
                if key is None:
                    key, first, held, size = (a, b), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if key is not None:
            yield flush()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for a, b, _, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == (a, b):
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(chunk)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "ends_sha256"])
                out = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=["a", "b", "ends_sha256"])

    ranged = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    chunks = ranged.mapInArrow(join, "a long, b long, first long, chunk binary")
    return chunks.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = GROUP, block: int = BLOCK, most_cells: int = MOST_CELLS) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, by the columns of `NODE`.

    Reads conv_id, turn, role and text; other columns are not read. Null roles and texts are
    empty, turns without a number come first, and turns of one number are in the order of
    the digest of role and text. Repeated rows are turns of their own. Rows without a conv_id
    take no part. The first of a group is conv_id less its non-negative remainder by `group`.
    A table without conversations has no nodes, not even the root.
    """
    rows, lengths = rebuilt(settle(turns_in_order(conversations, block), "ordered"), group)
    lengths = settle(lengths, "lengths")
    paths = settle(prefixes(settle(rows, "rebuilt"), lengths, block), "prefixes")
    total = paths.count()
    cells = min(most_cells, max(LEAST_CELLS, 1 << (4 * total).bit_length()))
    marked = settle(screened(paths, sketch(paths.where("depth > 0"), cells), cells), "screened")
    # the tails, whole where they stand; the first node of a tail has a parent that may be shared
    single = marked.where("alone")
    own = F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tail = [one.alias("n_convs"), F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), own.alias("ends_sha256")]
    below = single.where("parent_alone").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *tail)
    tops = single.where("not parent_alone").select("conv_id", "depth", "pa", "pb", *tail)
    # the others, grouped exactly
    many = marked.where("not alone")
    nodes = many.groupBy("a", "b").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("n_bytes").alias("n_bytes"), F.min(F.when(F.col("parent_alone"), F.col("conv_id"))).alias("above"))
    nodes = settle(nodes, "nodes")
    linked = nodes.where("above is null").select("pa", "pb").unionByName(tops.select("pa", "pb"))
    children = settle(linked.where("pa is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n")), "children")
    nodes = nodes.join(children.withColumnRenamed("n", "n_children"), ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = settle(nodes, "counted")
    # what a node adds to every node above it is added by its smallest member, from the end of its path on
    given = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    steps = many.select("conv_id", "depth", "a", "b").join(given, ["conv_id", "depth"], "left")
    over = single.where("ends").select("conv_id", "depth", zero.alias("a"), zero.alias("b"), zero.alias("saved"), one.alias("leaf"), F.lit(True).alias("local"))
    steps = steps.select("conv_id", "depth", "a", "b", F.coalesce("saved", zero).alias("saved"), F.coalesce("leaf", zero).alias("leaf"), F.lit(False).alias("local")).unionByName(over)
    steps = steps.withColumn("up", -F.col("depth"))
    sums = running(settle(steps, "steps"), "conv_id", "up", {"saved_tokens": ("sum", "saved"), "n_leaves": ("sum", "leaf")}, block)
    sums = sums.where("not local and (saved_tokens <> 0 or n_leaves <> 0)").groupBy("a", "b").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    ends = ends_digests(settle(many.where("ends").select("a", "b", "conv_id"), "ends"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    fans = children.select(F.col("a").alias("pa"), F.col("b").alias("pb"), "n")
    names = [f.split()[0] for f in NODE.split(", ")]
    full = nodes.join(sums, ["a", "b"], "left").join(ends, ["a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    full = settle(full, "full")
    inside = by_key(full.where("above is null and pa is not null"), parents, ["pa", "pb"], fans).select(*names)
    loose = full.where("above is not null or pa is null").withColumn("parent_conv_id", F.col("above")).select(*names)
    tops = by_key(tops, parents, ["pa", "pb"], fans).select(*names)
    return below.select(*names).unionByName(tops).unionByName(inside).unionByName(loose)


def trie_sql() -> str:
    """The same nodes in SQL over `conversations`, of tables whose turns have a number each."""
    return f"""
    WITH RECURSIVE own AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS at, coalesce(role, '') AS role, coalesce(text, '') AS text
      FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT DISTINCT conv_id FROM own),
    crc AS (
      SELECT conv_id, conv_id::VARCHAR AS digits, 0 AS step, 4294967295::BIGINT AS c FROM ids
      UNION ALL
      SELECT conv_id, digits, step + 1, CASE WHEN step % 9 = 0 THEN xor(c, ascii(substr(digits, step // 9 + 1, 1))::BIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END
      FROM crc WHERE step < 9 * length(digits)),
    taken AS (SELECT conv_id, conv_id - (conv_id % {GROUP} + {GROUP}) % {GROUP} AS head, xor(c, 4294967295::BIGINT) % {DEPTHS} AS h FROM crc WHERE step = 9 * length(digits)),
    heads AS (SELECT t.conv_id, o.at AS place, o.role, o.text FROM taken t JOIN own o ON o.conv_id = t.head AND o.at < t.h),
    given AS (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id),
    turns AS (
      SELECT * FROM heads UNION ALL
      SELECT o.conv_id, o.at - t.h + coalesce(g.n, 0), o.role, o.text FROM own o JOIN taken t USING (conv_id) LEFT JOIN given g USING (conv_id) WHERE o.at >= t.h),
    paths AS (
      SELECT conv_id, place + 1 AS depth, string_agg(md5(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY place) AS key, strlen(text) AS bytes FROM turns
      UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
    lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
    nodes AS (
      SELECT key, CASE WHEN length(key) > 33 THEN left(key, length(key) - 33) ELSE '' END AS above, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
      FROM paths JOIN lengths USING (conv_id) GROUP BY key),
    children AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
    counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (key)),
    sums AS (
      SELECT p.key, sum(c.saved) AS saved_tokens, count(*) FILTER (c.n_children = 0) AS n_leaves
      FROM counted c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.key)
    SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
    FROM counted c JOIN sums s USING (key) LEFT JOIN nodes p ON c.depth > 0 AND p.key = c.above
    """
