"""Sharding by a k-d tree over document metadata.

The tree starts with all documents.  A node that has to give ``s`` shards is
split in two along its widest dimension (its extent there as a share of the
whole table's), at the weighted quantile that gives the halves
``floor(s / 2)`` and ``ceil(s / 2)`` shards' worth of bytes: the weighted
median where ``s`` is even.  With ``target_bytes`` there are as many leaves as
keep the mean leaf at or below it.

What is split are *units*: rows of equal text stay together, placed by the
smallest of their values on each dimension.  A text whose copies weigh more
than ``tolerance`` of a shard is cut into pieces of about that weight, which
lie next to each other in every order, so that no group of copies keeps the
shards from being equal; a group is divided only by a cut that falls on it.

A unit's order along a dimension is (value, tie), the tie being the head of
the text's hash and the piece's number.  The quantile is found for all nodes
of a level at once: bytes are summed by node and bucket (``BUCKETS`` equal
parts of the interval that holds the quantile), the bucket that passes the
wanted weight becomes the next interval, first over values, then over ties of
one value, until one unit is left; the cut lies before or behind it, whichever
is nearer.  Only units, a few numbers each, are read more than once, and
only one row per node comes out of a step; nothing is sorted or collected.

A row's place in its shard (``slot``, gapless from 0) comes from one range
shuffle (``ranks.with_positions``).

Native DataFrame operators only.  Defined cases: a null text has no bytes and
counts 1 like the empty text; null metadata is a value below all others; null
ids come back as null; rows that repeat id and text are rows of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import with_positions
from .common import drop, stage

BUCKETS = 4096
# Bits of a tie that number the pieces of a text; the bits above are its hash.
PIECE_BITS = 20


def dimension(docs: DataFrame, name: str) -> Column:
    """A metadata column as a whole number that keeps its order: numbers (of
    fractions the first six digits), dates and times as such, text by its
    first seven bytes.  Null is below all others."""
    c, kind = F.col(name), docs.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        most, x = F.lit(float(1 << 61)), c.cast("double") * 1e6
        v = F.floor(F.when(F.isnan(x), most).otherwise(F.greatest(F.least(x, most), -most))).cast("long")
    elif isinstance(kind, T.DateType):
        v = F.unix_date(c).cast("long")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        v = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        v = c.cast("long")
    else:
        head = F.substring(F.encode(c.cast("string"), "UTF-8"), 1, 7)
        v = F.conv(F.rpad(F.hex(head), 14, "0"), 16, 10).cast("long")
    # extents must not overflow
    v = F.greatest(F.least(v, F.lit(1 << 61)), F.lit(-(1 << 61)))
    return F.coalesce(v, F.lit(-(1 << 62)))


def cuts_of(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, dim, cut_value, cut_tie): for each of ``nodes`` (node, dim,
    want) the place that divides its units nearest to the weight ``want``:
    units at or below (cut_value, cut_tie) go left."""
    dims = [c for c in units.columns if c.startswith("d")]

    def on(dim: Column) -> Column:
        value = F.lit(None).cast("long")
        for k in reversed(range(len(dims))):
            value = F.when(dim == k, F.col(f"d{k}")).otherwise(value)
        return value

    # value: known once the interval of values holds one value only
    state = nodes.select(
        "node", "dim", "want", F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("value"),
        "lo", "hi").withColumn("value", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    state = state.withColumns({"lo": F.when(F.col("value").isNotNull(), 0).otherwise(F.col("lo")),
                               "hi": F.when(F.col("value").isNotNull(), (1 << 63) - 1).otherwise(F.col("hi"))})
    state = stage(state, "state")
    found = None
    while True:
        rows = units.join(state.withColumnRenamed("node", "at_node"), F.col("node") == F.col("at_node"))
        x = F.when(F.col("value").isNull(), on(F.col("dim"))).otherwise(F.col("tie"))
        rows = rows.withColumn("x", x).where(
            (F.col("value").isNull() | (on(F.col("dim")) == F.col("value")))
            & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        # whole-number division: exact at every magnitude
        rows = rows.withColumn("bucket", F.expr(f"(x - lo) div (hi div {BUCKETS} - lo div {BUCKETS} + 1)"))
        hist = rows.groupBy("node", "bucket").agg(
            F.sum("bytes").alias("bytes"), F.min("x").alias("x0"), F.max("x").alias("x1"))
        run = F.sum("bytes").over(Window.partitionBy("node").orderBy("bucket"))
        hist = hist.withColumn("upto", run).join(state, "node")
        last = F.max("bucket").over(Window.partitionBy("node"))
        passed = hist.withColumn("last", last).where(
            (F.col("below") + F.col("upto") >= F.col("want")) | (F.col("bucket") == F.col("last")))
        at = passed.groupBy("node").agg(F.min_by(F.struct(
            "dim", "want", "value", "x0", "x1", (F.col("below") + F.col("upto") - F.col("bytes")).alias("below"), "bytes",
        ), "bucket").alias("s")).select("node", "s.*")
        at = stage(at, "quantile")
        drop(state)
        one = F.col("x0") == F.col("x1")
        behind = F.col("want") - F.col("below") >= F.col("bytes") / 2
        done = at.where(one & F.col("value").isNotNull()).select(
            "node", F.col("dim").alias("cut_dim"), F.col("value").alias("cut_value"),
            F.when(behind, F.col("x0")).otherwise(F.col("x0") - 1).alias("cut_tie"))
        found = done if found is None else found.unionByName(done)
        open_ = at.where(~(one & F.col("value").isNotNull()))
        if open_.isEmpty():
            return found
        state = stage(open_.select(
            "node", "dim", "want", "below", F.when(one, F.col("x0")).otherwise(F.col("value")).alias("value"),
            F.when(one & F.col("value").isNull(), 0).otherwise(F.col("x0")).alias("lo"),
            F.when(one & F.col("value").isNull(), (1 << 63) - 1).otherwise(F.col("x1")).alias("hi")), "state")


def split_units(units: DataFrame, shards: int) -> DataFrame:
    """``units`` (h, piece, tie, bytes, d0 ...) with ``shard``: the leaf of
    the tree.  A node is the number of its first shard; ``s`` of it counts
    its shards."""
    dims = [c for c in units.columns if c.startswith("d")]
    units = stage(units.withColumns({"node": F.lit(0).cast("long"), "s": F.lit(shards).cast("long")}), "units")
    whole = units.agg(*[(F.max(c) - F.min(c)).alias(c) for c in dims]).first()
    extent = {c: max(1, whole[c] or 1) for c in dims}
    left = F.floor(F.col("s") / 2)
    for _ in range((shards - 1).bit_length()):
        nodes = units.where("s > 1").groupBy("node", "s").agg(
            F.sum("bytes").alias("bytes"), *[F.min(c).alias(f"min_{c}") for c in dims],
            *[F.max(c).alias(f"max_{c}") for c in dims])
        share = [(F.col(f"max_{c}") - F.col(f"min_{c}")) / F.lit(float(extent[c])) for c in dims]
        widest = F.greatest(*share) if len(dims) > 1 else share[0]
        dim = F.lit(len(dims) - 1)
        for k in reversed(range(len(dims) - 1)):
            dim = F.when(share[k] == widest, k).otherwise(dim)
        nodes = nodes.select("node", dim.alias("dim"), F.col("bytes") * left / F.col("s"), *[
            F.col(f"{m}_{c}") for c in dims for m in ("min", "max")]).toDF(
            "node", "dim", "want", *[f"{m}_{c}" for c in dims for m in ("min", "max")])

        def bound(which: str) -> Column:
            out = F.lit(None).cast("long")
            for k, c in enumerate(dims):
                out = F.when(F.col("dim") == k, F.col(f"{which}_{c}")).otherwise(out)
            return out

        nodes = nodes.select("node", "dim", "want", bound("min").alias("lo"), bound("max").alias("hi"))
        cuts = cuts_of(units, nodes).withColumnRenamed("node", "cut_node")
        value = F.lit(None).cast("long")
        for k in range(len(dims)):
            value = F.when(F.col("cut_dim") == k, F.col(f"d{k}")).otherwise(value)
        right = (value > F.col("cut_value")) | ((value == F.col("cut_value")) & (F.col("tie") > F.col("cut_tie")))
        joined = units.join(cuts, F.col("node") == F.col("cut_node"), "left")
        new = joined.select(
            *[c for c in units.columns if c not in ("node", "s")],
            F.when(right, F.col("node") + left).otherwise(F.col("node")).alias("node"),
            F.when(F.col("cut_node").isNull(), F.col("s")).when(right, F.col("s") - left).otherwise(left).alias("s"))
        new = stage(new, "units")
        drop(units)
        units = new
    return units.withColumnRenamed("node", "shard")


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dims: tuple[str, ...] = ("source", "lang", "n_chars", "doc_id"),
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 1 / 64,
) -> DataFrame:
    """One row per document: doc_id, size (bytes of the text plus 1),
    text_crc32, shard, slot.  Give ``shards`` or ``target_bytes``."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    rows = stage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"),
        *[dimension(docs, c).alias(f"d{k}") for k, c in enumerate(dims)]), "rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    piece_bytes = max(1.0, total / shards * tolerance)

    # texts whose copies are to be cut: at most shards / tolerance of them
    key = ["h", "size", "crc"]
    heavy = rows.groupBy(*key).agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n"))
    heavy = stage(heavy.where((F.col("weight") > piece_bytes) & (F.col("n") > 1)).select(
        *key, F.least(F.ceil(F.col("weight") / F.lit(piece_bytes)), F.lit(1 << PIECE_BITS)).alias("pieces")), "heavy")
    piece = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("pieces")))
    rows = stage(rows.join(heavy, key, "left").withColumn("piece", piece).drop("pieces"), "pieces")
    tie = F.shiftleft(F.shiftrightunsigned("h", PIECE_BITS + 1), PIECE_BITS).bitwiseOR(F.col("piece"))
    units = rows.groupBy(*key, "piece").agg(
        F.sum("size").alias("bytes"), *[F.min(f"d{k}").alias(f"d{k}") for k in range(len(dims))]).withColumn("tie", tie)
    # copies of one text stand where the first of them does, on every dimension
    of_text = units.where("piece > 0").groupBy(*key).agg(*[F.min(f"d{k}").alias(f"m{k}") for k in range(len(dims))])
    units = units.join(of_text, key, "left").select(
        *key, "piece", "tie", "bytes", *[F.least(f"d{k}", f"m{k}").alias(f"d{k}") for k in range(len(dims))])
    leaves = split_units(units, shards)
    out = rows.join(leaves.select(*key, "piece", "shard"), [*key, "piece"])
    out = with_positions(out.select("doc_id", "size", "crc", "shard", "row"), ["shard"], ["row"], "slot")
    return out.select("doc_id", "size", F.col("crc").cast("long").alias("text_crc32"),
                      F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
