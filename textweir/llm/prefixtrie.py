"""The trie of rebuilt conversations, from fingerprints that compose.

A sequence of turns has the element (B^length, hash) of a monoid: (a, x)(b, y) = (ab, xb + y)
modulo a prime, in four lanes. Prefix products of the stored turns give those of every rebuilt
conversation (the head of its base, then its own suffix) by one product and one quotient, so no
rebuilt text is ever made; a rebuilt turn is a fingerprint and a reference to the stored turn.
Equal fingerprints of one depth are a node. All turns that a node's members refer to are checked to
have one SHA-256 digest; as the digest and a node's fingerprint give its parent's, that
proves by induction that members agree in all their turns. If it fails, other multipliers are drawn.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop_saved, saved, small

PRIME = 2**31 - 1
LANES = 4
#: Conversations c share the head of c - c % FAMILY, of crc32(c) % HEADS turns.
FAMILY, HEADS = 5, 9
BATCH = 8_192
#: Bytes of a piece of a list of ids.
CHUNK = 1 << 20

FP = [f"p{i}" for i in range(LANES)]
DIGEST = [f"g{i}" for i in range(4)]
KEY = ["depth", "fa", "fb"]


@dataclass
class Draw:
    """The multipliers of one try: ``base`` of the products, ``mix`` of the digests."""

    base: int
    mix: list[int]

    @classmethod
    def number(cls, n: int) -> Draw:
        rng = random.Random(n)
        return cls(rng.randrange(1 << 20, PRIME), [rng.randrange(1 << 20, PRIME) for _ in range(LANES)])


def _powers(base: int, n: int, modulus: int | None) -> np.ndarray:
    out = np.ones(n, np.int64)
    if modulus:
        for i in range(1, n):
            out[i] = out[i - 1] * base % modulus
    return out


def _running(values: list[str], base: int, modulus: int | None):
    """Running products in the rows of a sorted partition, beginning anew at each conv_id."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        up = _powers(base, BATCH + 1, modulus)
        down = _powers(pow(base, -1, modulus) if modulus else 1, BATCH + 1, modulus)

        def reduced(x: np.ndarray) -> np.ndarray:
            return x % modulus if modulus else x

        key, at0, power0, held = None, 0, 1, dict.fromkeys(values, 0)
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH):
                batch = whole.slice(low, BATCH)
                n = batch.num_rows
                conv = batch.column("conv_id").to_numpy()
                fresh = np.ones(n, bool)
                fresh[1:] = conv[1:] != conv[:-1]
                fresh[0] = conv[0] != key
                start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
                goes_on = start < 0  # rows of the conversation of the last batch
                begin = np.maximum(start, 0)
                size = np.arange(n) - begin + 1
                columns = {c: batch.column(c) for c in batch.schema.names}
                for v in values:
                    x = batch.column(v).to_numpy().astype(np.int64)
                    total = np.concatenate(([0], np.cumsum(reduced(x * down[:n]))))
                    own = reduced(up[:n] * reduced(total[1:] - total[begin]))
                    own = reduced(own + np.where(goes_on, reduced(held[v] * up[size]), 0))
                    columns[v], held[v] = pa.array(own), int(own[-1])
                at = size + np.where(goes_on, at0, 0)
                power = reduced(up[size] * np.where(goes_on, power0, 1))
                key, at0, power0 = conv[-1], int(at[-1]), int(power[-1])
                columns |= {"part": pa.array(np.full(n, part, np.int32)), "at": pa.array(at), "power": pa.array(power)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return scan


def _prefix_products(rows: DataFrame, order: list, values: list[str], base: int = 1, modulus: int | None = None) -> DataFrame:
    """``rows`` with ``values`` replaced by their running products within each conv_id in ``order``, their place
    ``at`` (from 1) and ``power`` = base^at.

    A conversation may lie in many range partitions: each makes its own products, and the product of all that
    went before (one element for each partition, put together on the driver) is multiplied on.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, at bigint, power bigint"
    local = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .mapInArrow(_running(values, base, modulus), schema), "products")
    element = ["at", "power", *values]
    ends = local.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max("conv_id").alias("last"),
        F.max_by(F.struct(*element), F.struct("conv_id", "at")).alias("e")).orderBy("part").collect()
    carried, held, held_of = [], None, None
    for r in ends:  # one row per partition
        e = r["e"].asDict()
        if held is not None and r["first"] == held_of:
            carried.append((r["part"], held_of, *(held[c] for c in element)))
            if r["first"] == r["last"]:
                e = {"at": held["at"] + e["at"], "power": held["power"] * e["power"],
                     **{v: held[v] * e["power"] + e[v] for v in values}}
                if modulus:
                    e = {c: x if c == "at" else x % modulus for c, x in e.items()}
        held, held_of = e, r["last"]
    spec = "part int, conv_id bigint, " + ", ".join(f"c_{c} bigint" for c in element)
    before = small(rows.sparkSession.createDataFrame(carried, spec))

    def reduced(c: Column) -> Column:
        return c % F.lit(modulus) if modulus else c

    def behind(v: str) -> Column:
        return reduced(F.coalesce(F.col(f"c_{v}"), F.lit(0)) * F.col("power") + F.col(v)).alias(v)

    out = local.join(before, ["part", "conv_id"], "left")
    made = out.select(*(c for c in rows.columns if c not in values), *map(behind, values),
                      (F.coalesce("c_at", F.lit(0)) + F.col("at")).alias("at"),
                      reduced(F.coalesce("c_power", F.lit(1)) * F.col("power")).alias("power"))
    made._saved_at = local._saved_at
    return made


def _stored_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes, row) of the turns, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return saved(conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("row"))
        .filter("conv_id is not null"), "turns")


def _lanes(draw: Draw) -> list[Column]:
    """The numbers that stand for a turn in the lanes, from its digest."""
    return [(F.pmod(F.col(DIGEST[i]), F.lit(PRIME)) * F.lit(draw.mix[i]) + F.pmod(F.col(DIGEST[(i + 1) % 4]), F.lit(PRIME)))
            % F.lit(PRIME) for i in range(LANES)]


def _packed(lanes: list[Column]) -> list[Column]:
    return [F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]).alias("fa"), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3]).alias("fb")]


def _members(turns: DataFrame, draw: Draw) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turns of the rebuilt conversation), and a row for every turn of every rebuilt conversation:
    its depth, the fingerprint of the turns up to it, and the stored turn (conv_id, place) it refers to."""
    halves = [F.conv(F.substring("digest", 1 + 16 * i, 16), 16, -10).cast("bigint").alias(DIGEST[i]) for i in range(4)]
    hashed = turns.select("conv_id", "turn", "bytes", "row", *halves)
    hashed = hashed.select("*", *(h.alias(p) for h, p in zip(_lanes(draw), FP)))
    unsigned = [F.col(g).bitwiseXOR(F.lit(-(1 << 63))) for g in DIGEST]  # the order of the digests as text
    own = _prefix_products(hashed, [F.col("conv_id"), F.col("turn").asc_nulls_first(), *unsigned, F.col("row")],
                           FP, draw.base, PRIME)
    early = F.when(F.col("at") < HEADS, F.struct("at", *FP, *DIGEST, "bytes"))
    convs = saved(own.groupBy("conv_id").agg(F.max("at").alias("n"), F.sort_array(F.collect_list(early)).alias("early")), "convs")
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    mine = convs.select("conv_id", "n", "early", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("early").alias("head"))
    heads = mine.join(bases, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(
        bases.schema["head"].dataType)), F.lit(1), F.col("h")))
    k = F.size("head")

    def product(early_: str, length: Column, lane: str) -> Column:
        return F.coalesce(F.get(F.col(early_), length - 1)[lane], F.lit(0))

    heads = saved(heads.select(
        "conv_id", "base", "n", "h", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("m"), "head",
        *(F.pmod(product("head", k, p) - product("early", F.col("h"), p), F.lit(PRIME)).alias(f"d_{p}") for p in FP)), "heads")
    columns = ["conv_id", "depth", "last", *DIGEST, "bytes", "ref_conv", "ref_turn", "fa", "fb"]
    shared = heads.select("conv_id", "base", "m", F.explode("head").alias("e")).select("conv_id", "base", "m", "e.*").select(
        "conv_id", F.col("at").alias("depth"), (F.col("at") == F.col("m")).alias("last"), *DIGEST, "bytes",
        F.col("base").alias("ref_conv"), F.col("at").alias("ref_turn"), *_packed([F.col(p) for p in FP]))
    back = pow(draw.base, -1, PRIME)
    quotient = F.array(*(F.lit(pow(back, i, PRIME)) for i in range(HEADS)))

    def composed(p: str) -> Column:
        moved = F.col(f"d_{p}") * F.col("power") % F.lit(PRIME) * F.get(quotient, F.col("h")) % F.lit(PRIME)
        return (F.col(p) + moved) % F.lit(PRIME)

    rest = own.join(heads.select("conv_id", "n", "h", "k", *(f"d_{p}" for p in FP)), "conv_id").filter("at > h").select(
        "conv_id", (F.col("k") + F.col("at") - F.col("h")).alias("depth"), (F.col("at") == F.col("n")).alias("last"), *DIGEST,
        "bytes", F.col("conv_id").alias("ref_conv"), F.col("at").alias("ref_turn"), *_packed([composed(p) for p in FP]))
    members = saved(shared.select(*columns).unionByName(rest.select(*columns)), "members")
    lengths = saved(heads.select("conv_id", "m"), "lengths")
    for table in (own, convs, heads):
        drop_saved(table)
    return lengths, members


def _nodes(members: DataFrame, draw: Draw) -> DataFrame | None:
    """The nodes below the root, with the key of their parent; None if turns of one node differ."""
    nodes = members.groupBy(*KEY).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"),
        F.min(F.struct("ref_conv", "ref_turn")).alias("ref"),
        *(F.min(g).alias(g) for g in DIGEST), *(F.max(g).alias(f"{g}_") for g in DIGEST))
    same = F.lit(True)
    for g in DIGEST:
        same &= F.col(g) == F.col(f"{g}_")
    low = (1 << 31) - 1
    lanes = [F.shiftright("fa", 31), F.col("fa").bitwiseAND(low), F.shiftright("fb", 31), F.col("fb").bitwiseAND(low)]
    back = F.lit(pow(draw.base, -1, PRIME))
    parent = [F.pmod(x - h, F.lit(PRIME)) * back % F.lit(PRIME) for x, h in zip(lanes, _lanes(draw))]
    pa_, pb = _packed(parent)
    nodes = saved(nodes.select(*KEY, "n_convs", "conv_id", "bytes", "ref.*", pa_.alias("pa"), pb.alias("pb"), same.alias("same")), "nodes")
    if nodes.filter("not same").limit(1).count():
        drop_saved(nodes)
        return None
    return nodes


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, first conv_id, the ids comma-joined), in pieces of bounded length."""
    key, first, held, size = None, 0, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(KEY, key), first=first, ids=",".join(held))],
                                          schema=pa.schema([(c, pa.int64()) for c in (*KEY, "first")] + [("ids", pa.string())]))

    for batch in batches:
        out = []
        for *now, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id"))):
            if now != key or size > CHUNK:
                if held:
                    out.append(piece())
                key, first, held, size = now, conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield from out
    if held:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of lists to one digest for each key; a list is never put together."""
    schema = pa.schema([(c, pa.int64()) for c in KEY] + [("ends_sha256", pa.string())])
    key, state = None, None
    for batch in batches:
        out = []
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if now != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest())))], schema=schema)


def _ends(lengths: DataFrame, members: DataFrame) -> DataFrame:
    """The digest of the ids of the conversations that end in each node that has any."""
    zero = [F.lit(0).cast("bigint").alias(c) for c in KEY]
    ends = members.filter("last").select(*KEY, "conv_id").unionByName(lengths.filter("m = 0").select(*zero, "conv_id"))
    order = [*KEY, "conv_id"]
    spec = "depth bigint, fa bigint, fb bigint"
    lists = saved(ends.repartitionByRange(*order).sortWithinPartitions(*order)
                  .mapInArrow(_lists, f"{spec}, first bigint, ids string"), "ends")
    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, f"{spec}, ends_sha256 string")


SCHEMA = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
          "saved_tokens bigint, ends_sha256 string, ref_conv bigint, ref_turn bigint")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Columns: conv_id (the smallest member) and depth, which name a node; parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256; ``ref_conv`` and ``ref_turn``, the stored turn (its place, from 1) that is
    the node's last.

    Turns are ordered by turn, null first; those of one conversation that share it, by a digest of role and
    text, so rows may repeat. Null roles and texts are empty ones. Rows without a conv_id
    belong to no conversation and are left out. An empty table has no nodes, not even a root. Other columns are ignored.

    The digest of a node's ends is a hash of one string, which one task reads in pieces.
    """
    spark = conversations.sparkSession
    turns = _stored_turns(conversations)
    for attempt in range(8):
        draw = Draw.number(attempt)
        lengths, members = _members(turns, draw)
        nodes = _nodes(members, draw)
        if nodes is not None:
            break
        drop_saved(lengths)
        drop_saved(members)
    else:
        raise ArithmeticError("turns with equal fingerprints differ under every draw")
    drop_saved(turns)
    whole = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if not whole["n"]:
        for table in (lengths, members, nodes):
            drop_saved(table)
        return spark.createDataFrame([], SCHEMA)
    kids = (nodes.filter("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("fa"), F.col("pb").alias("fb"))
            .agg(F.count("*").alias("n_children")))
    gain = (F.col("n_convs") - 1) * F.col("bytes")
    known = saved(nodes.join(kids, KEY, "left").select(
        "conv_id", *KEY, "pa", "pb", "n_convs", "ref_conv", "ref_turn", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        gain.alias("gain"), gain.alias("before")), "known")
    # a conversation is the smallest member of the lower end of its path: what those nodes hold belongs to it
    held = known.groupBy("conv_id").agg(F.sum("gain").alias("held"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    held = saved(held.filter("held > 0 or leaf > 0"), "held")
    below = members.select("conv_id", *KEY).join(held, "conv_id").groupBy(*KEY).agg(
        F.sum("held").alias("below"), F.sum("leaf").alias("n_leaves"))
    summed = _prefix_products(known, [F.col("conv_id"), F.col("depth")], ["before"])
    total = known.agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"), F.count_if(F.col("n_children") == 0).alias("leaves"),
                      F.count_if(F.col("depth") == 1).alias("children")).first()
    least = F.lit(whole["least"]).cast("bigint")
    parents = known.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"),
                           F.col("conv_id").alias("parent"))
    made = (summed.join(parents, ["depth", "pa", "pb"], "left").join(below, KEY)
            .withColumn("parent_conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("parent")))
            # of the smallest member, only what lies below this node counts
            .withColumn("saved_tokens", F.col("below") - F.col("before") + F.col("gain")))
    root = spark.createDataFrame(
        [(whole["least"], 0, 0, 0, None, whole["n"], total["children"], total["leaves"] or 1, total["gain"], None, None)],
        "conv_id bigint, depth bigint, fa bigint, fb bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, ref_conv bigint, ref_turn bigint")
    made = made.select(*root.columns).unionByName(root).join(_ends(lengths, members), KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    out = saved(made.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty))).select(
        *(c.split()[0] for c in SCHEMA.split(", "))), "trie")
    for table in (lengths, members, nodes, known, held, summed):
        drop_saved(table)
    return out
