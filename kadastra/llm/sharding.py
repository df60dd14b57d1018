"""Operator 5: k-d tree sharding.

Rows live in a space of metadata dimensions. A node of the tree is split along the dimension in which its rows
spread widest, at the weighted median found by counting weights in ever finer bins; splitting ends when the leaves
reach the target bytes. All dimensions are functions of the text alone, so equal texts share a point and thereby a
shard; ties in a dimension are broken by a hash of the text, so any two different texts can be parted.

Only DataFrame operations are used. The driver sees bin sums (nodes x BINS rows), never rows of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kadastra.llm.common import materialize, text_bytes

#: Bins of one round of the median search.
BINS = 1024
#: The search ends when the bin with the median holds at most this share of its node's bytes.
TOLERANCE = 0.0005
#: Bits of a dimension's value, and of the hash behind it.
BITS = 31
#: Rows of one slot bucket, about.
BUCKET_ROWS = 1000


@dataclass
class Node:
    leaves: int
    first: int
    dim: int = -1
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def dimensions(text: Column) -> list[Column]:
    """The metadata dimensions of a text: size, share of multi-byte characters, length of its lines."""
    t = F.coalesce(text, F.lit(""))
    size, chars = F.octet_length(t).cast("double"), F.char_length(t).cast("double")
    lines = chars - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return [F.log2(size + 1), size / F.greatest(chars, F.lit(1.0)), F.log2(1 + chars / lines)]


def _leaf(node: Node, keys: list[Column], leaf_id) -> Column:
    if node.left is None:
        return F.lit(leaf_id(node))
    return F.when(keys[node.dim] < F.lit(node.cut), _leaf(node.left, keys, leaf_id)).otherwise(_leaf(node.right, keys, leaf_id))


def _open(node: Node) -> list[Node]:
    if node.left is None:
        return [node] if node.leaves > 1 else []
    return _open(node.left) + _open(node.right)


def build_tree(points: DataFrame, dims: int, shards: int) -> Node:
    """A tree with ``shards`` leaves over ``points``, with columns k0, k1, ... (longs) and weight.

    A node of n leaves gives floor(n / 2) of them, and that share of its bytes, to its left side.
    """
    root = Node(leaves=shards, first=0)
    keys = [F.col(f"k{d}") for d in range(dims)]
    while open_nodes := _open(root):
        for number, node in enumerate(open_nodes):
            node.number = number
        of = _leaf(root, keys, lambda n: n.number if n.leaves > 1 else -1)
        inside = points.withColumn("node", of).where("node >= 0")
        ends = inside.groupBy("node").agg(F.sum("weight").alias("weight"), *(f(f"k{d}").alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max))))
        state = {}
        for r in ends.collect():
            width = [r[f"hi{d}"] - r[f"lo{d}"] for d in range(dims)]
            dim = max(range(dims), key=lambda d: width[d])
            node = open_nodes[r["node"]]
            state[r["node"]] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"] + 1, "below": 0, "all": r["weight"], "goal": r["weight"] * (node.leaves // 2) / node.leaves}
        done: dict[int, int] = {}
        while pending := {k: s for k, s in state.items() if k not in done}:
            for k, s in pending.items():
                s["step"] = -(-(s["hi"] - s["lo"]) // BINS)
            case = lambda f: reduce(lambda c, k: c.when(F.col("node") == k, f(pending[k])), list(pending)[1:], F.when(F.col("node") == list(pending)[0], f(pending[list(pending)[0]])))
            value = case(lambda s: keys[s["dim"]])
            lo, hi, step = (case(lambda s, n=n: F.lit(s[n])) for n in ("lo", "hi", "step"))
            binned = inside.where(F.col("node").isin(list(pending))).select("node", "weight", value.alias("v"), lo.alias("lo"), hi.alias("hi"), step.alias("step")).where("v >= lo and v < hi")
            sums: dict[int, dict[int, int]] = {}
            for r in binned.groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("weight").alias("weight")).collect():
                sums.setdefault(r["node"], {})[r["bin"]] = r["weight"]
            for k, s in pending.items():
                below, at = s["below"], 0
                for at in sorted(sums.get(k, {0: 0})):
                    if below + sums.get(k, {0: 0})[at] >= s["goal"]:
                        break
                    below += sums.get(k, {0: 0})[at]
                held = sums.get(k, {}).get(at, 0)
                lo_at, hi_at = s["lo"] + at * s["step"], min(s["hi"], s["lo"] + (at + 1) * s["step"])
                if s["step"] == 1 or held <= TOLERANCE * s["all"]:
                    done[k] = lo_at if s["goal"] - below <= below + held - s["goal"] else hi_at
                else:
                    s |= {"lo": lo_at, "hi": hi_at, "below": below}
        for number, node in enumerate(open_nodes):
            half = node.leaves // 2
            node.left, node.right = Node(half, node.first), Node(node.leaves - half, node.first + half)
            if number in state:
                node.dim, node.cut = state[number]["dim"], done[number]
            else:
                node.dim, node.cut = 0, 0
    return root


def shard(docs: DataFrame, shards: int = 8, text: str = "text", row_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Deal all rows to ``shards`` leaves of near equal bytes; slots are numbered without gaps in each.

    A row weighs its text's UTF-8 bytes plus 1. Equal texts share a shard, so one group of copies larger than a
    shard makes that shard larger. Null texts count as empty and share a shard with empty ones; null ids and
    repeated rows are rows like any other; an empty table gives an empty result. Returns the row id, size,
    text_crc32, shard, slot and the columns named in ``keep``; other columns, whatever they are called, are not read.
    """
    dims = dimensions(F.col(text))
    t = F.coalesce(F.col(text), F.lit(""))
    columns = [F.col(row_id).alias("row_id"), (text_bytes(F.col(text)) + 1).alias("weight"), F.crc32(F.encode(t, "UTF-8")).alias("crc"), F.xxhash64(t).alias("h"), *(d.alias(f"d{i}") for i, d in enumerate(dims))]
    points = materialize(docs.select(*columns), "kd-points")
    ends = points.agg(F.count("*").alias("n"), *(f(f"d{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max)))).first()

    def key(i: int) -> Column:
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        unit = (F.col(f"d{i}") - F.lit(lo)) / F.lit((hi - lo) or 1.0)
        return F.shiftleft(F.floor(unit * F.lit(float((1 << BITS) - 1))).cast("long"), BITS) + F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))

    kept = [f"keep_{i}" for i in range(len(keep))]
    names = ["row_id", "weight", "crc"]
    buckets = max(1, -(-ends["n"] // (shards * BUCKET_ROWS)))
    keyed = points.select(*names, *(key(i).alias(f"k{i}") for i in range(len(dims))))
    leaf = _leaf(build_tree(keyed, len(dims), shards), [F.col(f"k{d}") for d in range(len(dims))], lambda n: n.first).cast("int").alias("shard")
    bucket = F.pmod(F.xxhash64("row_id", "crc"), F.lit(buckets)).alias("bucket")
    placed = keyed.select(*names, leaf, bucket)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if keep:  # only now are the other columns read
        rows = docs.select(*columns, *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)))
        placed = rows.select(*names, *kept, *(key(i).alias(f"k{i}") for i in range(len(dims)))).select(*names, *kept, leaf, bucket)
    inside = Window.partitionBy("shard", "bucket").orderBy("row_id", "crc", "weight")
    slots = placed.withColumn("at", F.row_number().over(inside)).join(offsets, ["shard", "bucket"])
    return slots.select(F.col("row_id").alias(row_id), F.col("weight").alias("size"), F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"), *(F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    from kadastra.llm.common import table

    placed = shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
