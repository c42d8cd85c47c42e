"""Merkle manifest of a dataset: one tree a group, one over the groups' roots.

Checkpoint and recompute: of a tree only every ``EVERY``-th level is stored, cut
into aligned subtrees. A row of a stored level holds up to 2^EVERY neighbouring
nodes, those under one node of the next stored level. Whatever needs a node
between two stored levels (the next level, or a proof) makes it again from its
subtree's row and throws it away.

Building goes up: leaves are numbered within their group (range partitions, no
group in one task), gathered into rows, and each row is hashed to one node of
the next stored level, until every group has one. Proofs go down: a row gets
the siblings above it, adds those inside it, and hands them to the rows (at the
leaves: to the documents) below. Leaves are hashed in the JVM from the text;
only digests and ids are shuffled.

A hash takes its inputs concatenated, digests as lowercase hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import written
from evalspark.operators.common import sized_broadcast

EVERY = 8  # levels from one stored level to the next
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WIDTH = 32  # bytes of a digest
_ALONE, _RIGHT, _LEFT = 0, 1, 2  # where a node's sibling is
_ROW_BITS = 33


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


# ------------------------------------------------------------ inside one row

def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def climb(nodes: list[bytes], levels: int | None) -> list[list[bytes]]:
    """A subtree's levels from ``nodes`` (hex digests) up: ``levels`` more of
    them, or as many as it takes to one node."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        row = out[-1]
        out.append([_hash(b"".join(row[i:i + 2])) for i in range(0, len(row), 2)])
    return out


def path(tree: list[list[bytes]], i: int) -> list[tuple[int, bytes]]:
    """The siblings of node ``i`` of the lowest level, level by level."""
    steps = []
    for row in tree[:-1]:
        other = i ^ 1
        steps.append((_ALONE, b"") if other >= len(row) else (_LEFT if i & 1 else _RIGHT, row[other]))
        i >>= 1
    return steps


def fold(node: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a node and the siblings on its way up make."""
    for side, other in steps:
        node = _hash(other + node if side == _LEFT else node + other)
    return node


def _packed(steps: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + bytes.fromhex(other.decode()) for side, other in steps)


def _unpacked(data: bytes) -> list[tuple[int, bytes]]:
    steps, at = [], 0
    while at < len(data):
        end = at + 1 + (_WIDTH if data[at] != _ALONE else 0)
        steps.append((data[at], data[at + 1:end].hex().encode()))
        at = end
    return steps


def _nodes(data: bytes) -> list[bytes]:
    return [data[i:i + _WIDTH].hex().encode() for i in range(0, len(data), _WIDTH)]


def _tree(row: dict, every: int) -> list[list[bytes]]:
    """A stored row's subtree; the one row of a group's last stored level goes
    up to the group's root."""
    return climb(_nodes(row["digests"]), every if row["level_nodes"] > 1 << every else None)


# --------------------------------------------------------------- stored levels

def _numbered(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``index``, the place in the group, and ``level_nodes``, its size.

    Rows are range-partitioned and sorted, then numbered from the partitions'
    counts. Rows that agree in all of ``order`` are alike, so where they go
    makes no difference; a number of their own spreads them over partitions."""
    ranged = written(
        leaves.withColumn("_like", F.monotonically_increasing_id())
        .repartitionByRange("grp", *order, "_like").sortWithinPartitions("grp", *order, "_like").drop("_like")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", _ROW_BITS)), "merkle-leaves")
    parts = ranged.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("grp")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition and each group that begins in it.
    parts = parts.select("grp", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         F.sum("_n").over(group).alias("level_nodes"))
    joined = ranged.join(sized_broadcast(parts), ["grp", "_part"])
    return joined.withColumn("index", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_part", "_at", "_first", "_before")


def _rows_of(nodes: DataFrame, every: int, extra: Sequence[str] = ()) -> DataFrame:
    """Aligned rows of up to 2^every nodes; ``extra`` columns as arrays."""
    cells = F.array_sort(F.collect_list(F.struct("index", "digest", *extra)))
    packed = nodes.groupBy("grp", F.shiftright("index", every).alias("row"), "level_nodes").agg(cells.alias("c"))
    digests = F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["digest"])), ""))
    return packed.select("grp", F.col("row").alias("index"), "level_nodes", digests.alias("digests"),
                         *[F.col(f"c.{x}").alias(x) for x in extra])


def _raised(every: int):
    """Each row's node of the next stored level, or its group's root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            top = [bytes.fromhex(_tree(r, every)[-1][0].decode()) for r in rows]
            left = [-(-r["level_nodes"] >> every) if r["level_nodes"] > 1 << every else 1 for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("grp"), batch.column("index"), pa.array(left, pa.int64()), pa.array(top, pa.binary())],
                names=["grp", "index", "level_nodes", "digest"])
    return run


def _build(first: DataFrame, every: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(stored levels from the leaves up, (``grp``, ``digest``) of the roots).

    Groups that have their root drop out of the levels above."""
    levels, roots = [written(first, f"{name}-0")], None
    while True:
        here = levels[-1]
        up = here.select("grp", "index", "level_nodes", "digests").mapInArrow(
            _raised(every), "grp string, index bigint, level_nodes bigint, digest binary")
        last = here.agg(F.max("level_nodes").alias("n")).first()["n"]
        if last is None or last <= 1 << every:
            done = up.select("grp", "digest")
            return levels, written(done if roots is None else roots.unionByName(done), f"{name}-roots")
        up = written(up, f"{name}-nodes-{len(levels)}")
        done = up.filter("level_nodes = 1").select("grp", "digest")
        roots = done if roots is None else roots.unionByName(done)
        levels.append(written(_rows_of(up.filter("level_nodes > 1"), every), f"{name}-{len(levels)}"))


@dataclass
class Manifest:
    """Stored levels of the groups' trees and of the tree over their roots
    (lists of DataFrames from the leaves up, read from written tables), the
    groups' roots (``grp``, ``digest``) and the root."""

    levels: list[DataFrame]
    top_levels: list[DataFrame]
    subroots: DataFrame
    root: DataFrame
    every: int


def build_manifest(docs: DataFrame, columns: Sequence[str] = FIELDS, group_col: str = "lang",
                   order_col: str = "doc_id", every: int = EVERY,
                   claimed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``: a leaf a row, hashed from ``columns``; a tree
    for each value of ``group_col``, leaves by ``order_col`` (nulls first, rows
    of one id by digest); a tree over the groups' roots by group (null first).

    ``claimed``: other values of columns, for the leaves that ``proofs`` checks
    against the manifest; without it the leaves themselves are checked.

    Defined cases: nulls are hashed as ``-``, apart from empty texts; repeated
    rows are leaves each; a lone leaf is its group's root, and a lone group's
    root the root; an empty table has no rows and no root.
    """
    group = _col(group_col)
    values = {c: _col(c) for c in columns}
    leaf = leaf_digest([values[c] for c in columns])
    other = leaf_digest([{**values, **(claimed or {})}[c] for c in columns]) if claimed else F.lit(None).cast("binary")
    leaves = docs.select(
        # Null groups first, and apart from the empty string.
        F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string"))).alias("grp"),
        _col(order_col).alias("id"), leaf.alias("digest"), other.alias("claim"))
    # A claim that is the leaf itself isn't stored twice.
    leaves = leaves.withColumn("claim", F.when(F.col("claim") != F.col("digest"), F.col("claim")))
    rows = _rows_of(_numbered(leaves, ["id", "digest", "claim"]), every, ["id", "claim"])
    levels, subroots = _build(rows, every, "merkle")
    over = _numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest"), ["id"])
    top_levels, root = _build(_rows_of(over, every, ["id"]), every, "merkle-top")
    return Manifest(levels, top_levels, subroots, root, every)


# --------------------------------------------------------------------- proofs

_ABOVE = "grp string, index bigint, above binary, subroot binary"


def _lowered(every: int, groups: bool):
    """The siblings above each node of a level, from those above its row, and
    the group's root. ``groups``: the nodes are groups' roots and known by
    ``id``, else by their index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {"grp": [], "index": [], "above": [], "subroot": []}
            for row in batch.to_pylist():
                tree = _tree(row, every)
                for i, node in enumerate(tree[0]):
                    cols["grp"].append(row["id"][i] if groups else row["grp"])
                    cols["index"].append((row["index"] << every) + i)
                    cols["above"].append(_packed(path(tree, i)) + row["above"])
                    cols["subroot"].append(bytes.fromhex(node.decode()) if groups else row["subroot"])
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)],
                                             names=list(cols))
    return run


def _proved(every: int, root: bytes, siblings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type.value_type
            ids, claims = batch.column("id"), batch.column("claim")
            for k, row in enumerate(batch.drop_columns(["id", "claim"]).to_pylist()):
                tree, above = _tree(row, every), _unpacked(row["above"])
                claim, n = claims[k].as_py(), len(tree[0])
                proofs, sums, roots = [], [], []
                for i, node in enumerate(tree[0]):
                    steps = path(tree, i) + above
                    others = [s for side, s in steps if side != _ALONE]
                    sums.append(_hash(b"".join(others)).decode())
                    roots.append(fold(claim[i].hex().encode() if claim[i] is not None else node, steps).decode())
                    if siblings:
                        proofs.append([s.decode() for s in others])
                cols = {"grp": pa.array([row["grp"]] * n, pa.string()), "id": ids[k].values.cast(kind),
                        "leaf": pa.array([x.decode() for x in tree[0]], pa.string()), "proof_sha256": pa.array(sums, pa.string()),
                        "folded_root": pa.array(roots, pa.string())}
                cols["subroot"] = pa.array([row["subroot"].hex()] * n, pa.string())
                cols["root"] = pa.array([root.decode()] * n, pa.string())
                if siblings:
                    cols["siblings"] = pa.array(proofs, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def proofs(manifest: Manifest, siblings: bool = False) -> DataFrame:
    """One row per leaf: ``grp``, ``id``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (of the siblings on the way to the root, level by level),
    ``folded_root`` (from the claimed leaf and those siblings) and ``verified``;
    with ``siblings`` the siblings themselves."""
    every = manifest.every
    kind = manifest.levels[0].schema["id"].dataType.elementType.simpleString()
    got = manifest.root.first()  # one digest
    root = bytes(got["digest"]).hex().encode() if got else b""
    above = None
    for tables in (manifest.top_levels, manifest.levels):
        leaves, groups = tables is manifest.levels, above  # siblings above the groups' roots
        for k in range(len(tables) - 1, -1, -1):
            rows, last = tables[k], F.col("level_nodes") <= 1 << every
            if groups is None:
                found = rows.filter(last).withColumns({"above": F.lit(b""), "subroot": F.lit(b"")})
            else:
                found = rows.filter(last).join(groups.drop("index"), "grp")
            if k + 1 < len(tables):
                found = found.unionByName(rows.filter(~last).join(above, ["grp", "index"]))
            if leaves and k == 0:
                break
            named = ["id"] if k == 0 else []  # the leaves of the upper tree are the groups
            found = found.select("grp", "index", "level_nodes", "digests", "above", "subroot", *named)
            above = written(found.mapInArrow(_lowered(every, bool(named)), _ABOVE), "merkle-above")
    out = f"grp string, id {kind}, leaf string, proof_sha256 string, folded_root string, subroot string, root string"
    return (found.mapInArrow(_proved(every, root, siblings), out + ", siblings array<string>" * siblings)
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def changed_counts(id_col: str = "doc_id", count_col: str = "n_chars") -> Column:
    """``n_chars`` one higher where 7 divides crc32 of the id as text."""
    n = _col(count_col)
    hit = F.crc32(_col(id_col).cast("string").cast("binary")) % 7 == 0
    return F.when(F.coalesce(hit, F.lit(False)), (n.cast("decimal(20,0)") + 1).cast("string")).otherwise(n.cast("string"))
