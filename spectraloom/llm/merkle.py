"""A Merkle manifest: every row a leaf, a subtree a group, one root over all groups, and each leaf's proof.

Leaves of a group ascend by key and are cut into aligned blocks of ``FAN ** DEPTH``. A block is walked in postorder: a subtree
returns its digest, and while the walk unwinds, the siblings on the way are appended to the leaves that the subtree
contains. The blocks' digests are the leaves of another distributed walk, and so on until a group has one digest; the groups' digests go
the same way to the root. Proofs come down the other way: a block's siblings above are joined to it, and its walk puts them
behind those within. Sizes and starts are counted by Spark; only the number of rounds reaches the driver.

Nothing holds a whole group: places come from ranges of (group, key) that are numbered by themselves and added up, and a task
has one block of 4,096 leaves at a time. The text is read once, in the JVM; what is shuffled are digests.

Defined results: a null group is a group of its own and comes first; a null key comes first in its group; rows of one key are
ordered by their digests, so equal rows are interchangeable; a null field is ``-``, which no value is, as values carry their
length; extra columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.llm.common import ascii_lower, table
from spectraloom.sources.shared import Steps, written

FAN = 16
DEPTH = 3
BLOCK = FAN**DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(data: bytes) -> bytes:
    """Lowercase hex SHA-256 as ASCII bytes."""
    return hashlib.sha256(data).hexdigest().encode()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256, as 32 bytes, of the fields, each as its UTF-8 length, a colon and its text, or ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame, tampered: Column, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """key, group, leaf and found: the digest presented later, of the row with its text lower-cased where ``tampered``; else null."""
    changed = [ascii_lower(F.col(c)) if c == text else F.col(c) for c in fields]
    shown = F.when(tampered & F.col(text).isNotNull(), leaf_digest(changed))
    return docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("group"), leaf_digest([F.col(c) for c in fields]).alias("leaf"), shown.alias("found"))


def _count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by group, with the task and each row's place within its group there."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        runs = pc.run_end_encode(batch.column("group"))
        place, first = np.empty(batch.num_rows, np.int64), 0
        for value, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if value != last:
                last, n = value, 0
            place[first:end] = np.arange(n, n + end - first)
            n, first = n + end - first, end
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"]
        )


def _placed(rows: DataFrame, steps: Steps) -> DataFrame:
    """``rows`` (group not null) with ``at``, a gapless place from 0 in each group by key and leaf, and ``total``, the group's rows."""
    kind = rows.schema["key"].dataType.simpleString()
    by = ["group", F.asc_nulls_first("key"), "leaf"]
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = steps.written(ranges.mapInArrow(_count_up, f"key {kind}, group string, leaf binary, found binary, part int, place long"), "numbered")
    sizes = numbered.groupBy("group", "part").agg(F.count("*").alias("n"))
    of = Window.partitionBy("group")
    starts = sizes.select("group", "part", (F.sum("n").over(of.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(of).alias("total"))
    return numbered.join(starts, ["group", "part"]).select("group", (F.col("start") + F.col("place")).alias("at"), "total", "key", "leaf", "found")


def height_of(total: int) -> int:
    """Levels above the leaves of a block in a group of ``total`` leaves."""
    if total > BLOCK:
        return DEPTH
    height = 0
    while FAN**height < total:
        height += 1
    return height


def walk(nodes: list[bytes], first: int, height: int, paths: list[list] | None) -> bytes:
    """The digest of the subtree over ``nodes[first : first + FAN ** height]``.

    While it unwinds, each contained leaf's path gets the siblings' digests before and after its branch.
    """
    if not height:
        return nodes[first]
    step = FAN ** (height - 1)
    branches = range(first, min(first + FAN * step, len(nodes)), step)
    below = [walk(nodes, at, height - 1, paths) for at in branches]
    if paths is not None:
        for k, at in enumerate(branches):
            beside = (b"".join(below[:k]), b"".join(below[k + 1 :]))
            for path in paths[at : at + step]:
                path.append(beside)
    return digest(b"".join(below))


def fold(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and its path give."""
    for before, after in path:
        node = digest(before + node + after)
    return node


def _encoded(path: list[tuple[bytes, bytes]]) -> bytes:
    return b"/".join(before + b"." + after for before, after in path)


def _decoded(path: bytes) -> list[tuple[bytes, bytes]]:
    return [tuple(level.split(b".")) for level in path.split(b"/")] if path else []


def _pack(block: pa.Table) -> pa.Table:
    """One block as one row: its digest and its members in order."""
    block = block.combine_chunks().sort_by("at")
    n, total = block.num_rows, block.column("total")[0].as_py()
    nodes = [x.hex().encode() for x in block.column("leaf").to_pylist()]
    top = bytes.fromhex(walk(nodes, 0, height_of(total), None).decode())
    one = lambda c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), block.column(c).combine_chunks())
    at = block.column("at")[0].as_py() // BLOCK
    return pa.table({"group": block.column("group")[:1], "block": pa.array([at]), "total": pa.array([total]), "top": pa.array([top]), "keys": one("key"), "leaves": one("leaf"), "found": one("found")})


def climb(placed: DataFrame, rounds: int, steps: Steps) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and each group's digest: group, top."""
    tables = []
    for _ in range(rounds):
        kind = placed.schema["key"].dataType.simpleString()
        blocks = placed.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("group", "block").applyInArrow(_pack, f"group string, block long, total long, top binary, keys array<{kind}>, leaves array<binary>, found array<binary>")
        tables.append(steps.written(blocks, "blocks"))
        placed = tables[-1].select("group", F.col("block").alias("at"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("block").alias("key"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("found"))
    return tables, tables[-1].select("group", "top")


def _paths(row: pa.Table) -> tuple[list, list[bytes], list, list[list], list[tuple[bytes, bytes]], dict]:
    """Keys, leaves, found digests and paths within a block, the path above it, and the row's other values."""
    x = row.to_pylist()[0]
    nodes = [leaf.hex().encode() for leaf in x["leaves"]]
    paths: list[list] = [[] for _ in nodes]
    walk(nodes, 0, height_of(x["total"]), paths)
    return row.column("keys").combine_chunks().flatten(), nodes, x["found"], paths, _decoded(x["path"]), x


def _spread(row: pa.Table) -> pa.Table:
    """The whole path of each member of a block."""
    keys, nodes, _, paths, above, x = _paths(row)
    whole = [_encoded([*path, *above]) for path in paths]
    return pa.table({"group": pa.array([x["group"]] * len(nodes)), "member": keys, "path": pa.array(whole, pa.binary()), "root": pa.array([x["root"]] * len(nodes), pa.binary())})


def descend(tables: list[DataFrame], tops: DataFrame, last: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """From the groups' own paths (group, path, root) down to the first round's blocks, which ``last`` takes one by one."""
    above = tops.select("group", F.lit(0).cast("long").alias("block"), "path", "root")
    for k, blocks in reversed(list(enumerate(tables))):
        joined = blocks.join(above, ["group", "block"]).groupBy("group", "block")
        if not k:
            return last(joined)
        above = joined.applyInArrow(_spread, "group string, member long, path binary, root binary").withColumnRenamed("member", "block")
    raise ValueError("no blocks")


def _proved(row: pa.Table) -> pa.Table:
    """The leaves of a block with their proofs' digests and the roots folded anew."""
    keys, nodes, found, paths, above, x = _paths(row)
    root = x["root"].hex().encode()
    rest, known = b"".join(before + after for before, after in above), {}
    proofs, folded = [], []
    for node, shown, path in zip(nodes, found, paths, strict=True):
        proofs.append(hashlib.sha256(b"".join([s for beside in path for s in beside] + [rest])).hexdigest())
        top = fold(node if shown is None else shown.hex().encode(), path)
        if top not in known:  # untampered leaves of a block meet at its digest
            known[top] = fold(top, above)
        folded.append(known[top].decode())
    n = len(nodes)
    return pa.table(
        {
            "key": keys,
            "leaf": pa.array([x.decode() for x in nodes]),
            "subroot": pa.array([x["subroot"].hex()] * n),
            "root": pa.array([root.decode()] * n),
            "proof_sha256": pa.array(proofs),
            "folded_root": pa.array(folded),
            "verified": pa.array([f == root.decode() for f in folded]),
        }
    )


def _rounds(totals: DataFrame) -> int:
    most, rounds = totals.agg(F.max("total")).first()[0] or 0, 1
    while BLOCK**rounds < most:
        rounds += 1
    return rounds


def manifest(rows: DataFrame) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified for each of ``rows`` (key, group, leaf, found; see ``leaves``).

    ``proof_sha256`` is the digest of all siblings' digests, level by level from the leaf; ``folded_root`` is the root that
    ``found``, else the leaf, gives with the original siblings.
    """
    steps = Steps(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    named = F.coalesce(F.concat(F.lit("="), "group"), F.lit("-"))  # null comes first, then bytewise
    rows = steps.written(rows.withColumn("group", named).select("key", "group", "leaf", "found"), "leaves")
    placed = steps.written(_placed(rows, steps), "placed")
    tables, subroots = climb(placed, _rounds(placed), steps)

    one = subroots.select(F.col("group").alias("key"), F.lit("all").alias("group"), F.col("top").alias("leaf"), F.lit(None).cast("binary").alias("found"))
    upper = steps.written(_placed(one, steps), "subroots")
    uppers, root = climb(upper, _rounds(upper), steps)
    tops = root.select("group", F.lit(b"").alias("path"), F.col("top").alias("root"))
    of_group = descend(uppers, tops, lambda g: g.applyInArrow(_spread, "group string, member string, path binary, root binary"))
    of_group = steps.written(of_group.select(F.col("member").alias("group"), "path", "root"), "group-paths")

    own = subroots.withColumnRenamed("top", "subroot")
    last = lambda g: g.applyInArrow(_proved, f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    proved = written(descend([tables[0].join(own, "group"), *tables[1:]], of_group, last), "manifest")
    steps.drop()
    return proved


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; where 5 divides the CRC-32 of the decimal id, a text lower-cased is presented."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return manifest(leaves(table(spark, sf_dir, "documents"), tampered)).withColumnRenamed("key", "doc_id")


def _sql(levels: int = 8) -> str:
    """``levels`` of each tree: 16 ** 8 leaves a source."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    fields = lambda text: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "flatten(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: [('0x' || x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"leaf AS (SELECT doc_id, source, {fields('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {fields(low)} END AS found FROM documents)",
        "d AS (SELECT *, coalesce('=' || source, '-') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS total FROM leaf)",
    ]

    def tree(name: str) -> None:
        for k in range(levels):
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT grp, pos // 16 AS pos, list(digest ORDER BY pos) AS kids, any_value(total) AS total FROM {name}{k} GROUP BY 1, 2)")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT grp, pos, CASE WHEN total > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS digest, (total + 15) // 16 AS total FROM {name}r{k})")

    def paths(name: str, way: str) -> None:
        for k in range(levels):
            before, after = "array_to_string(r.kids[1:p.pos % 16], '')", "array_to_string(r.kids[p.pos % 16 + 2:], '')"
            out.append(
                f"{way}{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (pos, proof, node), p.pos // 16 AS pos, p.proof || CASE WHEN r.total > 1 THEN {before} || {after} ELSE '' END AS proof, "
                f"CASE WHEN r.total > 1 THEN sha256({before} || p.node || {after}) ELSE p.node END AS node FROM {way}{k} p JOIN {name}r{k} r ON p.grp = r.grp AND p.pos // 16 = r.pos)"
            )

    out.append("n0 AS MATERIALIZED (SELECT grp, pos, leaf AS digest, total FROM d)")
    tree("n")
    out.append(f"s AS MATERIALIZED (SELECT grp AS own, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS total FROM n{levels})")
    out.append("t0 AS MATERIALIZED (SELECT 'all' AS grp, pos, subroot AS digest, total FROM s)")
    tree("t")
    out.append("p0 AS MATERIALIZED (SELECT doc_id, leaf, grp, pos, '' AS proof, coalesce(found, leaf) AS node FROM d)")
    paths("n", "p")
    out.append(f"q0 AS MATERIALIZED (SELECT p.doc_id, p.leaf, s.subroot, 'all' AS grp, s.pos, p.proof, p.node FROM p{levels} p JOIN s ON p.grp = s.own)")
    paths("t", "q")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.digest AS verified FROM q{levels} q JOIN t{levels} t ON true"


ORACLE_SQL = _sql()
