"""A Merkle manifest of a table in an external node store: a tree a group, and a tree over the groups' roots.

Leaves are digests of rows. They are written once, dealt by range of (group, order) and sorted, so each file is a sorted
run; positions within a group come from the runs' counts. Every level of the store is a folder `level=k` of Parquet
files that is made by one sequential pass over the files of the level below: of each run of consecutive nodes that has
all three children of a parent, the pass writes the parent. The children at the edges of files, four at most for a file and a
group's last, are put together by a small aggregation. A group whose only node is at place 0 is done; it has its root. The roots
are the leaves of one more such store.

A proof of a node is the list of its siblings, level by level. Proofs go from the top down in bands of LEVELS levels: the nodes
of a band are dealt by the subtree they are in (3**LEVELS lowest nodes at most, so a large group is many subtrees), sorted
by level and place, and scanned together with the proof of each subtree's top: a merge scan by coordinate, which holds the proofs
of two neighbouring levels of one subtree. Only digests and places move, texts never.

Defined results: a null column is '-'; null groups are one group, first of all; a null order value comes first; rows that
share group and order value follow each other by digest, equal rows in any order (each has its own place and proof); an
empty table has no rows and no root; very long texts are hashed whole; columns that aren't named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recurra.llm import textnum as tn
from recurra.llm.scratch import Scratch, small_batches, tasks

WIDTH = 3
#: Levels of a band of proofs: subtrees of 3**LEVELS lowest nodes.
LEVELS = 7
ROWS = 10_000


def encoded(*columns: Column) -> Column:
    """The columns one after the other, each '-' if null, else byte count, ':' and value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat(*map(one, columns))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Store:
    """leaves(grp, pos, digest, payload...) is level 0; levels: nodes(grp, pos, digest) of each level from 1 on, in sorted runs; roots(grp, level, digest): a row a group."""

    leaves: DataFrame
    levels: list[DataFrame]  # from level 1 on
    roots: DataFrame
    scratch: Scratch

    def drop(self) -> None:
        self.scratch.drop(self.leaves, self.roots, *self.levels)


def placed(leaves: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """leaves(grp, ord, digest, ...) as written sorted runs with `pos`, the place within the group; ord is dropped."""
    spark = leaves.sparkSession
    keyed = scratch.save(leaves.withColumn("salt", F.monotonically_increasing_id()))  # fixes the salt, and spares the range sampling the work before
    order = ["grp", "ord", "digest", "salt"]
    runs = keyed.repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order).drop("salt", "ord").withColumn("run", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    at = runs.columns.index("grp")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place = None, -1
        for b in batches:
            nth = []
            for grp in b.column(at).to_pylist():
                place = place + 1 if grp == last else 0
                last = grp
                nth.append(place)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth, pa.int64())], [*b.schema.names, "nth"])

    written = scratch.save(runs.mapInArrow(tn.released(count), f"{schema}, nth long"), name)
    scratch.drop(keyed)
    sizes = written.groupBy("grp", "run").agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))  # a row a run at most
    # of a run, its first group alone can have begun in an earlier one: no more rows than runs
    begun = sizes.withColumn("before", before).where("before > 0").select(F.col("grp").alias("g"), F.col("run").alias("r"), "before")
    at = written.join(F.broadcast(scratch.save(begun)), (F.col("run") == F.col("r")) & F.col("grp").eqNullSafe(F.col("g")), "left")
    return at.withColumn("pos", F.col("nth") + F.coalesce("before", F.lit(0))).drop("run", "nth", "r", "g", "before")


def build(leaves: DataFrame, scratch: Scratch, name: str) -> Store:
    """The store of leaves(grp, ord, digest, ...), in folders name/level=k."""
    small_batches(leaves.sparkSession)
    first = placed(leaves, scratch, f"{name}/level=0")
    below, levels, roots = first.select("grp", "pos", "digest"), [], None
    n_runs = tasks(leaves.sparkSession)
    kind = first.schema["grp"].dataType.simpleString()
    schema = f"grp {kind}, pos long, digest string, child long"
    while True:
        # one pass: whole parents (child null), and children at the edges of runs
        n_runs = max(1, -(-n_runs // WIDTH))
        seen = scratch.save(below.coalesce(n_runs).mapInArrow(tn.released(_parents), schema), f"{name}/level={len(levels) + 1}/runs")
        edge = seen.where("child is not null").groupBy("grp", "pos").agg(F.array_sort(F.collect_list(F.struct("child", "digest"))).alias("c"))
        alone = F.when((F.size("c") == 1) & (F.col("pos") == 0), F.col("c")[0]["digest"])
        edge = edge.select("grp", "pos", alone.alias("root"), digest(F.concat_ws("", F.transform("c", lambda x: x["digest"]))).alias("digest"))
        edge = scratch.save(edge, f"{name}/level={len(levels) + 1}/edges")
        done = edge.where("root is not null").select("grp", F.lit(len(levels)).alias("level"), F.col("root").alias("digest"))
        roots = done if roots is None else roots.unionByName(done)
        up = seen.where("child is null").select("grp", "pos", "digest").unionByName(edge.where("root is null").select("grp", "pos", "digest"))
        if up.isEmpty():
            return Store(first, levels, roots, scratch)
        levels.append(up)
        below = up


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents of three consecutive children in the order read; children of parents that aren't whole there, with their place (child)."""
    out: list[tuple] = []
    held: list[tuple] = []  # (pos, digest) of one parent

    def close(grp) -> None:
        held.sort()  # of parents put together below, a file has some in any order
        if len(held) == WIDTH:
            out.append((grp, held[0][0] // WIDTH, sha("".join(d for _, d in held)), None))
        else:
            out.extend((grp, p // WIDTH, d, p) for p, d in held)
        held.clear()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.int64()))], ["grp", "pos", "digest", "child"])

    grp, kind = None, None
    for b in batches:
        kind = b.column(0).type
        for g, p, d in zip(*(b.column(k).to_pylist() for k in range(3))):
            if held and (g != grp or p // WIDTH != held[0][0] // WIDTH):
                close(grp)
            grp = g
            held.append((p, d))
        if len(out) >= ROWS:
            yield flush()
    if held:
        close(grp)
    if out:
        yield flush()


# ---- proofs


def proofs(store: Store, tops: DataFrame) -> DataFrame:
    """leaves of the store (grp, payload...) with (leaf, path, proof, top). tops(grp, path, proof, top): the proof of each group's root from there on, and what else goes down with it.

    proof: the siblings' digests one after the other, level by level; path: two digits a level, the node's place in its run and its number of siblings.
    """
    payload = [c for c in store.leaves.columns if c not in ("grp", "pos", "digest")]
    bands = max(1, -(-len(store.levels) // LEVELS))
    state = ["path", "proof", "top"]
    known = store.roots.join(tops, store.roots["grp"].eqNullSafe(tops["grp"])).select(store.roots["grp"], "level", F.lit(0).cast("long").alias("pos"), *state)
    known = store.scratch.save(known)
    parts = known
    none = [F.lit(None).cast("string").alias(c) for c in state]
    for band in reversed(range(bands)):
        low, high = band * LEVELS, min((band + 1) * LEVELS, len(store.levels) + 1)
        here = parts.where(F.col("level").between(low + (1 if band else 0), (band + 1) * LEVELS)).select("grp", "level", "pos", F.lit(None).cast("string").alias("digest"), *state)
        for level in range(low, high):
            nodes = store.leaves if level == 0 else store.levels[level - 1]
            rows = nodes.select("grp", F.lit(level).alias("level"), "pos", "digest", *none, *(payload if level == 0 else ()))
            here = here.unionByName(rows, allowMissingColumns=True)
        per = F.lit(WIDTH).cast("long")
        chunk = here.withColumn("chunk", F.floor(F.col("pos") / F.element_at(F.array(*(F.lit(WIDTH**k).cast("long") for k in range(LEVELS + 1))), (F.lit((band + 1) * LEVELS) - F.col("level") + 1).cast("int"))))
        dealt = chunk.repartition(tasks(store.scratch.spark), "grp", "chunk").sortWithinPartitions("grp", "chunk", F.desc("level"), F.col("digest").isNotNull(), "pos")
        extra = [f for f in dealt.schema if f.name in payload] if band == 0 else []
        columns = dealt.select("grp", "chunk", "level", "pos", "digest", *state, *(f.name for f in extra))
        names = ["grp", "level", "pos", "digest", *state, *(f.name for f in extra)]
        schema = ", ".join(f"`{n}` {columns.schema[n].dataType.simpleString()}" for n in names)
        got = columns.mapInArrow(tn.released(_scan(low, names)), schema)
        if band == 0:
            return got.select("grp", *payload, F.col("digest").alias("leaf"), *state)
        entering = known.where(F.col("level") <= low)
        parts = store.scratch.save(got.select("grp", "level", "pos", *state)).unionByName(entering)
    raise AssertionError


def _scan(low: int, names: list[str]):
    """Of sorted rows of subtrees: the nodes of level `low` with their proofs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, level = None, None
        above: dict[int, tuple] = {}  # proofs by place, of the level above the one being read
        own: dict[int, tuple] = {}  # of this level, those given from outside included
        held: list[tuple] = []
        out: list[tuple] = []
        kinds = None

        def close() -> None:
            if not held:
                return
            parent = above.get(held[0][0] // WIDTH)
            if parent is None and held[0][0] not in own and len(held) == 1 and held[0][0] == 0:
                held.clear()  # a group's root at the edge of this band: its proof is given to the band below
            for k, (pos, digest, rest) in enumerate(held):
                if (mine := own.get(pos)) is None:
                    sides = [d for o, (_, d, _) in enumerate(held) if o != k]
                    mine = own[pos] = (f"{k}{len(sides)}{parent[0]}", "".join(sides) + parent[1], parent[2])
                if level == low:
                    out.append((at[0], level, pos, digest, *mine, *rest))
            held.clear()
            if level == low:
                own.clear()

        for b in batches:
            kinds = [b.schema.field(n).type for n in names]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                grp, chunk, lv, pos, digest, *state = row
                if (grp, chunk) != at:
                    close()
                    at, level, above, own = (grp, chunk), lv, {}, {}
                elif lv != level:
                    close()
                    above, own = (own if lv == level - 1 else {}), {}
                    level = lv
                if digest is None:
                    own[pos] = tuple(state[:3])
                else:
                    if held and held[0][0] // WIDTH != pos // WIDTH:
                        close()
                    held.append((pos, digest, state[3:]))
            if len(out) >= 500:
                yield _rows(out, kinds, names)
        close()
        if out:
            yield _rows(out, kinds, names)

    return run


def _rows(out: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
    out.clear()
    return pa.RecordBatch.from_arrays(columns, names)


def fold(leaf: str, path: str, proof: str) -> str:
    """The root that a leaf and its siblings give."""
    at = 0
    for k in range(0, len(path), 2):
        place, n = int(path[k]), int(path[k + 1])
        sides = [proof[at + 64 * i : at + 64 * (i + 1)] for i in range(n)]
        at += 64 * n
        leaf = sha("".join([*sides[:place], leaf, *sides[place:]]))
    return leaf


def manifest(docs: DataFrame, leaf: Column, group: Column, order: Column, **payload: Column) -> DataFrame:
    """One row per row of docs: grp, the payload, leaf, subroot (of its group), root, path and proof (of its leaf, through the subroot to the root)."""
    if taken := set(payload) & {"grp", "ord", "pos", "digest", "level", "path", "proof", "top", "leaf", "subroot", "root"}:
        raise ValueError(f"names in use: {', '.join(sorted(taken))}")
    scratch = Scratch(docs.sparkSession, "merkle")
    rows = docs.select(group.alias("grp"), order.alias("ord"), leaf.alias("digest"), *(c.alias(n) for n, c in payload.items()))
    groups = build(rows, scratch, "groups")
    whole = build(groups.roots.select(F.lit(0).alias("grp"), F.col("grp").alias("ord"), "digest", F.col("grp").alias("member")), scratch, "top")
    last = whole.roots.select("digest").first()
    root = F.lit(last[0] if last else None).cast("string")
    top = docs.sparkSession.createDataFrame([(0, "", "", "")], "grp int, path string, proof string, top string")
    upper = proofs(whole, top).select(F.col("member").alias("grp"), "path", "proof", F.col("leaf").alias("top"))
    out = proofs(groups, scratch.save(upper))
    return out.select("grp", *payload, "leaf", F.col("top").alias("subroot"), root.alias("root"), "path", "proof")


def checked(rows: DataFrame, given: str) -> DataFrame:
    """rows(path, proof, `given`, ...) with folded_root: what the digest in column `given` gives with the siblings."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = [fold(*x) for x in zip(*(b.column(c).to_pylist() for c in (given, "path", "proof")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(folded, pa.string())], [*names, "folded_root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(tn.released(run), f"{schema}, folded_root string")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaf = lambda text: digest(encoded(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], text))
    touched = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False)) & (F.instr(docs["text"], "\n") > 0)
    changed = F.when(touched, leaf(F.replace(docs["text"], F.lit("\n"), F.lit(""))))
    rows = manifest(docs, leaf(docs["text"]), docs["source"], docs["doc_id"], doc_id=docs["doc_id"], changed=changed)
    rows = checked(rows.withColumn("given", F.coalesce("changed", "leaf")), "given")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_ENC = lambda *columns: " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in columns)
#: The polynomial and the first value of crc32 are fixed.
_CRC = """xor(list_reduce(list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT)), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""
SQL = f"""
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, sha256({_ENC("doc_id", "source", "lang", "n_chars", "text")}) AS leaf FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, CASE WHEN coalesce({_CRC} % 2, 1) = 0 THEN replace(text, chr(10), '') ELSE text END AS t2 FROM d),
lv(tree, level, pos, digest) AS (SELECT tree, CAST(0 AS BIGINT), pos, leaf FROM l
  UNION ALL SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM lv GROUP BY tree, level, pos // 3 HAVING NOT (pos // 3 = 0 AND count(*) = 1)),
sub AS (SELECT tree, max_by(digest, level) AS subroot FROM lv GROUP BY tree),
tv(level, pos, digest) AS (SELECT CAST(0 AS BIGINT), row_number() OVER (ORDER BY tree) - 1, subroot FROM sub
  UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tv GROUP BY level, pos // 3 HAVING NOT (pos // 3 = 0 AND count(*) = 1)),
lg AS (SELECT tree, level, pos // 3 AS parent, list(digest ORDER BY pos) AS ds FROM lv GROUP BY ALL), tg AS (SELECT level, pos // 3 AS parent, list(digest ORDER BY pos) AS ds FROM tv GROUP BY ALL),
step AS (SELECT l.tree, l.pos, level AS k, ds, (l.pos // CAST(3 ** level AS BIGINT)) % 3 + 1 AS place FROM l JOIN lg ON lg.tree = l.tree AND parent = l.pos // CAST(3 ** (level + 1) AS BIGINT) WHERE level < (SELECT max(level) FROM lv x WHERE x.tree = l.tree)
  UNION ALL SELECT l.tree, l.pos, 1000 + level, ds, ((l.tree - 1) // CAST(3 ** level AS BIGINT)) % 3 + 1 FROM l JOIN tg ON parent = (l.tree - 1) // CAST(3 ** (level + 1) AS BIGINT) WHERE level < (SELECT max(level) FROM tv)),
pf AS (SELECT tree, pos, string_agg(array_to_string(ds[:place - 1] || ds[place + 1:], ''), '' ORDER BY k) AS proof, list({{'ds': ds, 'place': place}} ORDER BY k) AS steps FROM step GROUP BY tree, pos),
o AS (SELECT doc_id, leaf, subroot, (SELECT max_by(digest, level) FROM tv) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  list_reduce(coalesce(steps, []), lambda acc, x: sha256(array_to_string(x.ds[:x.place - 1] || [acc] || x.ds[x.place + 1:], '')), sha256({_ENC("doc_id", "source", "lang", "n_chars", "t2")})) AS folded_root
  FROM l JOIN sub USING (tree) LEFT JOIN pf USING (tree, pos))
SELECT *, folded_root = root AS verified FROM o
"""
