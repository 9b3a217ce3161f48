"""Merkle manifest of a table: a hash tree per group of rows, their roots hashed into one, and the proof of every row.

A leaf is H of the row's fields in the order given, each `-` if null, else its UTF-8 byte count, `:` and its value; H is SHA-256 in
lowercase hex over concatenated text, digests as their hex text. Within a group leaves ascend by id. While more than one node remains,
every 16 consecutive ones (fewer at the end, even one) become their H; a lone leaf is its own root. Group roots, ordered by group
(null first, bytewise), are reduced alike to the root of the table.

1. Coordinates without sorting the rows. Ids fall into 64-bit maps by (group, id / 64), merged by bit_or before they are shuffled; only
   maps that are not empty exist. Directories of counts stand above them, each 1024 times as wide as the one below, so every running
   count is over 1024 entries at most, whatever the ids. A row's place is the count before its map and the bits below its own.
2. Rows of a repeated id (and of no id) have no bit of their own. Their maps tell, as they count more rows than bits; only these rows
   are ranged over all tasks by (group, id, leaf), so one id may hold any share of the table.
3. Levels. A node goes to the slot place % 256 of the array keyed (group, place / 256); one array gives two levels of the tree.
4. Proofs come back down: every array hands its children their siblings and the proof from above, which is as long as the tree is high.

Null ids come first in their group; rows of one id are ordered by leaf, and equal rows take neighbouring places. Null groups are a group.
An empty table has no rows, and no root. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stressloom.llm.staging import store
from stressloom.llm.text import CRC_SQL, LOWER, UPPER, crc_sql

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of one parent, and slots of one keyed array: two levels.
RUN, SLOTS = 16, 256
#: Width of a directory over the one below, in bits; 64 ids make one map.
WIDER, MAP = 10, 6


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(values: list[Column]) -> Column:
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", altered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(row, id, grp, leaf, changed): changed is the leaf of the altered fields where the condition holds, else null."""
    changed = F.lit(None).cast("string")
    if altered:
        changed = F.when(where, leaf_of([altered.get(f, F.col(f)) for f in fields]))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(group_col).cast("string").alias("grp"),
        leaf_of([F.col(f) for f in fields]).alias("leaf"), changed.alias("changed"),
    )


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `number`, the place of each row (from 0) in the given order, which must tell all rows apart."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = store(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy(part.alias("part")).count().collect())  # one row per partition
    before, total = [], 0
    for p, size in sizes:
        before.append((p, total))
        total += size
    begin = df.sparkSession.createDataFrame(before, "part bigint, begin bigint")
    return ranged.join(F.broadcast(begin), part == F.col("part")).select(*df.columns, (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("number"))


def same(a: DataFrame, b: DataFrame, **pairs: str) -> Column:
    """Equality of columns of a and b, nulls alike."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[v]) for k, v in pairs.items()])


def prefix(level: int) -> Column:
    return F.shiftright("id", MAP + WIDER * level)


def directory(rows: DataFrame) -> DataFrame:
    """(grp, map, bits, size, base, n): the map of ids of every group and id / 64, its number of rows, the number of the group's rows
    before it and in all."""
    one = F.expr(f"bit_or(shiftleft(1L, cast(id & {(1 << MAP) - 1} as int)))")
    level = store(rows.groupBy("grp", prefix(0).alias("p0")).agg(F.coalesce(one, F.lit(0).cast("bigint")).alias("bits"), F.count(F.lit(1)).alias("size")), "maps")
    ends = level.agg(F.min("p0"), F.max("p0")).first()
    low, high = ends[0] or 0, ends[1] or 0
    levels = [level]
    while (high >> WIDER * (len(levels) - 1)) - (low >> WIDER * (len(levels) - 1)) >= 1 << WIDER:
        k = len(levels)
        up = levels[-1].groupBy("grp", F.shiftright(f"p{k - 1}", WIDER).alias(f"p{k}")).agg(F.sum("size").alias("size"))
        levels.append(store(up, "directory"))
    top = len(levels) - 1
    base = F.coalesce(F.sum("size").over(Window.partitionBy("grp").orderBy(f"p{top}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = levels[top].withColumn("base", base).withColumn("n", F.sum("size").over(Window.partitionBy("grp")))
    for k in range(top - 1, -1, -1):
        inner = Window.partitionBy("grp", "up").orderBy(f"p{k}").rowsBetween(Window.unboundedPreceding, -1)
        here = levels[k].withColumn("up", F.shiftright(f"p{k}", WIDER)).withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        wide = above.select(F.col("grp").alias("g"), F.col(f"p{k + 1}").alias("p"), F.col("base").alias("b"), "n")
        above = here.join(wide, same(here, wide, grp="g", up="p")).withColumn("base", F.col("b") + F.col("inner")).drop("g", "p", "b", "up", "inner")
    return above.select("grp", F.col("p0").alias("map"), "bits", "size", "base", "n")


def coordinates(rows: DataFrame) -> DataFrame:
    """Adds pos, the place of each row in its group, and n, the rows of the group. rows is a stored table."""
    maps = directory(rows).select(F.col("grp").alias("g"), "map", "bits", "size", "base", "n")
    keyed = rows.withColumn("p", prefix(0))
    met = keyed.join(maps, same(keyed, maps, grp="g", p="map"))
    below = F.expr(f"bit_count(bits & ~shiftleft(-1L, cast(id & {(1 << MAP) - 1} as int)))")
    alone = F.expr("bit_count(bits)") == F.col("size")
    plain = met.where(alone).withColumn("pos", F.col("base") + below)
    crowd = numbered(met.where(~alone).select(*rows.columns, "p", "base", "n"), ["grp", "id", "leaf", "row"], "repeated")
    first = crowd.groupBy(F.col("grp").alias("g"), F.col("p").alias("q")).agg(F.min("number").alias("first"))
    late = crowd.join(first, same(crowd, first, grp="g", p="q")).withColumn("pos", F.col("base") + F.col("number") - F.col("first"))
    return plain.select(*rows.columns, "pos", "n").unionByName(late.select(*rows.columns, "pos", "n"))


def joined(a: Column, start: Column | int, size: Column) -> Column:
    """Digests of a stretch (from 1) as one text."""
    return F.array_join(F.slice(a, start, size), "")


def arrays(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """(grp, block, n, slots, hashes, runs, up) of nodes (grp, pos, hash, n and columns to carry): the slots in order, the level above them,
    and the digest that the array hands on."""
    block = nodes.groupBy("grp", F.shiftright("pos", 8).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash", *carry))).alias("slots"))
    hashes = F.col("hashes")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / RUN).cast("int")), lambda r: digest(joined(hashes, r * RUN + 1, F.lit(RUN))))
    up = F.when(F.col("n") == 1, F.element_at("hashes", 1)).when(F.col("n") <= RUN, F.element_at("runs", 1)).otherwise(digest(F.array_join("runs", "")))
    return block.withColumn("hashes", F.col("slots.hash")).withColumn("runs", F.when(F.col("n") > 1, runs)).withColumn("up", up)


def siblings(i: Column) -> Column:
    """Array of (before, after) for slot i (from 0) of an array, level by level."""
    hashes, runs = F.col("hashes"), F.col("runs")
    run = F.floor(i / RUN).cast("int")
    end = F.least(F.size(hashes), run * RUN + RUN)
    low = F.struct(joined(hashes, run * RUN + 1, i - run * RUN).alias("before"), joined(hashes, i + 2, end - i - 1).alias("after"))
    high = F.struct(joined(runs, 1, run).alias("before"), joined(runs, run + 2, F.size(runs) - run - 1).alias("after"))
    return F.when(F.col("n") == 1, F.slice(F.array(low), 1, 0)).when(F.col("n") <= RUN, F.array(low)).otherwise(F.array(low, high))


def opened(blocks: DataFrame, above: DataFrame | None, keep: list[str], carry: list[str]) -> DataFrame:
    """Children (grp, pos, carry) of arrays with their proof: own siblings, then those of (grp, pos) in `above`, which also gives keep."""
    child = F.explode(F.transform("slots", lambda s, i: F.struct(s.alias("s"), siblings(i).alias("own"))))
    if above is None:
        return blocks.select("grp", child.alias("c")).select("grp", "c.s.pos", *[f"c.s.{x}" for x in carry], F.col("c.own").alias("path"))
    over = above.select(F.col("grp").alias("g"), F.col("pos").alias("q"), F.col("path").alias("rest"), *keep)
    met = blocks.join(over, same(blocks, over, grp="g", block="q"))
    return met.select("grp", "rest", *keep, child.alias("c")).select("grp", "c.s.pos", *[f"c.s.{x}" for x in carry], F.concat("c.own", "rest").alias("path"), *keep)


def climb(nodes: DataFrame, carry: list[str], most: int) -> tuple[list[DataFrame], DataFrame]:
    """All arrays from the leaves up, and (grp, root)."""
    steps = []
    while True:
        steps.append(store(arrays(nodes, carry if not steps else []), "slots", "snappy"))
        most = -(-most // SLOTS)
        nodes = steps[-1].select("grp", F.col("block").alias("pos"), F.col("up").alias("hash"), F.ceil(F.col("n") / SLOTS).cast("bigint").alias("n"))
        if most <= 1:
            return steps, nodes.select("grp", F.col("hash").alias("root"))


def manifest(rows: DataFrame) -> DataFrame:
    """(id, grp, leaf, changed, pos, path, subroot, root) of every row of leaves(); path is an array of (before, after) from the leaf to the
    root, each side the digests of siblings as one text."""
    rows = store(rows, "leaves")
    placed = store(coordinates(rows), "coordinates").withColumnRenamed("leaf", "hash")
    most = placed.agg(F.max("n")).first()[0] or 0
    steps, roots = climb(placed, ["id", "changed"], most)
    groups = numbered(roots, ["grp"], "roots").withColumn("n", F.lit(roots.count()).cast("bigint"))
    tops, whole = climb(groups.select(F.lit(0).alias("grp"), F.col("number").alias("pos"), F.col("root").alias("hash"), "n", F.col("grp").alias("name")), ["name"], groups.select("n").first()["n"] if most else 0)
    above = None
    for k in range(len(tops) - 1, -1, -1):
        above = opened(tops[k], above, [], ["hash", "name"] if k == 0 else [])
    root = whole.select(F.col("grp").alias("g"), F.col("root").alias("all"))  # one row
    above = above.join(F.broadcast(root), above["grp"] == root["g"])
    above = above.select(F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("hash").alias("subroot"), F.col("all").alias("root"))
    keep = ["subroot", "root"]
    for k in range(len(steps) - 1, 0, -1):
        above = store(opened(steps[k], above, keep, []), "paths", "snappy")
    found = opened(steps[0], above, keep, ["hash", "id", "changed"])
    return found.withColumnRenamed("hash", "leaf")


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(path, start, lambda node, p: digest(F.concat(p["before"], node, p["after"])))


def proof_text(path: str = "path") -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering lower-cases the texts of ids whose crc32 is divisible by 5; rows without an id are not tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest(leaves(docs, altered={"text": F.translate("text", UPPER, LOWER)}, where=tampered))
    fold = folded(F.coalesce("changed", "leaf"))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(proof_text()).alias("proof_sha256"), fold.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def sql(levels: int = 6, top: int = 4) -> str:
    """The same in DuckDB, with so many levels per group and above the groups."""
    field = lambda x: f"coalesce(strlen(({x})::VARCHAR)::VARCHAR || ':' || ({x})::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    checksum = crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")
    parts = [CRC_SQL, f"""leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {checksum} % 5 = 0
        THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents CROSS JOIN crc_table)""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m FROM leaves)",
        "n0 AS (SELECT source AS g, pos, leaf AS h, m FROM placed)"]
    # nodes n, siblings s, and the fold f from the leaves on; then the same above the group roots
    def tree(n: str, k: int) -> None:
        w = "PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN"
        parts.append(f"s{n}{k} AS (SELECT g, pos, m, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z FROM {n}{k})")
        parts.append(f"{n}{k + 1} AS (SELECT g, pos // 16 AS pos, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, (any_value(m) + 15) // 16 AS m FROM {n}{k} GROUP BY g, pos // 16)")

    def fold(f: str, n: str, k: int) -> None:
        parts.append(f"{f}{k + 1} AS (SELECT f.* EXCLUDE (node, proof), CASE WHEN s.m = 1 THEN node ELSE sha256(a || node || z) END AS node, proof || a || z AS proof FROM {f}{k} f JOIN s{n}{k} s ON f.g IS NOT DISTINCT FROM s.g AND f.pos // {16**k} = s.pos)")

    for k in range(levels):
        tree("n", k)
    parts.append("f0 AS (SELECT doc_id, source, leaf, source AS g, pos, coalesce(changed, leaf) AS node, '' AS proof FROM placed)")
    for k in range(levels):
        fold("f", "n", k)
    parts.append(f"t0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS m, g AS source FROM n{levels})")
    for k in range(top):
        tree("t", k)
    parts.append(f"u0 AS (SELECT doc_id, leaf, t.h AS subroot, 0 AS g, t.pos, node, proof FROM f{levels} f JOIN t0 t ON f.source IS NOT DISTINCT FROM t.source)")
    for k in range(top):
        fold("u", "t", k)
    return f"""WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.h AS verified
        FROM u{top} CROSS JOIN t{top} r"""
