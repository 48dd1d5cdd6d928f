"""Merkle manifest of a corpus by parent-preimage paths.

A leaf is the SHA-256 of a row's fields. The leaves of a source ascend by
doc_id; each run of 16 nodes has a parent, whose preimage is the run's
lowercase hex digests one after another, 64 characters a child, and whose node
is the SHA-256 of that. What remains of a source is its subroot; subroots in the
order of their sources have parents likewise, up to the root. Only preimages
are stored, a row a parent. A run of leaves joins the path of its parent: a list
of (slot, preimage) up to the root. The siblings of a node are its parent's
preimage without the node's own 64 characters; a changed leaf is folded by
putting its digest in place of these, hashing, and putting that into the next
preimage. One field (``tampered`` here) may be changed to see it found.

Nodes are numbered without a task that sees a whole source: leaves are sorted
by ranges, and each range adds what the ones before it hold of its source.
Lists never pass 16 members; preimages never pass 1024 characters, and paths
grow with the logarithm of the rows.

Defined results: a null field is ``-``, an empty one ``0:``; null sources are a
source of their own, before all others; null doc_ids come before all others of
their source and are not tampered; rows with one doc_id in a source are
ordered by their leaves (equal ones are interchangeable); a source of one row has its
leaf as subroot; a corpus of one row has it as root, and the proof of nothing;
texts of any length are hashed whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, few, lower_ascii, table

FANOUT = 16
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def stated(value: Column) -> Column:
    """A field as a leaf has it: ``-``, or the count of its UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(stated(fields[f]) for f in FIELDS)), 256)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``nth``, a row's number from 0 within its group, and ``of``, the group's rows.

    The place of a row is the last key of the order, so that very many equal rows
    go to several ranges.
    """
    keys = [*group, *order]
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    ranges = cut(placed.repartitionByRange(*keys, "_place").sortWithinPartitions(*keys, "_place").drop("_place"))
    ranges = ranges.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parts = ranges.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy(*group)
    earlier = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("of", F.sum("_n").over(of_group)).drop("_n")
    parts = few(cut(parts.withColumnsRenamed({c: f"_{c}" for c in ("_range", *group)})))
    at = F.col("_range") == F.col("__range")
    for g in group:
        at = at & same(F.col(g), F.col(f"_{g}"))
    out = ranges.join(parts, at).withColumn("nth", F.col("_at") - F.col("_first") + F.col("_before"))
    return out.select(*df.columns, "nth", "of")


def parents(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Runs of ``nodes(*group, nth, of, digest)`` -> their parents: *group, nth, of, digest, preimage, children.

    ``of`` counts the nodes of a group on a level. ``children`` are what the nodes have besides, by slot.
    """
    rest = [c for c in nodes.columns if c not in (*group, "nth", "of")]
    run = nodes.select(*group, "of", F.floor(F.col("nth") / FANOUT).cast("long").alias("up"), F.struct((F.col("nth") % FANOUT).cast("int").alias("slot"), *rest).alias("child"))
    made = run.groupBy(*group, "of", "up").agg(F.array_sort(F.collect_list("child")).alias("children"))
    made = made.withColumn("preimage", F.array_join(F.col("children.digest"), ""))
    return made.select(*group, F.col("up").alias("nth"), F.ceil(F.col("of") / FANOUT).cast("long").alias("of"), F.sha2("preimage", 256).alias("digest"), "preimage", "children")


def levels(nodes: DataFrame, group: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The stored parents of each level while a group has several nodes, and the last node of each group: *group, digest.

    The loop runs once a level, and levels grow with the logarithm of the rows.
    """
    out, last = [], nodes.where("of = 1").select(*group, "digest")
    several = nodes.where("of > 1")
    while not several.isEmpty():
        made = cut(parents(several, group))
        out.append(made)
        last = last.unionByName(made.where("of = 1").select(*group, "digest"))
        several = made.where("of > 1").select(*group, "nth", "of", "digest")
    return out, cut(last)


def step(slot: Column, preimage: Column) -> Column:
    return F.struct(slot.cast("int").alias("slot"), preimage.alias("preimage"))


def siblings(at: Column) -> Column:
    """A preimage without the 64 characters of the node's own slot."""
    before = at["slot"] * DIGEST
    return F.concat(F.substring(at["preimage"], F.lit(1), before), F.substring(at["preimage"], before + (DIGEST + 1), F.length(at["preimage"])))


def spliced(at: Column, digest: Column) -> Column:
    """The parent's digest with ``digest`` in the node's slot."""
    before = at["slot"] * DIGEST
    return F.sha2(F.concat(F.substring(at["preimage"], F.lit(1), before), digest, F.substring(at["preimage"], before + (DIGEST + 1), F.length(at["preimage"]))), 256)


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, siblings), ""), 256)


def folded(path: Column, digest: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, digest, lambda below, at: spliced(at, below))


def joined(rows: DataFrame, known: DataFrame, group: list[str], nth: Column | None, take: list[str]) -> DataFrame:
    """``rows`` with the columns ``take`` of ``known`` (named ``_*``) for their group and, if given, the number ``nth``."""
    k = known.select(*(F.col(c).alias(f"_{c}") for c in ([*group, "nth"] if nth is not None else group)), *(F.col(c).alias(f"_{c}") for c in take))
    on = F.lit(True) if nth is None else nth == F.col("_nth")
    for g in group:
        on = on & same(F.col(g), F.col(f"_{g}"))
    return rows.join(k, on).drop("_nth", *(f"_{g}" for g in group))


def with_paths(nodes: DataFrame, tree: list[DataFrame], group: list[str], top: DataFrame | None, carried: list[str]) -> DataFrame:
    """``nodes(*group, nth, of, digest, ..)`` with ``path``, their steps to the root, and the ``carried`` columns.

    ``top`` has *group, the ``carried`` columns and ``path``, which leads on from
    a group's last node; without it the path ends there. Each level joins the
    one above on its parents' numbers, so that whole paths are never shuffled below the second level.
    """
    rest = [c for c in nodes.columns if c not in (*group, "nth", "of")]

    def ended(rows: DataFrame) -> DataFrame:
        if top is None:
            return rows.withColumn("path", F.array().cast("array<struct<slot:int,preimage:string>>"))
        out = joined(rows, top, group, None, ["path", *carried])
        return out.withColumnsRenamed({f"_{c}": c for c in ("path", *carried)})

    known = None
    for k, made in reversed(list(enumerate(tree))):
        made = made.select(*group, "nth", "of", "preimage", *(["children"] if k == 0 else []))
        here = ended(made.where("of = 1"))
        if known is not None:
            inner = joined(made.where("of > 1"), known, group, F.floor(F.col("nth") / FANOUT).cast("long"), ["preimage", "path", *carried])
            inner = inner.withColumn("path", F.concat(F.array(step(F.col("nth") % FANOUT, F.col("_preimage"))), F.col("_path"))).drop("_preimage", "_path")
            here = here.unionByName(inner.withColumnsRenamed({f"_{c}": c for c in carried}))
        known = here
    alone = ended(nodes.where("of = 1")).select(*group, *rest, "path", *carried)
    if known is None:
        return alone
    runs = known.select(*group, *carried, "preimage", "path", F.explode("children").alias("child"))
    runs = runs.withColumn("path", F.concat(F.array(step(F.col("child")["slot"], F.col("preimage"))), F.col("path")))
    return runs.select(*group, *(F.col("child")[c].alias(c) for c in rest), "path", *carried).unionByName(alone)


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, digest (its leaf), subroot, root, path, folded_root.

    ``tampered`` replaces fields of the rows where ``when`` holds before their
    leaves are folded with the siblings of the untampered corpus.
    """
    fields = {f: F.col(f) for f in FIELDS}
    fake = F.when(F.coalesce(when, F.lit(False)), leaf(fields | tampered)) if tampered else F.lit(None).cast("string")
    leaves = cut(docs.select("doc_id", "source", leaf(fields).alias("digest"), fake.alias("fake")))
    nodes = numbered(leaves, ["source"], ["doc_id", "digest"])
    tree, subroots = levels(nodes, ["source"])
    tops = numbered(subroots, [], ["source"])
    crown, last = levels(tops, [])
    root = last.first()  # one digest
    top = with_paths(tops, crown, [], None, []).select("source", F.col("digest").alias("subroot"), "path")
    out = with_paths(nodes, tree, ["source"], top, ["subroot"])
    return out.select(
        "doc_id", "source", "digest", "subroot", F.lit(root and root["digest"]).cast("string").alias("root"), "path",
        folded(F.col("path"), F.coalesce("fake", "digest")).alias("folded_root"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    when = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    m = manifest(docs, {"text": lower_ascii(F.col("text"))}, when)
    return m.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL spells out: enough for 16**6 rows of a source.
SQL_LEVELS = 6


def _stated_sql(field: str, value: str | None = None) -> str:
    v = f"CAST({value or field} AS VARCHAR)"
    return f"coalesce(strlen({v}) || ':' || {v}, '-')"


def _tree_sql(name: str, group: str, order: str) -> str:
    """CTEs ``name_0`` (numbered nodes) to ``name_N``, each with the node above: a lone node is its own parent, and has no siblings there."""
    by = f"PARTITION BY {group}" if group else ""
    keys = f"{group}, " if group else ""
    out = ""
    for k in range(1, SQL_LEVELS + 1):
        b = f"{name}_{k - 1}"
        out += f"""
{name}_up{k} AS (
  SELECT {keys}nth // 16 AS nth, CASE WHEN min(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY nth)) END AS digest,
         string_agg(digest, '' ORDER BY nth) AS preimage
  FROM (SELECT *, count(*) OVER ({by}) AS n FROM {b}) GROUP BY {keys}nth // 16
),
{name}_{k} AS (SELECT {keys}nth, digest, preimage FROM {name}_up{k}),"""
    return out


def _climb_sql(name: str, group: str, rows: str, nth: str, now: str, out: str) -> str:
    """CTEs that take each row of ``rows`` up the tree ``name``: sib (siblings so far) and now (folded so far)."""
    sql, last = "", rows
    for k in range(1, SQL_LEVELS + 1):
        on = f"t.nth = r.{nth} // {16**k} " + (f"AND t.{group} IS NOT DISTINCT FROM r.{group}" if group else "")
        slot = f"CAST((r.{nth} // {16**(k - 1)}) % 16 * 64 AS BIGINT)"
        lone = "length(t.preimage) = 64 AND t.digest = t.preimage"
        sql += f"""
{out}{k} AS (
  SELECT r.* REPLACE (
    CASE WHEN {lone} THEN r.sib ELSE r.sib || substr(t.preimage, 1, {slot}) || substr(t.preimage, {slot} + 65) END AS sib,
    CASE WHEN {lone} THEN r.{now} ELSE sha256(substr(t.preimage, 1, {slot}) || r.{now} || substr(t.preimage, {slot} + 65)) END AS {now})
  FROM {last} r JOIN {name}_{k} t ON {on}
),"""
        last = f"{out}{k}"
    return sql


OP12_SQL = f"""
WITH crc AS (
  SELECT CAST(i AS BIGINT) AS i, list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) t(i)
), crcs AS (SELECT list(c ORDER BY i) AS cs FROM crc),
leaves AS (
  SELECT doc_id, source,
         sha256({" || ".join(_stated_sql(f) for f in FIELDS)}) AS digest,
         sha256({" || ".join(_stated_sql(f, "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if f == "text" else None) for f in FIELDS)}) AS fake,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                         lambda a, b: xor(a // 256, cs[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295) % 5 = 0 AS hit
  FROM documents, crcs
),
leaf_0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS nth FROM leaves),{_tree_sql("leaf", "source", "doc_id")}
top_0 AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth FROM leaf_{SQL_LEVELS}),{_tree_sql("top", "", "source")}
start AS (SELECT doc_id, source, digest AS leaf, nth, '' AS sib, CASE WHEN hit THEN fake ELSE digest END AS now FROM leaf_0),{_climb_sql("leaf", "source", "start", "nth", "now", "in_source")}
middle AS (SELECT r.* EXCLUDE (nth), t.nth, t.digest AS subroot FROM in_source{SQL_LEVELS} r JOIN top_0 t ON t.source IS NOT DISTINCT FROM r.source),{_climb_sql("top", "", "middle", "nth", "now", "over")}
root AS (SELECT digest AS root FROM top_{SQL_LEVELS})
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, now AS folded_root, now = root AS verified
FROM over{SQL_LEVELS}, root
"""
