"""Merkle manifest of a table: a content-addressed tree over its rows, with a proof for every row."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.plans import durable, number_rows

# Binary digits of a rank that one stored record covers; a record has at most 2 ** DIGITS leaves.
DIGITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_HEX = 64
_SEGMENT = "tree string, position bigint, group_rows bigint, digest string, height int, leaves int, nodes binary"
_WALKED = "tree string, position bigint, digest string, path string, subroot string, root string"
_PROVEN = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*(_field(changed.get(name, F.col(name))) for name in FIELDS)), 256)


def _parent(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def _height(nodes: int, digits: int) -> int:
    """Levels above ``nodes`` nodes up to one node, ``digits`` at most."""
    return min(digits, max(nodes - 1, 0).bit_length())


def _grown(digits: int):
    """One record of the store: the node above up to 2 ** digits nodes in a row, and all nodes below it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        level = [d.encode() for d in table["digest"].to_pylist()]
        tree, place, total = table["tree"][0].as_py(), table["position"][0].as_py() >> digits, table["group_rows"][0].as_py()
        height, leaves, nodes = _height(total, digits), len(level), list(level)
        for _ in range(height):
            level = [_parent(level[i : i + 2]) for i in range(0, len(level), 2)]
            nodes += level
        row = [tree, place, (total + (1 << digits) - 1) >> digits, level[0].decode(), height, leaves, b"".join(nodes)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
        names = ["tree", "position", "group_rows", "digest", "height", "leaves", "nodes"]
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, row, kinds, strict=True)})

    return run


def store_trees(leaves: DataFrame, digits: int = DIGITS) -> list[DataFrame]:
    """Records of the trees over ``leaves`` (tree, position, group_rows, digest), lowest level first.

    A record is addressed by the digest of its top node and lists the children below it, ``digits`` levels of
    them: at most 2 ** (digits + 1) digests.  The tops of one level are the leaves of the next, so a tree of n
    leaves takes log(n) / digits rounds, each a shuffle of one row per record.  A tree ends at the level where
    it has one record.
    """
    levels = []
    while True:
        block = F.shiftright("position", digits).alias("_block")
        grown = durable(leaves.groupBy("tree", block).applyInArrow(_grown(digits), _SEGMENT))
        levels.append(grown)
        leaves = grown.where("group_rows > 1").select("tree", "position", "group_rows", "digest")
        if leaves.isEmpty():
            return levels


class _Record:
    """The nodes of one record, level by level, for descents by binary digits."""

    def __init__(self, nodes: bytes, leaves: int, height: int):
        self.levels, at = [], 0
        for _ in range(height + 1):
            self.levels.append([nodes[at + i * _HEX : at + (i + 1) * _HEX] for i in range(leaves)])
            at, leaves = at + leaves * _HEX, (leaves + 1) // 2

    def descend(self, place: int) -> tuple[bytes, list[str]]:
        """The leaf reached by the digits of ``place`` from the top, and the children not taken, lowest first.

        A step is ``L`` or ``R`` (the side of the child not taken) and its digest, or ``-`` for an only child.
        """
        taken, steps = 0, []
        for below in range(len(self.levels) - 2, -1, -1):
            taken = taken << 1 | (place >> below & 1)
            other, level = taken ^ 1, self.levels[below]
            steps.append("-" if other >= len(level) else ("R" if other > taken else "L") + level[other].decode())
        return self.levels[0][taken], steps[::-1]


def _fold(digest: bytes, steps: list[str]) -> bytes:
    """The node above ``digest`` at the end of the steps."""
    for step in steps:
        other = step[1:].encode()
        digest = _parent([digest] if step == "-" else [other, digest] if step[0] == "L" else [digest, other])
    return digest


def _record_of(table: pa.Table) -> tuple[_Record, list[str], str | None, str | None]:
    row = table.slice(0, 1).to_pylist()[0]
    return _Record(row["nodes"], row["leaves"], row["height"]), row["path"].split(",") if row["path"] else [], row["subroot"], row["root"]


def _walk(digits: int):
    """Requests of one record move on to its leaves, with the path from there to the root."""

    def run(requests: pa.Table, record: pa.Table) -> pa.Table:
        names = ["tree", "position", "digest", "path", "subroot", "root"]
        if not len(requests):
            return pa.table({n: pa.array([], pa.int64() if n == "position" else pa.string()) for n in names})
        found, above, subroot, root = _record_of(record)
        places = requests["position"].to_pylist()
        reached = [found.descend(place & ((1 << digits) - 1)) for place in places]
        columns = [
            requests["tree"].combine_chunks(),
            pa.array(places, pa.int64()),
            pa.array([digest.decode() for digest, _ in reached], pa.string()),
            pa.array([",".join(steps + above) for _, steps in reached], pa.string()),
            pa.array([subroot] * len(places), pa.string()),
            pa.array([root] * len(places), pa.string()),
        ]
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


def _prove(digits: int):
    """Proofs of one record's rows, folded from the leaf each row has now."""

    def run(requests: pa.Table, record: pa.Table) -> pa.Table:
        out = {name: [] for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
        if len(requests):
            found, above, subroot, root = _record_of(record)
            top, tail = found.levels[-1][0], "".join(step[1:] for step in above).encode()
            intact = _fold(top, above)
            for place, changed in zip(requests["position"].to_pylist(), requests["changed"].to_pylist(), strict=True):
                leaf, steps = found.descend(place & ((1 << digits) - 1))
                here = _fold(leaf if changed is None else changed.encode(), steps)
                # rows that come to the same top share the fold above it
                folded = (intact if here == top else _fold(here, above)).decode()
                proof = hashlib.sha256("".join(step[1:] for step in steps).encode() + tail).hexdigest()
                for name, value in zip(out, (leaf.decode(), subroot, root, proof, folded, folded == root), strict=True):
                    out[name].append(value)
        kinds = {"verified": pa.bool_()}
        return pa.table({"doc_id": requests["doc_id"].combine_chunks()} | {n: pa.array(v, kinds.get(n, pa.string())) for n, v in out.items()})

    return run


def _met(requests: DataFrame, heads: DataFrame, level: DataFrame, digits: int, run, schema: str) -> DataFrame:
    """Requests with the record that their head's digest names, one record at a time."""
    records = level.select("digest", "height", "leaves", "nodes").dropDuplicates(["digest"])
    opened = heads.join(records, "digest").groupBy("tree", "position")
    block = F.shiftright("position", digits).alias("position")
    asked = requests.withColumn("_block", block).groupBy("tree", "_block")
    return asked.cogroup(opened).applyInArrow(run, schema)


def _descended(requests: DataFrame, heads: DataFrame, levels: list[DataFrame], digits: int, run, schema: str) -> DataFrame:
    """The requests (tree, position, ...) taken from the heads of their trees down to the leaves.

    ``heads`` has a row per tree: its top digest, the path above it, subroot and root.  On every level the ranks asked
    for are cut to the digits of that level, so a record is walked once for each of its leaves at most.
    """
    reached = None
    for depth in range(len(levels) - 1, -1, -1):
        tops = levels[depth].where("group_rows = 1").select("tree", F.lit(0).cast("bigint").alias("position"))
        here = heads.join(tops, "tree").select("tree", "position", "digest", "path", "subroot", "root")
        here = here if reached is None else here.unionByName(reached)
        if depth == 0:
            return _met(requests, here, levels[0], digits, run, schema)
        higher = levels[depth - 1].where("group_rows > 1").select("tree").distinct()
        asked = requests.select("tree", F.shiftright("position", digits * depth).alias("position")).distinct().join(higher, "tree", "left_semi")
        reached = durable(_met(asked, here, levels[depth], digits, _walk(digits), _WALKED))
    raise ValueError("a tree has at least one level")


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The top digest of every tree."""
    tops = [level.where("group_rows = 1").select("tree", "digest") for level in levels]
    for more in tops[1:]:
        tops[0] = tops[0].unionByName(more)
    return tops[0]


def merkle_proofs(docs: DataFrame, now: dict[str, Column] | None = None, where: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root its present content folds to.

    The tree of a language has its rows in order of doc_id; nodes are hashed in pairs, level by level, an odd last
    one alone, up to the subroot; subroots in order of language (null first, by UTF-8 bytes) give the root alike.
    ``proof_sha256`` digests the nodes beside the path from leaf to root.  ``now`` names fields whose present
    value differs from the recorded one in rows where ``where`` holds; ``folded_root`` starts from the present row.

    *Content-addressed descent*: records map a node's digest to the children below it, ``digits`` levels at
    once (``store_trees``).  Requests start at the root, look records up by digest, follow the binary digits of
    their rank and collect the children they don't take; a record passes its path segment, reversed, to the records
    below it, so the upper part of a path is made once per record and not once per row.  No task sees more than
    one record and its 2 ** digits requests, whatever the number of rows of a language.

    Null fields hash as ``-``.  Rows of one doc_id are in order of their leaves; equal rows are leaves of their
    own with equal digests.  A null doc_id is before every id.  No rows give no rows.  Further columns are not read.
    """
    plain = _leaf()
    changed = F.when(F.coalesce(where, F.lit(False)), _leaf(**now)) if now and where is not None else F.lit(None).cast("string")
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    rows = durable(docs.select(F.col("doc_id"), tree.alias("tree"), plain.alias("digest"), changed.alias("changed")))
    placed = durable(number_rows(rows, ["doc_id", "digest"], within=["tree"]))
    levels = store_trees(placed.select("tree", "position", "group_rows", "digest"), digits)
    subroots = durable(number_rows(_tops(levels), ["tree"]))
    upper = store_trees(subroots.select(F.lit("").alias("tree"), "position", "group_rows", "digest"), digits)
    nothing = F.lit(None).cast("string")
    start = _tops(upper).select("tree", "digest", F.lit("").alias("path"), nothing.alias("subroot"), F.col("digest").alias("root"))
    asked = subroots.select(F.lit("").alias("tree"), "position")
    walked = durable(_descended(asked, start, upper, digits, _walk(digits), _WALKED))
    named = subroots.select(F.col("tree").alias("_tree"), "position")
    heads = walked.join(named, "position").select(F.col("_tree").alias("tree"), "digest", "path", F.col("digest").alias("subroot"), "root")
    requests = placed.select("tree", "position", "doc_id", "changed")
    return _descended(requests, heads, levels, digits, _prove(digits), _PROVEN)


def manifest_query(documents: DataFrame) -> DataFrame:
    """Tampering adds 1 to n_chars in rows whose crc32 of the decimal doc_id is a multiple of 7."""
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return merkle_proofs(documents, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, tampered)


# crc32 bit by bit, then one level of the trees per round of the recursion
MANIFEST_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') AS a,
         coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS b,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS d,
         list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
           lambda r, c: list_reduce(list_prepend(xor(r, c), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))) AS state
  FROM documents),
leaves AS (
  SELECT doc_id, lang, coalesce(xor(state, 4294967295::UBIGINT) % 7 = 0 AND n_chars IS NOT NULL, false) AS tampered,
         sha256(a || b || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || d) AS leaf,
         sha256(a || b || coalesce(length((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') || d) AS other
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves),
lower_ AS (
  SELECT 0 AS level, lang, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, lang, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place))
  FROM lower_ WHERE n > 1 GROUP BY level, lang, place // 2, n),
subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM lower_ WHERE n = 1),
upper_ AS (
  SELECT 0 AS level, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM upper_ WHERE n > 1 GROUP BY level, place // 2, n),
path AS (
  SELECT p.doc_id, p.leaf, p.lang, p.place AS leaf_place, p.tampered, l.level, p.place >> l.level AS here, s.digest AS other
  FROM placed p JOIN lower_ l ON l.lang IS NOT DISTINCT FROM p.lang AND l.place = p.place >> l.level AND l.n > 1
  LEFT JOIN lower_ s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = l.level AND s.place = xor(l.place, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.lang, p.place, p.tampered, 1000 + u.level, r.place >> u.level, s.digest
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN upper_ u ON u.place = r.place >> u.level AND u.n > 1
  LEFT JOIN upper_ s ON s.level = u.level AND s.place = xor(u.place, 1)),
proofs AS (
  SELECT p.doc_id, p.lang, p.place, p.leaf, CASE WHEN p.tampered THEN p.other ELSE p.leaf END AS present,
         coalesce(list(struct_pack(o := coalesce(q.other, ''), h := q.here) ORDER BY q.level) FILTER (q.level IS NOT NULL), []) AS steps
  FROM placed p LEFT JOIN path q ON q.lang IS NOT DISTINCT FROM p.lang AND q.leaf_place = p.place
  GROUP BY ALL),
folded AS (
  SELECT lang, place, present AS digest, steps FROM proofs
  UNION ALL
  SELECT lang, place, sha256(CASE WHEN steps[1].h % 2 = 1 THEN steps[1].o || digest ELSE digest || steps[1].o END), steps[2:]
  FROM folded WHERE len(steps) > 0)
SELECT p.doc_id, p.leaf, r.digest AS subroot, u.digest AS root,
       sha256(list_aggregate(list_prepend('', list_transform(p.steps, lambda s: s.o)), 'string_agg', '')) AS proof_sha256,
       f.digest AS folded_root, f.digest = u.digest AS verified
FROM proofs p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
JOIN upper_ u ON u.n = 1
JOIN folded f ON f.lang IS NOT DISTINCT FROM p.lang AND f.place = p.place AND len(f.steps) = 0
"""
