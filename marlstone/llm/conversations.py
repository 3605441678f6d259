"""Conversation structure repair: faults of turns, and the cheapest edits that make the roles alternate.

The roles of a repaired conversation are an optional system turn, then pairs of user and assistant. A dynamic program
runs over the turns that are retained, kept or with another role. Its state is the role of the last retained turn; for
each state the least cost so far stands for all ways to get there, as a deletion adds the same to all (a prefix sum).
The pair of roles on both sides of a gap says what must be inserted there. Of equal costs the audit, the edits'
initials in order, that is least in ASCII is taken.

One conversation may be a third of all rows, so none is taken as a whole. All turns are put in one order by ranges and
numbered; blocks of ``BLOCK`` numbers are worked off independently, each to the best way from every state before it to
every state after it; these compose. What a block's ways have in common is fixed as soon as it is known. The texts
join the edits by number, and are digested in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, written

#: Turns of one conversation that are worked off together.
BLOCK = 1 << 12
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANK, DUPLICATE, CUT = 1, 2, 3
_SPACE = " \t\n\x0b\x0c\r"
_ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: States are the initial of the last retained role, "" before any.
STATES = ("", "s", "u", "a")
#: What must stand between two retained roles; a pair that isn't listed can't be.
_BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
#: What must follow the last retained role.
_CLOSING = {"": "", "s": "ua", "u": "a", "a": ""}
#: Two states differ by this at most in what the rest of a conversation costs: a system turn more to delete, two inserts.
_APART = DELETE + 2 * INSERT
_CHUNK = 4 << 20
_ROWS = 20_000


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by crc32(conv_id:turn) mod 20, nulls read as one space.

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role ``user``.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def ways(rows: list[tuple[str, int]], entry: str) -> dict[str, tuple[int, str, str]]:
    """The best way from state ``entry`` to each state within reach over ``rows`` (initial, fault).

    A way is its cost, its audit and the initials of the roles that it leaves; the audit determines these.
    """
    best = {entry: (0, "", "")}
    for initial, fault in rows:
        now = {x: (c + DELETE, audit + "D", roles) for x, (c, audit, roles) in best.items()}
        if fault not in (BLANK, DUPLICATE):
            for (x, to), between in _BETWEEN.items():
                if x in best and (initial == to or to != "s"):
                    (c, audit, roles), (own, edit) = best[x], (0, "K") if initial == to else (REROLE, "R")
                    way = (c + INSERT * len(between) + own + TRUNCATED * (fault == CUT), audit + "I" * len(between) + edit, roles + between + to)
                    now[to] = min(way, now.get(to, way))
        best = now
    return best


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first ``keys`` columns, read as they come."""
    rows = (r for b in batches for at in range(0, b.num_rows, _ROWS) for r in zip(*(c.to_pylist() for c in b.slice(at, _ROWS).columns), strict=True))
    return groupby(rows, lambda r: r[:keys])


def _emitted(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size; a string counts with its length."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 100 + sum(len(x) for x in r if isinstance(x, str))
        if size > _CHUNK:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


_SEGMENT = "block long, first long, last long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long, ways array<struct<entry:string,to:string,cost:long,audit:string,roles:string>>"


def _segment(conv, block: int, rows: list[tuple]) -> tuple:
    """What a block says about one conversation; rows end with pos, turn, initial, fault."""
    pos, turns, initials, faults = zip(*(r[-4:] for r in rows), strict=True)
    seen = [t for t in turns if t is not None]  # in order
    found = [{"entry": e, "to": to, "cost": c, "audit": audit, "roles": roles} for e in STATES for to, (c, audit, roles) in ways(list(zip(initials, faults, strict=True)), e).items()]
    return (conv, block, pos[0], pos[-1], *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), sum(not _legal(a, b) for a, b in pairwise(initials)),
            initials[0], initials[-1], seen[0] if seen else None, seen[-1] if seen else None, len(set(seen)), found)


_PLAN = "first long, piece string, roles string, last long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _composed(conv, segments: Iterator[tuple]) -> Iterator[tuple]:
    """The plan of each segment (first, piece of the audit, roles), and in a last row what closes the conversation and its totals.

    ``best`` has for each state the cost and the open segments of the best way to it. States that can't be on the
    cheapest path any more go, and segments that all ways have in common are given out.
    """
    best: dict[str, tuple[int, list[tuple]]] = {"": (0, [])}
    sums, illegal, foot, low, high, turns, last = [0, 0, 0], 0, None, None, None, 0, 0
    fixed: list[str] = []
    audit = lambda way: "".join(piece for _, piece, _ in way[1])
    for _, _, first, last, *faults, inside, head, tail, least, most, different, moves in segments:
        sums = [a + b for a, b in zip(sums, faults, strict=True)]
        illegal += inside + (foot is not None and not _legal(foot, head))
        foot = tail
        if least is not None:
            turns += different - (high == least)
            low, high = least if low is None else low, most
        now: dict[str, tuple[int, list[tuple]]] = {}
        for m in moves:
            if m["entry"] in best:
                cost, opened = best[m["entry"]]
                way, to = (cost + m["cost"], [*opened, (first, m["audit"], m["roles"])]), m["to"]
                if to not in now or way[0] < now[to][0] or (way[0] == now[to][0] and audit(way) < audit(now[to])):
                    now[to] = way
        bound = min(c for c, _ in now.values()) + _APART
        best = {x: way for x, way in now.items() if way[0] <= bound}
        opened = [o for _, o in best.values()]
        while opened[0] and all(o[0] == opened[0][0] for o in opened):
            first, piece, roles = opened[0][0]
            fixed.append(piece)
            yield (conv, first, piece, roles, *(None,) * 8)
            for o in opened:
                del o[0]
    cost, rest, state = min((way[0] + INSERT * len(_CLOSING[x]), audit(way) + "I" * len(_CLOSING[x]), x) for x, way in best.items())
    for first, piece, roles in best[state][1]:
        yield (conv, first, piece, roles, *(None,) * 8)
    gaps = 0 if low is None else high - low + 1 - turns
    yield (conv, None, None, _CLOSING[state], last, gaps, *sums, illegal, cost, "".join(fixed) + rest)


_EDIT = "pos long, place int, edit string, role string"


def _edits(conv, first: int | None, piece: str | None, roles: str, last: int | None) -> Iterator[tuple]:
    """The turns that a plan leaves: by the number of the turn that they are (place 0), precede (-1) or follow (from 1).

    A kept turn has no role here, as it keeps its own.
    """
    if piece is None:
        for place, role in enumerate(roles, 1):
            yield conv, last, place, "I", _ROLES[role]
        return
    pos, left = first, iter(roles)
    for edit in piece:
        if edit != "D":
            role = _ROLES[next(left)]
            yield conv, pos, -(edit == "I"), edit, None if edit == "K" else role
        pos += edit != "I"


def _lines(conv, block: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Lines of a block, joined by newlines, in chunks of bounded size (or one line)."""
    held: list[str] = []
    size, at = 0, 0
    for *_, pos, _, role, text in rows:
        if not held:
            at = pos
        held.append(f"{role}:{text}")
        size += len(held[-1])
        if size > _CHUNK:
            yield conv, block, at, "\n".join(held)
            held, size = [], 0
    if held:
        yield conv, block, at, "\n".join(held)


def _digest(conv, chunks: Iterator[tuple]) -> tuple:
    """SHA-256 of the chunks, joined by newlines, as they come."""
    found = hashlib.sha256()
    for i, row in enumerate(chunks):
        found.update(b"\n" * (i > 0) + row[-1].encode())
    return conv, found.hexdigest()


class Repair:
    """The repair of ``turns`` (conv_id, turn, role, text).

    ``audits``: for each conversation its faults, the cost and the audit. ``turns``: the repaired turns, in the order
    of pos and place within their conversation; ``edit`` is K, R or I.

    Turns stand in the order of turn, nulls first, then of role and text; a repeated row is a turn of its own. A null
    role or text counts as one space, a null conv_id is a conversation. Other columns are left out. Roles count by
    their first character; a turn with an empty role can't be kept. An empty table gives empty ones. ``drop`` deletes the tables that all this reads.
    """

    def __init__(self, turns: DataFrame, block: int = BLOCK):
        kinds = dict(turns.dtypes)
        self._kind = kinds["conv_id"]
        rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
        said = F.rtrim("text", F.lit(_SPACE))
        told = rows.select(
            "*", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("key"), F.substring("role", 1, 1).alias("initial"), (said == "").alias("blank"),
            (~F.right(said, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.substring("text", 1, 64).alias("start"), F.monotonically_increasing_id().alias("salt"))
        order = ["conv_id", "turn", "role", "start", "key", "salt"]  # the salt tells equal rows apart, which may be very many
        told = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
        self._ordered = written(told.drop("start", "salt"), "turns")
        narrow = self._ordered.drop("role", "text")
        firsts = narrow.where("not blank").groupBy("conv_id", "key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("fresh"))
        fault = F.when(F.col("blank"), BLANK).when(F.col("fresh").isNull(), DUPLICATE).when(F.col("cut"), CUT).otherwise(0)
        within = F.floor(F.col("pos") / F.lit(block)).cast("long") if block & (block - 1) else F.shiftright("pos", block.bit_length() - 1)
        flagged = narrow.join(firsts, "pos", "left").select("conv_id", within.alias("block"), "pos", F.col("turn").cast("long").alias("turn"), "initial", fault.alias("fault"))
        segments = self._mapped(flagged.repartition("block").sortWithinPartitions("pos"), 2, lambda key, rows: [_segment(*key, list(rows))], _SEGMENT)
        plans = self._mapped(segments.repartition("conv_id").sortWithinPartitions("conv_id", "block"), 1, lambda key, rows: _composed(*key, rows), _PLAN)
        self._plans = written(plans, "plans")
        self.audits = self._plans.where("audit is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        pieces = self._plans.select("conv_id", "first", "piece", "roles", "last")
        edits = self._mapped(pieces, 5, lambda key, _: _edits(*key), _EDIT)
        own = self._ordered.select("pos", F.col("role").alias("own"), "text")
        kept = edits.where("place = 0").join(own, "pos").select("conv_id", "pos", "place", "edit", F.coalesce("role", "own").alias("role"), "text")
        self.turns = kept.union(edits.where("place <> 0").select("conv_id", "pos", "place", "edit", "role", F.lit("").alias("text")))
        self._block = within

    def _mapped(self, rows: DataFrame, keys: int, work, kinds: str) -> DataFrame:
        """``work(key, rows)`` of each group of neighbouring rows that agree in their first ``keys`` columns."""
        kinds = f"conv_id {self._kind}, {kinds}"
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(kinds))
        return rows.mapInArrow(lambda batches: _emitted((out for key, group in _grouped(batches, keys) for out in work(key, group)), schema), kinds)

    def digests(self) -> DataFrame:
        """conv_id and SHA-256 of the repaired ``role:text`` lines, joined by newlines; only conversations with any."""
        lines = self.turns.select("conv_id", self._block.alias("block"), "pos", "place", "role", "text")
        chunks = self._mapped(lines.repartition("block").sortWithinPartitions("pos", "place"), 2, lambda key, rows: _lines(*key, rows), "block long, pos long, lines string")
        return self._mapped(chunks.repartition("conv_id").sortWithinPartitions("conv_id", "pos"), 1, lambda key, rows: [_digest(*key, rows)], "repaired_sha256 string")

    def drop(self) -> None:
        dropped(self._ordered, self._plans)


def repaired(turns: DataFrame, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Audit and digest of each conv_id in ``conversations``; one without turns has zeros, an empty audit and an empty digest's hash."""
    repair = Repair(turns, block)
    audits, digests = repair.audits.withColumnRenamed("conv_id", "_id"), repair.digests().withColumnRenamed("conv_id", "_conv")
    found = conversations.select("conv_id").distinct().join(audits, F.col("conv_id").eqNullSafe(F.col("_id")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = written(found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")), "repaired")
    repair.drop()
    return out


def oracle() -> str:
    """Damage and repair of ``conversations`` in DuckDB SQL; the states of all conversations advance by one turn a step."""
    bits = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    return f"""WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS v, 0 AS n FROM range(256) t(i) UNION ALL SELECT i, {bits}, n + 1 FROM bits WHERE n < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS tbl FROM bits WHERE n = 8),
k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1]))) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, role[1] AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM d),
r AS MATERIALIZED (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN said[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM n),
tot AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (after IS NOT NULL AND initial || after NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
pairs(x, y, ins) AS (VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'user'), ('s', 'u', ''), ('s', 'a', 'user'), ('u', 'a', ''), ('u', 'u', 'assistant'), ('a', 'u', ''), ('a', 'a', 'user')),
edits(op) AS (VALUES ('D'), ('K'), ('R')),
moves AS (SELECT op, x, y, ins FROM pairs, edits WHERE op = 'K' OR (op = 'R' AND y <> 's') UNION ALL SELECT 'D', x, x, '' FROM (VALUES (''), ('s'), ('u'), ('a')) s(x)),
dp AS (SELECT conv_id, 0::BIGINT AS i, '' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM tot
  UNION ALL SELECT r.conv_id, r.i, m.y, dp.cost + CASE m.op WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END + CASE WHEN m.ins <> '' THEN {INSERT} ELSE 0 END + CASE WHEN m.op <> 'D' AND r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
    dp.audit || CASE WHEN m.ins <> '' THEN 'I' ELSE '' END || m.op,
    dp.lines || CASE WHEN m.ins <> '' THEN [m.ins || ':'] ELSE [] END || CASE m.op WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE m.y WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text] END
  FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN moves m ON m.x = dp.state AND (m.op = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (m.op <> 'K' OR r.initial = m.y)
  QUALIFY row_number() OVER (PARTITION BY r.conv_id, m.y ORDER BY dp.cost + CASE m.op WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END + CASE WHEN m.ins <> '' THEN {INSERT} ELSE 0 END + CASE WHEN m.op <> 'D' AND r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
    dp.audit || CASE WHEN m.ins <> '' THEN 'I' ELSE '' END || m.op) = 1),
closing(x, ins) AS (VALUES ('', []::VARCHAR[]), ('s', ['user:', 'assistant:']), ('u', ['assistant:']), ('a', []::VARCHAR[])),
best AS (SELECT dp.conv_id, dp.cost + {INSERT} * len(c.ins) AS cost, dp.audit || repeat('I', len(c.ins)) AS audit, dp.lines || c.ins AS lines
  FROM dp JOIN tot ON tot.conv_id IS NOT DISTINCT FROM dp.conv_id AND tot.n = dp.i JOIN closing c ON c.x = dp.state
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + {INSERT} * len(c.ins), dp.audit || repeat('I', len(c.ins))) = 1)
SELECT c.conv_id, coalesce(tot.gaps, 0)::BIGINT AS gaps, coalesce(tot.blank, 0)::BIGINT AS blank, coalesce(tot.duplicate, 0)::BIGINT AS duplicate, coalesce(tot.truncated, 0)::BIGINT AS truncated,
  coalesce(tot.illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN tot ON tot.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id"""
