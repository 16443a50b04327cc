"""Repair of conversation structure by Knuth's lightest derivations.

A repaired conversation has role initials ``(s?(ua)+)?``.  The items of the
deduction are (place, p, q): the rows from a place to the end of a block can be
edited so that they lead from state p to state q.  They are popped from an agenda in the
order of (cost, rows, audit), in which every deduction is monotone and gives
nothing lighter than what it came from, so an item is final when it is popped.
Blocks of a conversation combine by the same order, so a long conversation
is read as its blocks' items, not as its rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import materialize
from .common import buckets, python_ready

# Costs of the edits, white space, and the moves of ``(s?(ua)+)?`` between its four states.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = r"\x20\x09-\x0D"
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, START, GOALS = range(4), 0, (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Distinct rows in a block, and blocks whose items a worker remembers.
BLOCK_ROWS, REMEMBERED = 64, 1 << 14
LARGEST = (1 << 63) - 1

#: (cost, audit) of the lightest way from p to q.
Items = dict[tuple[int, int], tuple[int, str]]


@lru_cache(REMEMBERED)
def block_items(rows: tuple[tuple[str, int], ...]) -> Items:
    """The final items of a block of (symbol, copies) rows, from its first place.

    A symbol is the row's role initial (``o`` for others), in capitals if the
    row is truncated, or ``x`` for a row that must go; copies after the first must go too.
    """
    final: Items = {}
    for q in STATES:
        done: set[tuple[int, int]] = set()
        agenda = [(0, 0, "", q)]
        wanted = len(STATES)
        while agenda and wanted:
            cost, read, audit, p = heapq.heappop(agenda)
            if (read, p) in done:
                continue
            done.add((read, p))
            if read == len(rows):
                final[p, q] = (cost, audit)
                wanted -= 1
            for role in ROLES:
                for before in STATES:
                    if MOVES.get((before, role)) == p:
                        heapq.heappush(agenda, (cost + INSERT, read, "I" + audit, before))
            if read == len(rows):
                continue
            symbol, copies = rows[-1 - read]
            heapq.heappush(agenda, (cost + DELETE * copies, read + 1, "D" * copies + audit, p))
            if symbol == "x":
                continue
            own, rest = symbol.lower(), "D" * (copies - 1) + audit
            kept = cost + DELETE * (copies - 1) + (TRUNCATED if symbol.isupper() else 0)
            for before in STATES:
                if MOVES.get((before, own)) == p:
                    heapq.heappush(agenda, (kept + KEEP, read + 1, "K" + rest, before))
                if any(MOVES.get((before, role)) == p for role in ROLES):
                    heapq.heappush(agenda, (kept + REROLE, read + 1, "R" + rest, before))
    return final


#: An audit as its blocks' parts, first to last: (part, what follows) or None.
Rope = tuple | None


def _less(a: Rope, b: Rope) -> bool:
    x = y = ""
    while not (a is b and x == y):
        if not x:
            if a is None:
                return bool(y) or b is not None
            x, a = a
        if not y:
            if b is None:
                return False
            y, b = b
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]
    return False


def prepend(items: Items, after: dict[int, tuple[int, Rope]]) -> dict[int, tuple[int, Rope]]:
    """The lightest ways to a goal from the start of a block, of those from its end."""
    out: dict[int, tuple[int, Rope]] = {}
    for (p, q), (cost, audit) in items.items():
        if q not in after:
            continue
        told = (cost + after[q][0], (audit, after[q][1]))
        if p not in out or (told[0], 0) < (out[p][0], 0) or told[0] == out[p][0] and _less(told[1], out[p][1]):
            out[p] = told
    return out


def flat(audit: Rope) -> str:
    parts = []
    while audit is not None:
        part, audit = audit
        parts.append(part)
    return "".join(parts)


# --- rows ------------------------------------------------------------------

def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, key, role, text, copies): the rows of a table; null role and text are one space.

    ``key`` orders rows that share a turn, by a digest of role and text; rows that are equal in all are copies.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.md5(F.concat(role, F.lit("\n"), text)).alias("key"),
        role.alias("role"), text.alias("text"), F.lit(1).alias("copies"))


def damage(rows: DataFrame) -> DataFrame:
    """By crc32 of ``conv_id:turn`` modulo 20: rows dropped, emptied, without end marks, twice, or said by the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    return rows.withColumn("kind", kind).where("kind != 0").select(
        "conv_id", "turn", "key", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, F.col("copies") * 2).otherwise(F.col("copies")).alias("copies"))


def find_faults(rows: DataFrame) -> DataFrame:
    """One row without text for all equal rows: conv_id, turn, key, initial, copies, blank, duplicate, truncated.

    ``copies`` counts all; ``duplicate`` tells that even the first of them repeats an
    earlier row.  Equal rows are counted before any shuffle, and first
    occurrences are found by a minimum, so neither a repeated turn nor a repeated answer
    gathers in a task.
    """
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    thin = materialize(rows.select(
        "conv_id", "turn", "key", F.substring("role", 1, 1).alias("initial"),
        F.md5(F.concat("role", F.lit("\n"), "text")).alias("said"), blank.alias("blank"),
        (~blank & ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")).alias("truncated"), F.col("copies"))
        .groupBy("conv_id", "turn", "key", "initial", "said", "blank", "truncated")
        .agg(F.sum("copies").cast("long").alias("copies")), "turns")
    firsts = thin.groupBy("conv_id", "said").agg(F.min(F.struct("turn", "key")).alias("first")).select(
        F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s"))
    later = ~F.struct("turn", "key").eqNullSafe(F.col("first"))
    told = thin.join(firsts, same).withColumn("duplicate", ~F.col("blank") & later)
    return told.select("conv_id", "turn", "key", "initial", "copies", "blank", "duplicate",
                       (F.col("truncated") & ~F.col("duplicate")).alias("truncated"))


def count_faults(faults: DataFrame) -> DataFrame:
    """conv_id, gaps, n_rows, blank, duplicate, truncated of every conversation with rows."""
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.countDistinct("turn")
    return faults.groupBy("conv_id").agg(
        F.coalesce(F.when(gaps <= LARGEST, gaps.cast("long")), F.when(gaps.isNull(), F.lit(0))).cast("long").alias("gaps"),
        F.sum("copies").alias("n_rows"), F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("duplicate"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.count_if("truncated").alias("truncated"))


def _block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, rows) of each run of at most BLOCK_ROWS sorted rows of one conversation."""
    held, own = [], None
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "key", "initial", "copies", "gone", "truncated"))):
            if held and (row[0] != own or len(held) == BLOCK_ROWS):
                yield own, held
                held = []
            own = row[0]
            held.append(row[1:])
    if held:
        yield own, held


def find_items(faults: DataFrame) -> DataFrame:
    """The items of all blocks: conv_id, turn and key of the first row, its and the last row's initial, legal pairs inside, items.

    Rows are sorted over all partitions, so one conversation may spread over many tasks.
    """
    kinds = dict(faults.dtypes)["conv_id"]
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "key")]
    schema = ("turn bigint, key string, first string, last string, legal bigint, "
              "p array<int>, q array<int>, cost array<bigint>, audit array<string>")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def told() -> pa.RecordBatch:
            names = ("conv_id", "turn", "key", "first", "last", "legal", "p", "q", "cost", "audit")
            types = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(),
                     pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()))
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=list(names))

        id_type = None

        def typed(source):
            nonlocal id_type
            for batch in source:
                id_type = batch.schema.field("conv_id").type
                yield batch

        for own, rows in _block_rows(typed(batches)):
            signature = tuple(
                ("x" if gone else (s.upper() if cut else s), n)
                for s, n, gone, cut in ((i if i in ("s", "u", "a") else "o", n, g, t) for _, _, i, n, g, t in rows))
            items = block_items(signature)
            legal = sum(x[2] + y[2] in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
            (turn, key, first, *_), last = rows[0], rows[-1][2]
            keys, values = list(items), list(items.values())
            out.append((own, turn, key, first, last, legal, [k[0] for k in keys], [k[1] for k in keys],
                        [v[0] for v in values], [v[1] for v in values]))
            if len(out) == 500:
                yield told()
                out.clear()
        if out:
            yield told()

    thin = faults.select("conv_id", "turn", "key", "initial", "copies", (F.col("blank") | F.col("duplicate")).alias("gone"), "truncated")
    return thin.repartitionByRange(buckets(faults.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(
        blocks, f"conv_id {kinds}, {schema}")


def lightest_repairs(items: DataFrame) -> DataFrame:
    """conv_id, legal (pairs of neighbours with a legal change of role), cost, audit.

    A conversation's blocks are read from its last to its first; what is held is
    one way to a goal for each state.
    """
    kinds = dict(items.dtypes)["conv_id"]

    def combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_, legal, following, ways = None, False, 0, "", {}

        def told(id_type) -> pa.RecordBatch:
            cost, audit = ways[START]
            return pa.record_batch([pa.array([own], id_type), pa.array([legal], pa.int64()), pa.array([cost], pa.int64()),
                                    pa.array([flat(audit)], pa.string())], names=["conv_id", "legal", "cost", "audit"])

        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for conv, first, last, inside, p, q, cost, audit in zip(*(
                    batch[c].to_pylist() for c in ("conv_id", "first", "last", "legal", "p", "q", "cost", "audit"))):
                if open_ and conv != own:
                    yield told(id_type)
                    open_ = False
                if not open_:
                    own, open_, legal, following, ways = conv, True, 0, "", {g: (0, None) for g in GOALS}
                legal += inside + (last + following in ("su", "ua", "au"))
                following = first
                ways = prepend(dict(zip(zip(p, q), zip(cost, audit))), ways)
        if open_:
            yield told(id_type)

    dealt = items.repartition(buckets(items.sparkSession), "conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").desc_nulls_last(), F.col("key").desc())
    return dealt.mapInArrow(combine, f"conv_id {kinds}, legal bigint, cost bigint, audit string")


def apply_repairs(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired rows of every conversation in order: conv_id, place, edit, role, text.

    A conversation without rows left gives one row with place -1 and nulls.
    ``repairs`` are (conv_id, audit).  Rows cross one exchange and are read as a
    sorted stream behind their conversation's audit; the result keeps each
    conversation together and in order, as a digest over it needs.
    """
    kinds = dict(rows.dtypes)["conv_id"]
    told = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "key", "role", "text", "copies", F.lit(None).cast("string").alias("audit"))
    heads = repairs.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("key"), F.lit("").alias("role"),
        F.lit("").alias("text"), F.lit(0).alias("copies"), "audit")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "key")]

    def edit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, audit, at, state, place = None, "", 0, START, 0

        def say(letter: str, role: str, text: str) -> None:
            nonlocal state, place
            initial = role[:1]
            if letter in "RI":
                initial = "a" if state == 2 else "u"
                role = ROLES[initial]
            state = MOVES[state, initial]
            out.append((conv, place, letter, role, text))
            place += 1

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                say("I", "", "")

        def close() -> None:
            inserts()
            if not place:
                out.append((conv, -1, None, None, None))

        def batch_of() -> pa.RecordBatch:
            types = (id_type, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                   names=["conv_id", "place", "edit", "role", "text"])

        started = False
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for own, kind, role, text, copies, said in zip(*(
                    batch[c].to_pylist() for c in ("conv_id", "kind", "role", "text", "copies", "audit"))):
                if kind == 0:
                    if started:
                        close()
                    conv, audit, at, state, place, started = own, said, 0, START, 0, True
                    continue
                for _ in range(copies):
                    inserts()
                    letter = audit[at]
                    at += 1
                    if letter != "D":
                        say(letter, role, text)
            if out:
                yield batch_of()
                out.clear()
        if started:
            close()
            yield batch_of()

    dealt = heads.unionByName(told).repartition(buckets(rows.sparkSession), "conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(edit, f"conv_id {kinds}, place bigint, edit string, role string, text string")


def digest(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the rows of ``apply_repairs``, read in their order without a shuffle."""
    kinds = dict(repaired.dtypes)["conv_id"]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for own, place, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place <= 0:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = own, hashlib.sha256()
                if place >= 0:
                    state.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            if done:
                yield pa.record_batch([pa.array([d[0] for d in done], batch.schema.field("conv_id").type),
                                       pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
                done = []
        if state is not None:
            yield pa.record_batch([pa.array([conv], batch.schema.field("conv_id").type), pa.array([state.hexdigest()])],
                                  names=["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(add, f"conv_id {kinds}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts per conversation, repaired rows) of ``turns(...)``, or what damage left of them.

    ``every`` has the conv_id of all conversations that are to be reported.
    Facts: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  Rows go by turn,
    null turns first, then by a digest of role and text.  A null conv_id is a
    conversation like others; null role and text are one space; repeated rows are duplicates;
    a conversation without rows has zeros and an empty audit; an empty table
    gives nothing.  Columns beside the four are not read.
    """
    python_ready(rows.sparkSession)
    faults = materialize(find_faults(rows), "faults")
    counted = count_faults(faults)
    ways = lightest_repairs(materialize(find_items(faults), "items"))
    ids = every.select("conv_id").distinct()
    named = lambda df, name: df.withColumnRenamed("conv_id", name)
    joined = (ids.join(named(counted, "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
              .join(named(ways, "w"), F.col("conv_id").eqNullSafe(F.col("w")), "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    facts = materialize(joined.select(
        "conv_id", F.when(F.col("c").isNull() & F.col("n_rows").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps"),
        zero("blank"), zero("duplicate"), zero("truncated"),
        F.greatest(F.coalesce(F.col("n_rows"), F.lit(0)) - 1 - F.coalesce("legal", F.lit(0)), F.lit(0)).cast("long").alias("illegal"),
        zero("cost"), F.coalesce("audit", F.lit("")).alias("audit")), "repairs")
    return facts, apply_repairs(rows, facts)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    facts, repaired = repair_conversations(damage(turns(stored)), stored)
    told = digest(repaired).withColumnRenamed("conv_id", "d")
    return facts.join(told, F.col("conv_id").eqNullSafe(F.col("d"))).drop("d")


QUERIES = {"op12_conversation_repair": op12_conversation_repair}


def _oracle() -> str:
    """The definition itself, row by row: no blocks, no agenda.

    A way is its cost in ten digits and its audit, so the least string is the lightest way.
    """
    add = lambda v, k, x: f"(lpad(({v}[:10]::BIGINT + {k})::VARCHAR, 10, '0') || {v}[11:] || '{x}')"
    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(n, ''), lambda x: ascii(x)::BIGINT)), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
           "lambda e, z: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END)), 4294967295) % 20")
    gone, cut = "(m.blank OR m.dup)", "CASE WHEN m.trunc THEN 3 ELSE 0 END"

    def to(state: int) -> str:
        ways = [f"{add(f'd.f{state}', DELETE, 'D')}"]
        for (p, role), q in MOVES.items():
            if q == state:
                ways.append(f"CASE WHEN NOT {gone} AND m.initial = '{role}' THEN {add(f'd.f{p}', cut, 'K')} END")
                if role in ROLES:
                    ways.append(f"CASE WHEN NOT {gone} THEN {add(f'd.f{p}', f'{REROLE} + {cut}', 'R')} END")
        return f"least({', '.join(ways)})"

    inserted2 = f"least(g2, {add('g0', 3, 'I')}, {add('g1', 3, 'I')}, {add('g3', 3, 'I')})"
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS n FROM conversations
), hurt AS (
  SELECT *, md5(r || chr(10) || t) AS k, {crc} AS kind FROM raw
), two AS (
  SELECT conv_id, turn, k, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(t, '.!?', '') ELSE t END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hurt WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k, copy) AS i, left(role, 1) AS initial,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM two
), marked AS MATERIALIZED (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM numbered
), m AS MATERIALIZED (
  SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS trunc,
         initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM marked
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(dup) AS duplicate, count_if(trunc) AS truncated,
         count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM m GROUP BY conv_id
), d AS (
  SELECT conv_id, 0 AS i, n, '0000000000' AS f0, NULL::VARCHAR AS f1, '0000000003I' AS f2, '0000000006II' AS f3 FROM facts
  UNION ALL
  SELECT conv_id, i, n, g0, g1, {inserted2}, least(g3, {add(inserted2, 3, 'I')}) FROM (
    SELECT d.conv_id, d.i + 1 AS i, d.n, {to(0)} AS g0, {to(1)} AS g1, {to(2)} AS g2, {to(3)} AS g3
    FROM d JOIN m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i + 1)
), best AS MATERIALIZED (
  SELECT conv_id, least(f0, f3)[:10]::BIGINT AS cost, least(f0, f3)[11:] AS audit FROM d WHERE i = n
), w AS (
  SELECT conv_id, audit, 0 AS j, 0 AS i, '' AS said, '' AS line FROM best
  UNION ALL
  SELECT conv_id, audit, j, i, CASE WHEN x = 'D' THEN said ELSE left(role, 1) END,
         CASE WHEN x = 'D' THEN NULL WHEN x = 'I' THEN role || ':' ELSE role || ':' || text END
  FROM (SELECT v.*, m.text, CASE WHEN x = 'K' THEN m.role WHEN v.said = 'u' THEN 'assistant' ELSE 'user' END AS role
        FROM (SELECT conv_id, audit, j + 1 AS j, audit[j + 1] AS x, i + (audit[j + 1] <> 'I')::INT AS i, said FROM w
              WHERE j < length(audit)) v
        LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM v.conv_id AND m.i = v.i AND v.x <> 'I')
), told AS (
  SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (j > 0), '')) AS repaired_sha256 FROM w GROUP BY conv_id
)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank,
       coalesce(f.duplicate, 0)::BIGINT AS duplicate, coalesce(f.truncated, 0)::BIGINT AS truncated,
       coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
       coalesce(t.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""


ORACLE_SQL = {"op12_conversation_repair": _oracle()}
