"""Repair of conversation structure by weighted parsing of role sequences over spans of rows.

The roles of a whole conversation read (s?(ua)+)?. The grammar is in Chomsky normal form: a nonterminal (p, q) for each
two states of that pattern's automaton, with (p, q) -> (p, r) (r, q) for every state between, and (p, q) -> row edit. A
cell of a span has, for each nonterminal, the least (cost, audit) of all ways to edit the span's rows so that they lead from p to q;
insertions are closed over at both ends of every row. As the nonterminals name both ends, every split of a span gives the same
least cell, so a span needs one split: cells are combined bottom-up by span length, within a block of rows first and then
block by block in tasks of their own.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE, crc32_sql, positions, save, table

BLOCK = 512  #: rows, or cells, that one group combines
WHITE = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3  #: costs; keeping is free

# states: 0 start, 1 after s, 2 after u, 3 after a
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = 4, (0, 3)
_REACH = {0: (0, 1, 2, 3), 1: (1, 2, 3), 2: (2, 3), 3: (2, 3)}
PAIRS = [(p, q) for p in range(STATES) for q in _REACH[p]]
_AT = {pq: i for i, pq in enumerate(PAIRS)}
RULES = [[(_AT[p, r], _AT[r, q]) for r in _REACH[p] if q in _REACH[r]] for p, q in PAIRS]

Cell = tuple  # of (cost, audit) or None, by PAIRS


def _combine(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans. Of equal costs no audit begins another, so the least stays least when audits are joined."""
    out = []
    for rule in RULES:
        best = None
        for a, b in rule:
            x, y = left[a], right[b]
            if x is not None and y is not None:
                cost = x[0] + y[0]
                if best is None or cost <= best[0]:
                    got = (cost, x[1] + y[1])
                    if best is None or got < best:
                        best = got
        out.append(best)
    return tuple(out)


_remembered = functools.lru_cache(maxsize=1 << 14)(_combine)
SHORT = 8  #: rows of a span whose cell is remembered: short spans recur in most conversations


def combine(left: Cell, right: Cell, rows: int = SHORT) -> Cell:
    """_combine, remembered where the span has few rows."""
    return (_remembered if rows < SHORT else _combine)(left, right)


def together(cells: list[Cell], rows: int = 1) -> Cell:
    """The cell of a run of spans of so many rows each: neighbours are combined, then neighbours of those, and so on."""
    while len(cells) > 1:
        rows *= 2
        cells = [combine(*cells[i : i + 2], rows) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def _closure() -> Cell:
    """The cell of an empty span: what insertions alone reach. Past three of them states repeat."""
    best: dict = {}
    front = {(p, p): (0, "") for p in range(STATES)}
    while front:
        new = {}
        for (p, q), (cost, audit) in front.items():
            if (p, q) not in best:
                best[p, q] = (cost, audit)
                for role in "ua":
                    if (q, role) in STEP:
                        new[p, STEP[q, role]] = (cost + INSERT, audit + "I")
        front = new
    return tuple(best.get(pq) for pq in PAIRS)


EMPTY = _closure()


def _unit(options: dict) -> Cell:
    return combine(combine(EMPTY, tuple(options.get(pq) for pq in PAIRS)), EMPTY)


def row_cell(initial: str, faulty: bool, truncated: bool) -> Cell:
    """The cell of a row: faulty rows (blank or duplicate) can only be deleted."""
    options = {(p, p): (DELETE, "D") for p in range(STATES)}
    if not faulty:
        more = TRUNCATED if truncated else 0
        for (p, role), q in STEP.items():
            choices = ([(more, "K")] if role == initial else []) + ([(REROLE + more, "R")] if role in "ua" else [])
            if choices:
                options[p, q] = min([*choices, *([options[p, q]] if (p, q) in options else [])])
    return _unit(options)


def _times(cell: Cell, n: int) -> Cell:
    """n equal neighbours."""
    out, power = EMPTY, cell
    while n:
        if n & 1:
            out = combine(out, power)
        power, n = combine(power, power) if n > 1 else power, n >> 1
    return out


class _Units:
    """Cells of rows by what decides them."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, initial: str, faulty: bool, truncated: bool, copies: int) -> Cell:
        key = (initial if initial in ("s", "u", "a") else "", faulty, truncated, copies)
        if key not in self.known:
            one = row_cell(*key[:3])
            self.known[key] = one if copies == 1 else combine(one, _times(row_cell("", True, False), copies - 1))
        return self.known[key]


_CELL = "conv string, pos long, n long, costs array<long>, audits array<string>, first string, last string, blank long, duplicate long, truncated long, illegal long"
_LEGAL = ("su", "ua", "au")
_FIELDS = [x.split() for x in _CELL.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(n, _ARROW[k]) for n, k in _FIELDS])


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (conv, pos, n, cell, first, last, and the counts) as a batch of _CELL."""
    cells = [r[3] for r in rows]
    cols = list(zip(*rows)) or [()] * 10
    split = [[[None if c is None else c[i] for c in cell] for cell in cells] for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([*cols[:3], *split, *cols[4:]], _SCHEMA, strict=True)], schema=_SCHEMA)


def _block_row(block: int, rows: list[tuple], unit: _Units) -> tuple:
    """The cell of a block's rows (conv, block, pos, n, initial, copies, blank, seen, cut)."""
    cells, blank, duplicate, truncated, illegal, before = [], 0, 0, 0, 0, None
    for *_, initial, copies, is_blank, seen, cut in rows:
        faulty = is_blank or seen
        cells.append(unit(initial, faulty, cut, copies))
        blank += copies * is_blank
        duplicate += 0 if is_blank else copies - (not seen)
        truncated += not faulty and cut
        illegal += (before is not None and before + initial not in _LEGAL) + (copies - 1 if initial + initial not in _LEGAL else 0)
        before = initial
    conv, at, _, n, first = rows[0][:5]
    return conv, at, -(-n // block), together(cells), first, before, blank, duplicate, truncated, illegal


def _row_cells(rows: DataFrame, block: int) -> DataFrame:
    """A cell a block of rows (conv, pos, n, initial, copies, blank, seen, cut). Blocks stream by, one in memory at a time."""

    def run(batches):
        unit, mine = _Units(), []
        for b in batches:
            done = []
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if mine and mine[0][:2] != r[:2]:
                    done.append(_block_row(block, mine, unit))
                    mine = []
                mine.append(r)
            yield _pack(done)
        if mine:
            yield _pack([_block_row(block, mine, unit)])

    keyed = rows.select("conv", F.floor(F.col("pos") / block).alias("block"), "pos", "n", "initial", "copies", "blank", "seen", "cut")
    return keyed.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").mapInArrow(run, _CELL)


def _upper_cells(cells: DataFrame, block: int) -> DataFrame:
    """A cell a block of cells."""

    def run(t: pa.Table) -> pa.Table:
        t = sorted(t.to_pylist(), key=lambda r: r["pos"])
        whole = together([tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)) for r in t], SHORT)
        border = sum(x["last"] + y["first"] not in _LEGAL for x, y in zip(t, t[1:]))
        sums = [sum(r[k] for r in t) for k in ("blank", "duplicate", "truncated", "illegal")]
        return pa.Table.from_batches([_pack([(t[0]["conv"], t[0]["pos"] // block, -(-t[0]["n"] // block), whole, t[0]["first"], t[-1]["last"], *sums[:3], sums[3] + border)])])

    return cells.withColumn("block", F.floor(F.col("pos") / block)).groupBy("conv", "block").applyInArrow(run, _CELL)


def parse(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, cost, audit, blank, duplicate, truncated, illegal) of conversations' rows (conv, pos, n, initial, copies, blank, seen, cut)."""
    most = rows.agg(F.max("n")).first()[0] or 0
    cells = save(_row_cells(rows, block), "repair-cells")
    while most > block:
        most = -(-most // block)
        cells = save(_upper_cells(cells, block), "repair-cells")
    ends = F.array_compact(F.array(*[F.when(F.col("costs")[_AT[0, q]].isNotNull(), F.struct(F.col("costs")[_AT[0, q]].alias("cost"), F.col("audits")[_AT[0, q]].alias("audit"))) for q in FINAL]))
    return cells.withColumn("best", F.array_min(ends)).select("conv", "best.cost", "best.audit", "blank", "duplicate", "truncated", "illegal")


def faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), grouped into distinct ones, with their place and faults: the written table all else reads.

    conv (the conversation, never null), pos and n (place by turn, role and text, nulls first; distinct rows), conv_id,
    turn, role, text, copies (equal rows), initial, blank, cut (the last visible character ends no sentence), seen (role and text
    stand at an earlier turn of the conversation). A null role or text counts as one space.
    """
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    distinct = rows.select(conv.alias("conv"), "conv_id", "turn", one("role"), one("text")).groupBy("conv", "conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    seen_end = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    named = distinct.withColumns({"initial": F.left("role", F.lit(1)), "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "cut": ~seen_end.isin(".", "!", "?"), "start": F.left("text", F.lit(64))})
    placed = positions(named, "conv", ["turn", "role", "start", "text"], "repair-rows").drop("start")
    placed = placed.withColumn("said", F.sha2(F.to_json(F.struct("conv", "role", "text")), 256))
    again = placed.groupBy("said").agg(F.min("pos").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    marked = placed.join(again, "said", "left").withColumn("seen", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    return save(marked.drop("said", "first"), "repair-faults")


def edit(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Repaired rows (conv, place, edit, role, text) of faults' rows and parse's audits, each conversation's together and in order.

    A conversation streams through one task, row by row, with its audit in memory: its digest below is of one text.
    """

    def run(batches):
        conv, audit, at, state, place = None, "", 0, 0, 0
        for b in batches:
            out: list[tuple] = []

            def put(op: str, role: str | None, text: str) -> None:
                nonlocal state, place
                role = role if role is not None else "assistant" if state == 2 else "user"
                state = STEP[state, role[:1]]
                out.append((conv, place, op, role, text))
                place += 1

            def inserts() -> None:
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    put("I", None, "")
                    at += 1

            for c, pos, role, text, copies in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if pos < 0:  # the audit comes before the conversation's rows
                    conv, audit, at, state, place = c, text, 0, 0, 0
                    inserts()
                    continue
                for _ in range(copies):
                    op, at = audit[at], at + 1
                    if op != "D":
                        put(op, role if op == "K" else None, text)
                    inserts()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv", "place", "edit", "role", "text"])

    none = F.lit(None).cast("string")
    both = rows.select("conv", "pos", "role", "text", "copies").unionByName(
        audits.select("conv", F.lit(-1).cast("long").alias("pos"), none.alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies")))
    return both.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(run, "conv string, place long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of edit's rows as role:text lines, hashed as they stream by; conversations without rows are left out."""

    def run(batches):
        conv, h = None, None
        for b in batches:
            done = []
            for c, role, text in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if c != conv:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], ["conv", "sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([h.hexdigest()])], ["conv", "sha256"])

    return repaired.select("conv", "role", "text").mapInArrow(run, "conv string, sha256 string")


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired) of conversations' rows (conv_id, turn, role, text).

    summary: conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; repaired: the rows after the cheapest edits, see edit.
    Rows of a conversation stand by turn (nulls first), then role and text; repeats of a whole row are adjacent. A null
    conversation is one of its own, a null role or text one space; a role that does not begin with s, u or a fits nowhere
    and is changed or deleted. Other columns are left behind. No rows, no conversations.
    """
    known = faults(rows.select("conv_id", "turn", "role", "text"))
    parsed = save(parse(known, block), "repair-audits")
    turns = known.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return turns.join(parsed, "conv"), edit(known, parsed)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations after damage by crc32 of conv_id:turn, a null being one space anywhere but in conv_id and turn themselves."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    hurt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str, block: int = BLOCK) -> DataFrame:
    """Every conversation of conversations: its faults after the damage, and the cheapest repair."""
    conversations = table(spark, sf_dir, "conversations")
    summary, repaired = repair(damaged(conversations), block)
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias("conv")
    every = conversations.select("conv_id").distinct().select("conv_id", conv)
    got = every.join(summary.drop("conv_id"), "conv", "left").join(digests(repaired), "conv", "left")
    zero: dict[str, Column] = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return got.select("conv_id", *[c.alias(k) for k, c in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_EDITS = [(p, "D", "", p, DELETE) for p in range(STATES)] + [(p, op, role, q, c) for (p, role), q in STEP.items() for op, c in (("K", 0), ("R", REROLE)) if op == "K" or role in "ua"]
_GAPS = [(p, q, *EMPTY[i]) for i, (p, q) in enumerate(PAIRS) if EMPTY[i] is not None]
SQL = {
    "op13_repair": f"""
WITH RECURSIVE {CRC_TABLE},
told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM told, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM hurt),
marked AS (SELECT *, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS cut FROM placed),
ways(p, op, role, q, cost) AS (VALUES {_values(_EDITS)}), gap(p, q, cost, ins) AS (VALUES {_values(_GAPS)}),
dp(conv_id, pos, q, best) AS (
  SELECT conv_id, 0, q, {{'cost': cost, 'audit': ins}} FROM (SELECT DISTINCT conv_id FROM marked), gap WHERE p = 0
  UNION ALL
  SELECT d.conv_id, d.pos + 1, g.q, min({{'cost': d.best.cost + w.cost + g.cost + CASE WHEN w.op <> 'D' AND r.cut THEN {TRUNCATED} ELSE 0 END, 'audit': d.best.audit || w.op || g.ins}})
  FROM dp d JOIN marked r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.pos = d.pos + 1
  JOIN ways w ON w.p = d.q AND (w.op = 'D' OR NOT r.blank AND NOT r.seen AND (w.op = 'R' OR w.role = r.initial)) JOIN gap g ON g.p = w.q
  GROUP BY d.conv_id, d.pos, g.q),
size AS (SELECT conv_id, count(*) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT seen AND NOT blank) AS truncated,
  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM marked GROUP BY conv_id),
best AS (SELECT s.*, (SELECT min(d.best) FROM dp d WHERE d.conv_id IS NOT DISTINCT FROM s.conv_id AND d.pos = s.n AND d.q IN (0, 3)) AS b FROM size s),
steps AS (SELECT conv_id, unnest(string_split(b.audit, '')) AS op, unnest(range(1, length(b.audit) + 1)) AS i FROM best WHERE b.audit <> ''),
numbered AS (SELECT *, count(*) FILTER (op <> 'I') OVER w AS at, count(*) FILTER (op <> 'D') OVER w AS place FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
joined AS (SELECT n.conv_id, i, op, place, m.role, m.text, bool_or(place = 1 AND op = 'K' AND m.initial = 's') OVER (PARTITION BY n.conv_id) AS s
  FROM numbered n LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM n.conv_id AND m.pos = n.at AND n.op <> 'I' WHERE op <> 'D'),
whole AS (SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (place - s::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS h FROM joined GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""
}
QUERIES = {"op13_repair": op13_repair}
