"""Repair of the turns of conversations: the cheapest edits that make the roles legal, found by a recursive query over batches of turns.

A repaired conversation is empty, or pairs of user and assistant with at most one system turn before them: role initials ``(s?(ua)+)?``. Turns are kept (K),
given the role that the grammar wants (R), deleted (D) or inserted without text (I). Of all edits with the least cost, the ASCII-least string of letters, the
audit, is taken. Four grammar states are enough: nothing yet, after system, after user, after assistant.

Turns are put in a total order (conversation, turn with nulls first, role, text) and cut into units of at most 64 turns of one conversation. Units are dealt by
hash to batches of bounded size; in each batch one recursive DuckDB query advances one turn a step for all its units, keeping
the least cost and audit for every grammar state. A unit that begins inside its conversation is walked from each state it can begin in, which gives
a matrix of states; matrices of one conversation are walked through the same query, 64 at a time, until one is left. So no task holds
a conversation, however long; only its SHA-256, which is sequential, and its repaired rows come from one task that streams its turns in order.

Null roles and texts are one space, null turns come first, a null conversation id is a conversation of its own. Turns that are equal in everything come
one after the other, and the second is a duplicate. An empty role has no initial and can't be kept. Conversations without turns have zeros, an empty audit and no rows. An
empty table gives no rows. Further columns are not kept. Duplicates are told by SHA-256 of their text. Rows that are equal in everything are spread over the ranges of the
order by their place in the input, which has to come in the same order when it is read again, as files do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.operators.ranking import positions
from quarryline.session import shared_dir, write_through

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turns of one unit, and matrices that are joined in one walk: 2 ** UNIT_BITS.
UNIT_BITS = 6
#: Turns or matrix rows that one batch is about.
BATCH_ROWS = 20_000
MATRIX = "conv string, unit long, start int, state int, cost long, audit string"

#: One step of all units: every state takes each move that begins in it, and of those that end in the same state the cheapest stays.
WALK = """
WITH RECURSIVE walk AS (
  SELECT conv, unit, state AS start, 0 AS n, state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM (SELECT DISTINCT conv, unit, state FROM starts)
  UNION ALL
  SELECT conv, unit, start, n, state, best.cost, best.audit FROM (
    SELECT w.conv, w.unit, w.start, w.n + 1 AS n, m.next AS state, MIN({'cost': w.cost + m.cost, 'audit': w.audit || m.letters}) AS best
    FROM walk w JOIN moves m ON m.conv = w.conv AND m.unit = w.unit AND m.n = w.n + 1 AND m.state = w.state
    GROUP BY ALL))
SELECT conv, unit, CAST(start AS INTEGER) AS start, CAST(state AS INTEGER) AS state, cost, audit
FROM walk SEMI JOIN (SELECT conv, unit, MAX(n) AS n FROM moves GROUP BY ALL) USING (conv, unit, n)
"""


def edits() -> list[tuple[str, bool, int, int, int, str]]:
    """(initial, whether the turn must go, state, next state, cost, letters) of all edits of one turn that can be cheapest.

    Insertions stand before a turn that stays: after a deletion they come later in the audit at the same cost. Two of them in a row lead back.
    """
    rows = []
    for initial in ("s", "u", "a", ""):
        for state in range(4):
            rows += [(initial, must, state, state, DELETE, "D") for must in (False, True)]
            for inserted in (0, 1):
                at = state if not inserted else ASSISTANT if state == USER else USER
                wanted, then = ("a", ASSISTANT) if at == USER else ("u", USER)
                if initial == wanted or initial == "s" and at == START:
                    rows.append((initial, False, state, then if initial == wanted else SYSTEM, INSERT * inserted, "I" * inserted + "K"))
                rows.append((initial, False, state, then, INSERT * inserted + REROLE, "I" * inserted + "R"))
    return rows


EDITS = edits()


def damage(rows: DataFrame) -> DataFrame:
    """Faults put in by rule: by ``crc32("conv_id:turn") % 20`` a turn is lost (0), emptied (1), robbed of its ``.!?`` (2), repeated (3) or given to the user (4)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20))
    kept = rows.withColumn("__fault", fault).filter("__fault <> 0")
    text = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(F.col("__fault") == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.when(F.col("__fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("__copy")).drop("__copy")


def conversation_key(conv: Column) -> Column:
    return F.coalesce(conv.cast("string"), F.lit(""))


def ordered(rows: DataFrame) -> DataFrame:
    """All turns with their ``position`` in the total order and what their text is like; written to the shared folder."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(conversation_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"))
    bare = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumns({
        "digest": F.unhex(F.sha2("text", 256)),
        "blank": bare == "",
        "truncated": (bare != "") & ~F.right(bare, F.lit(1)).isin(".", "!", "?"),
        "__input": F.monotonically_increasing_id(),
    })
    return positions(rows, [F.col(c) for c in ("conv", "turn", "role", "text", "__input")]).drop("__input")


def faults(turns: DataFrame) -> DataFrame:
    """Each turn in its unit, without its text: first fault, and whether the turn before it makes a gap or an illegal pair.

    The first holder of a role and text is looked up by its position too, so that a frequent text is spread by positions. The last
    turn before a unit stands in it as its neighbour.
    """
    slim = turns.select("conv", "turn", "role", "digest", "blank", "truncated", "position")
    firsts = slim.groupBy("conv", "role", "digest").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("first"))
    slim = slim.join(firsts, "position", "left").withColumn("initial", F.left("role", F.lit(1)))
    own = F.shiftright("position", UNIT_BITS)
    last = F.pmod("position", F.lit(1 << UNIT_BITS)) == (1 << UNIT_BITS) - 1
    spread = slim.withColumn("__shown", F.explode(F.when(last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn("unit", own + F.col("__shown"))
    at = Window.partitionBy("conv", "unit").orderBy("position")
    before = F.lag(F.struct("initial", "turn")).over(at)
    spread = spread.withColumn("before", before).filter("__shown = 0")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    pair = F.concat(F.col("before.initial"), F.col("initial"))
    return spread.select(
        "conv",
        "unit",
        "position",
        "turn",
        F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("").alias("initial"),
        "blank",
        duplicate.alias("duplicate"),
        (F.col("truncated") & ~duplicate).alias("truncated"),
        F.col("before").isNull().alias("head"),
        (F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & (F.col("before").isNull() | ~F.col("before.turn").eqNullSafe(F.col("turn")))).alias("new_turn"),
    )


def _database() -> duckdb.DuckDBPyConnection:
    """In memory: a batch is small, and nothing is spilled to a folder of the machine."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})


def _walked(con: duckdb.DuckDBPyConnection) -> pa.Table:
    table = con.sql(WALK).to_arrow_table()
    con.close()
    return table.cast(pa.schema([("conv", pa.string()), ("unit", pa.int64()), ("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def walk_turns(turns: pa.Table, moves: list[tuple]) -> pa.Table:
    """The matrix of every unit of a batch; ``moves`` are :func:`edits`."""
    con = _database()
    con.register("turns", turns)
    con.execute("CREATE TABLE edits (initial VARCHAR, must BOOLEAN, state INTEGER, next INTEGER, cost BIGINT, letters VARCHAR)")
    con.executemany("INSERT INTO edits VALUES (?, ?, ?, ?, ?, ?)", moves)
    con.execute(f"""
        CREATE TABLE moves AS
        SELECT conv, unit, n, state, next, cost + CASE WHEN truncated AND letters <> 'D' THEN {TRUNCATED} ELSE 0 END AS cost, letters
        FROM (SELECT *, blank OR duplicate AS must, ROW_NUMBER() OVER (PARTITION BY conv, unit ORDER BY position) AS n FROM turns) JOIN edits USING (initial, must)""")
    con.execute(f"CREATE TABLE starts AS SELECT conv, unit, UNNEST(CASE WHEN inside THEN RANGE(4) ELSE [{START}] END) AS state FROM (SELECT conv, unit, NOT BOOL_OR(head) AS inside FROM turns GROUP BY ALL)")
    return _walked(con)


def walk_matrices(matrices: pa.Table) -> pa.Table:
    """The matrix of every run of units (``parent``) of a batch."""
    con = _database()
    con.register("matrices", matrices)
    con.execute("CREATE TABLE moves AS SELECT conv, parent AS unit, DENSE_RANK() OVER (PARTITION BY conv, parent ORDER BY unit) AS n, start AS state, state AS next, cost, audit AS letters FROM matrices")
    con.execute("CREATE TABLE starts AS SELECT conv, unit, state FROM moves WHERE n = 1")
    return _walked(con)


def in_batches(df: DataFrame, rows: int, walk: Callable[[pa.Table], pa.Table], unit: str) -> DataFrame:
    """``walk`` over batches of whole units, dealt by hash."""
    batch = F.pmod(F.xxhash64("conv", unit), F.lit(max(1, rows // BATCH_ROWS)))
    return df.withColumn("__batch", batch).groupBy("__batch").applyInArrow(lambda t: walk(t.drop_columns("__batch")), MATRIX)


def cheapest(spark: SparkSession, units: DataFrame) -> DataFrame:
    """``conv``, ``cost`` and ``audit`` of the cheapest edits, from the turns of :func:`faults`."""
    level = write_through(in_batches(units.select("conv", "unit", "position", "initial", "blank", "duplicate", "truncated", "head"), units.count(), partial(walk_turns, moves=EDITS), "unit"), shared_dir(spark))
    finished = []
    while True:
        counts = level.groupBy("conv").agg(F.count_distinct("unit").alias("units"))
        sized = write_through(level.join(counts, "conv"), shared_dir(spark))
        finished.append(sized.filter("units = 1").drop("units"))
        open_ = sized.filter("units > 1")
        rows = open_.count()
        if not rows:
            break
        parent = F.when(F.col("units") <= 1 << UNIT_BITS, 0).otherwise(F.shiftright("unit", UNIT_BITS))
        level = write_through(in_batches(open_.withColumn("parent", parent.cast("long")).drop("units"), rows, walk_matrices, "parent"), shared_dir(spark))
    whole = finished[0]
    for more in finished[1:]:
        whole = whole.unionByName(more)
    missing = F.when(F.col("state") == SYSTEM, 2).when(F.col("state") == USER, 1).otherwise(0)
    ended = F.struct((F.col("cost") + missing * INSERT).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), missing)).alias("audit"))
    return whole.groupBy("conv").agg(F.min(ended).alias("best")).select("conv", "best.cost", "best.audit")


def counted(units: DataFrame) -> DataFrame:
    """Faults of every conversation."""
    count = lambda c: F.count_if(F.col(c)).alias(c)
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn"), F.lit(0)).alias("gaps")
    return units.groupBy("conv").agg(turns, count("blank"), count("duplicate"), count("truncated"), count("illegal"))


class Editor:
    """Applies an audit to turns that come one by one; yields the turns that stay and those inserted."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _wanted(self) -> str:
        self.state, role = (ASSISTANT, "assistant") if self.state == USER else (USER, "user")
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._wanted(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            yield self._wanted(), text
        elif letter == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield role, text


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, tuple[str, str] | None]]:
    """(conversation, number, turn) of every repaired turn; after the last of each, (conversation, number of turns, None).

    The input is sorted by conversation; an audit comes before the turns that it is about.
    """
    conv, editor, n = None, Editor(""), 0

    def ending() -> Iterator[tuple[str, int, tuple[str, str] | None]]:
        last = n
        for turn in editor.inserted():
            yield conv, last, turn
            last += 1
        yield conv, last, None

    for batch in batches:
        for key, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text")), strict=True):
            if audit is None:
                for turn in editor.turn(role, text):
                    yield conv, n, turn
                    n += 1
            else:
                if conv is not None:
                    yield from ending()
                conv, editor, n = key, Editor(audit), 0
    if conv is not None:
        yield from ending()


def in_pieces(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of some MB; the last column counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= 5000 or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=names)


class Repair:
    """``report``: faults, cost and audit of every conversation; :meth:`turns` and :meth:`digest` apply the audits.

    ``conversations`` names those that are reported even without a turn (``conv_id``); by default those of ``rows``.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, conversations: DataFrame | None = None) -> None:
        self._turns = write_through(ordered(rows), shared_dir(spark))
        units = write_through(faults(self._turns), shared_dir(spark))
        self._audits = write_through(cheapest(spark, units), shared_dir(spark))
        conv_id = (rows if conversations is None else conversations).select(F.col("conv_id").cast("long").alias("conv_id"))
        named = conv_id.distinct().withColumn("conv", conversation_key(F.col("conv_id")))
        numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
        report = named.join(counted(units), "conv", "left").join(self._audits, "conv", "left")
        self._named = report.select("conv", "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"))
        self.report = self._named.drop("conv")

    def _edited(self) -> DataFrame:
        """Audits and turns together: each conversation in one partition, its audit first, its turns in order."""
        heads = self._audits.select("conv", "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(-1).cast("long").alias("position"))
        rows = self._turns.select("conv", F.lit(None).cast("string").alias("audit"), "role", "text", "position")
        return heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "position").drop("position")

    def turns(self) -> DataFrame:
        """The repaired turns: ``conv_id``, ``n`` from 0, ``role``, ``text``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return in_pieces(((conv, n, *turn) for conv, n, turn in repaired(batches) if turn), ["conv", "n", "role", "text"])

        rows = self._edited().mapInArrow(run, "conv string, n long, role string, text string")
        return rows.select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), "n", "role", "text")

    def digest(self) -> DataFrame:
        """The report with ``repaired_sha256`` of the repaired turns as ``role:text`` lines; the empty string's where none is left."""

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
            sha = hashlib.sha256()
            for conv, n, turn in repaired(batches):
                if turn:
                    sha.update(("\n" if n else "").encode() + f"{turn[0]}:{turn[1]}".encode())
                else:
                    yield conv, sha.hexdigest()
                    sha = hashlib.sha256()

        rows = self._edited().mapInArrow(lambda batches: in_pieces(hashed(batches), ["conv", "repaired_sha256"]), "conv string, repaired_sha256 string")
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        return self._named.join(rows, "conv", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty)).drop("conv")
