"""Conversation structure repair by rank-convergence parallel Viterbi.

A sound conversation is empty, or an optional system turn and then user and assistant turns in alternation. A row may be
kept, given another role, or deleted, and empty turns may be inserted; of the cheapest edits the ones whose audit, a string of their
initials, comes first are taken.

The programme runs backward: for each row, the least cost of the rest from each of four states. Long conversations are cut into chunks
of rows. All chunks start at once, from a speculative vector of costs at their end. Only differences between the four costs matter, so where
the true vector, once the chunk to the right gives it, differs from the speculative one only by a constant, nothing changes. Elsewhere a fix-up
pass reruns the chunk next to its former run, row by row, until the two vectors differ only by a constant; from there on the former
result holds. Passes go on until no chunk starts from a wrong vector.

Some stretches never converge (turns of one role only). A wrong vector would wander through them chunk by chunk, so after ``PASSES`` passes
conversations that are still open are settled exactly: differences of costs take few values (30), each chunk is run from all of them, which
gives a table from vector at the end to vector at the beginning, and tables are linked by joins over doubling distances.

With the vectors at hand the audit is traced forward. A chunk's trace is a table from the state before it to the state after it, linked in the
same way; then every chunk is traced on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.indexing import global_index
from .common import SPACES, over_texts, stored
from .variants import CRC_TABLE, crc_sql

CHUNK = 4096  # rows
PASSES = 4

# --- the automaton ------------------------------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = range(4)  # states: the kind of the last turn
TURNED = (USER, USER, ASSISTANT, USER)  # the state after an inserted or relabelled turn
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
END = (0, 6, 3, 0)  # costs behind the last row
NAMES = ("", "system", "user", "assistant")
LEGAL = ("su", "ua", "au")  # initials of neighbours

Vector = tuple[int, ...]

# a row is one character: its role's initial, sound (lower case), truncated (upper case) or to be deleted (the digits 0 to 3)
_KINDS = "suax"
SOUND, CUT, GONE = "suax", "SUAX", "0123"


def initial(code: str) -> str:
    return _KINDS[int(code)] if code in GONE else code.lower()


def _ways(after: Vector, code: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, state after) of the ways to deal with a row itself."""
    yield DELETE + after[state], "D", state
    if code in GONE:
        return
    more = TRUNCATED if code in CUT else 0
    to = KEPT.get(code.lower(), (None,) * 4)[state]
    if to is not None:
        yield more + after[to], "K", to
    yield REROLE + more + after[TURNED[state]], "R", TURNED[state]


@cache
def costs(after: Vector, code: str) -> Vector:
    """Least costs before a row, by state, with turns inserted in front of it."""
    own = [min(_ways(after, code, s))[0] for s in range(4)]
    for _ in range(2):  # two insertions lead to any state
        own = [min(own[s], INSERT + own[TURNED[s]]) for s in range(4)]
    return tuple(own)


@cache
def before(after: Vector, code: str) -> Vector:
    """The same less their minimum: what two vectors that differ only by a constant have in common."""
    own = costs(after, code)
    return tuple(c - min(own) for c in own)


@cache
def choice(after: Vector, code: str, state: int) -> tuple[str, str, int]:
    """Initials of inserted turns, letter, and state after: the first letters of the audit that comes first."""
    own, inserted = costs(after, code), ""
    while True:
        ways = {letter: to for cost, letter, to in _ways(after, code, state) if cost == own[state]}
        if "D" in ways or own[state] != INSERT + own[TURNED[state]]:
            letter = min(ways)
            return inserted, letter, ways[letter]
        state = TURNED[state]
        inserted += NAMES[state][0]


def behind(state: int) -> str:
    """Initials of the turns inserted behind the last row."""
    found = ""
    while END[state]:
        state = TURNED[state]
        found += NAMES[state][0]
    return found


@cache
def vectors() -> tuple[Vector, ...]:
    """All vectors that can occur."""
    found = [END]
    for v in found:
        found += [w for w in dict.fromkeys(before(v, c) for c in SOUND + CUT + GONE) if w not in found]
    return tuple(found)


def backward(codes: str, end: Vector) -> Vector:
    """The vector before a chunk for the one behind it."""
    return reduce(before, reversed(codes), end)


def fixed_up(codes: str, end: Vector, former: Vector, result: Vector) -> Vector:
    """The same, if ``former`` gave ``result``: both are run until they differ only by a constant."""
    for code in reversed(codes):
        if end == former:
            return result
        end, former = before(end, code), before(former, code)
    return end


def trace(codes: str, end: Vector, state: int) -> tuple[list[tuple[str, str, int]], int]:
    """The choice for each row of a chunk, entered in a state, and the state behind it."""
    after = [end]
    for code in reversed(codes[1:]):
        after.append(before(after[-1], code))
    found = []
    for code, vector in zip(codes, reversed(after)):
        found.append(choice(vector, code, state))
        state = found[-1][2]
    return found, state


def states_behind(codes: str, end: Vector) -> list[int]:
    """The state behind a chunk for each state before it."""
    return [trace(codes, end, s)[1] for s in range(4)]


# --- chunks -------------------------------------------------------------------------------------

_KEY = ["conv_id", "chunk"]
_VECTOR = "array<int>"


def _mapped(df: DataFrame, run: Callable[..., object], columns: list[str], name: str, kind: str) -> DataFrame:
    """``df`` with a column computed from others, by Arrow batches."""

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in columns]
            found = pa.array([run(*row) for row in zip(*values)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return over_texts(df, batchwise, f"{fields}, {name} {kind}")


def _beside(df: DataFrame, other: DataFrame, distance: int, how: str = "left") -> DataFrame:
    """Each chunk with columns of the chunk of its conversation at a distance."""
    theirs = other.select(F.col("conv_id").alias("_conv"), (F.col("chunk") - distance).alias("_chunk"), *(c for c in other.columns if c not in _KEY))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))
    return df.join(theirs, same, how).drop("_conv", "_chunk")


def _linked(tables: DataFrame, direction: int, longest: int) -> DataFrame:
    """conv_id, chunk, table: the tables of all chunks from the end in this direction up to each one, in one."""
    now, distance = tables.select(*_KEY, "table"), 1
    while distance < longest:
        both = _beside(now, now.withColumnRenamed("table", "far"), direction * distance)
        joint = F.when(F.col("far").isNull(), F.col("table")).otherwise(
            F.transform("far", lambda i: F.element_at("table", i + 1))
        )
        now = stored(both.select(*_KEY, joint.alias("table")), "structure-linked")
        distance *= 2
    return now


def _speculated(chunks: DataFrame, passes: int, longest: int) -> DataFrame:
    """conv_id, chunk, codes, end: every chunk of conversations of several chunks with the vector behind it."""
    first = chunks.withColumn("end", F.array(*map(F.lit, END)))
    now = stored(_mapped(first, lambda codes, end: list(backward(codes, tuple(end))), ["codes", "end"], "out", _VECTOR), "structure-speculated")
    for nth in range(passes + 1):
        right = now.select(*_KEY, F.col("out").alias("true_end"))
        wrong = _beside(now, right, 1, "inner").filter("true_end != end")
        if not wrong.head(1):
            return now.select(*_KEY, "codes", "end")
        if nth == passes:
            break
        rerun = _mapped(
            stored(wrong, "structure-wrong"),
            lambda codes, end, former, result: list(fixed_up(codes, tuple(end), tuple(former), tuple(result))),
            ["codes", "true_end", "end", "out"], "new_out", _VECTOR,
        )
        new = rerun.select(*_KEY, F.col("true_end").alias("new_end"), "new_out")
        fixed = _beside(now, new, 0)
        now = stored(
            fixed.select(*_KEY, "codes", F.coalesce("new_end", "end").alias("end"), F.coalesce("new_out", "out").alias("out")),
            "structure-fixed",
        )
    still = stored(wrong.select(F.col("conv_id").alias("_open")).distinct(), "structure-open")
    is_open = F.col("conv_id").eqNullSafe(F.col("_open"))
    done, left = now.join(still, is_open, "left_anti"), now.join(still, is_open, "left_semi")
    known = vectors()

    def table(codes: str) -> list[int]:
        """From all vectors at once; those that have come to differ by a constant go on as one."""
        lanes: dict[Vector, list[int]] = {v: [i] for i, v in enumerate(known)}
        for code in reversed(codes):
            merged: dict[Vector, list[int]] = {}
            for v, own in lanes.items():
                merged.setdefault(before(v, code), []).extend(own)
            lanes = merged
        found = [0] * len(known)
        for v, own in lanes.items():
            for i in own:
                found[i] = known.index(v)
        return found

    tables = stored(_mapped(left.select(*_KEY, "codes"), table, ["codes"], "table", _VECTOR), "structure-tables")
    ahead = _linked(tables, 1, longest).select(*_KEY, F.element_at("table", known.index(END) + 1).alias("nth"))
    every = F.array(*(F.array(*map(F.lit, v)) for v in known))
    found = _beside(left.select(*_KEY, "codes"), ahead, 1)
    settled = found.select(*_KEY, "codes", F.element_at(every, F.coalesce("nth", F.lit(known.index(END))) + 1).alias("end"))
    return done.select(*_KEY, "codes", "end").unionByName(settled)


def _entered(chunks: DataFrame, passes: int) -> DataFrame:
    """conv_id, chunk, end, state: for chunks of conversations of several chunks."""
    longest = chunks.agg(F.max("of")).first()[0] or 0
    if not longest:
        return chunks.select(*_KEY, F.array(F.lit(0)).alias("end"), F.lit(0).alias("state"))
    ended = stored(_speculated(chunks.select(*_KEY, "codes"), passes, longest), "structure-ended")
    tables = stored(_mapped(ended, lambda codes, end: states_behind(codes, tuple(end)), ["codes", "end"], "table", _VECTOR), "structure-states")
    so_far = _linked(tables, -1, longest).select(*_KEY, F.element_at("table", START + 1).alias("state"))
    return stored(_beside(ended.select(*_KEY, "end"), so_far, -1).fillna(START, ["state"]), "structure-entered")


# --- the operator -------------------------------------------------------------------------------


def _code(faulty: Column, truncated: Column) -> Column:
    kind = F.substring("role", 1, 1)
    own = F.when(kind.isin(*"sua"), kind).otherwise(F.lit("x"))
    return F.when(faulty, F.translate(own, _KINDS, GONE)).when(truncated, F.upper(own)).otherwise(own)


def repair_structure(conversations: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """A row per row of ``conversations`` with its place and its repair.

    conv_id, place, turn, role, text; fault (blank, duplicate, truncated or null); inserted: initials of the empty turns put in front of it;
    action (K, R or D); new_role (null if deleted); after: initials of the turns put behind the last row; cost; illegal: whether the
    row and the next one of its conversation stand as no sound conversation has them.

    Rows of a conversation come by turn, null first, then role, then a digest of the text; null conv_ids are one conversation. Null roles and texts
    are one space. Repeated rows are rows of their own (and duplicates). Texts may be of any length and are not read by Python; other columns
    play no part. Results do not depend on ``chunk`` and ``passes``. An empty table gives an empty result.
    """
    own = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    salted = own.withColumn("digest", digest).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    turns = stored(global_index(salted, ["conv_id", "turn", "role", "digest", "salt"], "place").drop("salt"), "structure-turns")

    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    marks = turns.select("conv_id", "place", "role", "digest", (trimmed == "").alias("blank"), F.substring(trimmed, -1, 1).isin(*".!?").alias("closed"))
    seen = marks.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    again = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    marked = marks.join(seen.filter("_n > 1").drop("_n"), again, "left")
    blank, twice, cut = F.col("blank"), F.coalesce(F.col("place") > F.col("_first"), F.lit(False)), ~F.col("closed")
    fault = F.when(blank, "blank").when(twice, "duplicate").when(cut, "truncated")
    faults = stored(marked.select("conv_id", "place", fault.alias("fault"), _code(blank | twice, cut).alias("code")), "structure-faults")

    listed = F.sort_array(F.collect_list(F.struct("place", "code")))
    pieces = (
        faults.withColumn("chunk", F.expr(f"place div {chunk}"))
        .groupBy(*_KEY)
        .agg(F.min("place").alias("first"), listed.alias("rows"))
        .withColumn("codes", F.array_join(F.transform("rows", lambda r: r["code"]), ""))
        .drop("rows")
    )
    pieces = stored(pieces, "structure-pieces")
    spans = pieces.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("chunk").alias("_a"), F.max("chunk").alias("last"))
    placed = pieces.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("of", F.expr("last - _a + 1")).drop("_conv", "_a")
    chunks = stored(placed, "structure-chunks")
    several = chunks.filter("of > 1")
    entered = _beside(several, _entered(several, passes), 0)
    entered = _beside(entered, several.select(*_KEY, F.substring("codes", 1, 1).alias("next")), 1)
    single = chunks.filter("of = 1").select("*", F.array(*map(F.lit, END)).alias("end"), F.lit(START).alias("state"), F.lit(None).cast("string").alias("next"))
    repaired = _traced(entered.unionByName(single))
    both = faults.select("place", "fault").join(repaired, "place")
    return turns.select("conv_id", "place", "turn", "role", "text").join(both, "place").withColumn(
        "new_role", F.when(F.col("action") == "K", F.col("role")).otherwise(F.col("new_role"))
    ).select("conv_id", "place", "turn", "role", "text", "fault", "inserted", "action", "new_role", "after", "cost", "illegal")


def _traced(chunks: DataFrame) -> DataFrame:
    """place, inserted, action, new_role (of relabelled rows), after, cost, illegal of each row of the chunks."""
    kind = pa.struct([
        ("inserted", pa.string()), ("action", pa.string()), ("new_role", pa.string()), ("after", pa.string()),
        ("cost", pa.int64()), ("illegal", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, end, state, last, following in zip(*(batch.column(c).to_pylist() for c in ("codes", "end", "state", "is_last", "next"))):
                choices, state = trace(codes, tuple(end), state)
                tail = behind(state) if last else ""
                rows = []
                for i, ((inserted, letter, to), code) in enumerate(zip(choices, codes)):
                    after = tail if i == len(codes) - 1 else ""
                    cost = INSERT * len(inserted + after) + {"D": DELETE, "K": 0, "R": REROLE}[letter]
                    cost += TRUNCATED if code in CUT and letter != "D" else 0
                    beside = codes[i + 1 : i + 2] or following
                    illegal = bool(beside) and initial(code) + initial(beside) not in LEGAL
                    rows.append((inserted, letter, NAMES[to] if letter == "R" else None, after, cost, illegal))
                out.append([dict(zip((f.name for f in kind), r)) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(out, pa.list_(kind))], ["first", "rows"])

    asked = chunks.select("first", "codes", "end", "state", (F.col("chunk") == F.col("last")).alias("is_last"), "next")
    struct = "inserted string, action string, new_role string, after string, cost long, illegal boolean"
    rows = over_texts(asked, run, f"first long, rows array<struct<{struct.replace(' string', ':string').replace(' long', ':long').replace(' boolean', ':boolean')}>>")
    return rows.select("first", F.posexplode("rows").alias("nth", "r")).select((F.col("first") + F.col("nth")).alias("place"), "r.*")


def _spelled(repaired: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256: rows of a conversation pass through its task in order, one at a time, into a digest."""
    rows = repaired.select("conv_id", "place", "inserted", "action", "new_role", F.when(F.col("action") != "D", F.col("text")).alias("text"), "after")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    names = {n[0]: f"{n}:" for n in NAMES if n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, letters, digest, lines = None, [], hashlib.sha256(), 0
        kind = None

        def line(text: str) -> None:
            nonlocal lines
            digest.update(("\n" if lines else "").encode() + text.encode())
            lines += 1

        def result() -> pa.RecordBatch:
            columns = [pa.array([conv], kind), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "inserted", "action", "new_role", "text", "after")]
            for own, inserted, action, role, text, after in zip(*columns):
                if letters and own != conv:
                    yield result()
                    letters, digest, lines = [], hashlib.sha256(), 0
                conv = own
                letters.append("I" * len(inserted) + action + "I" * len(after))
                for turn in inserted:
                    line(names[turn])
                if action != "D":
                    line(f"{role}:{text}")
                for turn in after:
                    line(names[turn])
        if letters:
            yield result()

    kind = repaired.schema["conv_id"].dataType.simpleString()
    return over_texts(ordered, run, f"conv_id {kind}, audit string, repaired_sha256 string")


def summaries(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """A row per distinct conv_id of ``ids``: gaps, counts of faults and illegal neighbours, cost, audit, digest of the repaired text.

    ``repaired`` is stored (``repair_structure``). Ids without rows have zeros, an empty audit and the digest of the empty text.
    A text digest needs a conversation's rows one after another: they stream through one task, which holds one batch and the audit.
    """
    faults = [F.count_if(F.coalesce(F.col("fault") == f, F.lit(False))).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = repaired.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *faults, F.count_if("illegal").alias("illegal"), F.sum("cost").alias("cost")
    )
    found = ids.select("conv_id").distinct()
    for part in (counts, _spelled(repaired)):
        theirs = part.withColumnRenamed("conv_id", "_conv")
        found = found.join(theirs, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return found.fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}).fillna(
        0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in, by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls are one space):
    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets its role to user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    ).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


_SPACES_SQL = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def _option(cost: str, letter: str, rest: str) -> str:
    return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a}}"


def _own(state: int, kept: dict[str, int]) -> str:
    """DuckDB: the best way to deal with a row itself from a state (from 1); ``kept``: state after, by the initial of a kept role."""
    rerole = _option("3 + more", "R", f"b[{TURNED[state - 1] + 1}]")
    keeps = [f"CASE WHEN r = '{r}' THEN {_option('more', 'K', f'b[{to}]')} ELSE {rerole} END" for r, to in kept.items()]
    delete = _option("4", "D", f"b[{state}]")
    return f"CASE WHEN gone THEN {delete} ELSE list_sort([{', '.join([delete, rerole, *keeps])}])[1] END AS n{state}"


_OWN = ", ".join(
    _own(s + 1, {r: to[s] + 1 for r, to in KEPT.items() if to[s] is not None}) for s in range(4)  # type: ignore[operator]
)
_WITH_INSERTED = ", ".join(
    "list_sort([{}])[1]".format(
        ", ".join([f"n{s + 1}", _option("3", "I", f"n{TURNED[s] + 1}"), _option("6", "II", f"n{TURNED[TURNED[s]] + 1}")])
    )
    for s in range(4)
)

ORACLE = f"""
    WITH RECURSIVE crc AS ({CRC_TABLE}),
    kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, crc),
    damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
    trimmed AS (SELECT *, left(role, 1) AS r, rtrim(text, {_SPACES_SQL}) AS t,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS following
        FROM placed),
    marked AS (SELECT *, CASE WHEN t = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
        FROM trimmed),
    rows AS (SELECT *, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN 3 ELSE 0 END AS more FROM marked),
    best AS (SELECT DISTINCT conv_id, n + 1 AS i, [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS b FROM rows
        UNION ALL SELECT conv_id, i, [{_WITH_INSERTED}] FROM (
            SELECT rows.conv_id, rows.i, {_OWN} FROM best JOIN rows ON rows.conv_id IS NOT DISTINCT FROM best.conv_id AND rows.i = best.i - 1)),
    audits AS (SELECT conv_id, b[1].c AS cost, b[1].a AS audit FROM best WHERE i = 1),
    walk AS (SELECT conv_id, audit, 1 AS p, 1::BIGINT AS i, 1 AS s, NULL::VARCHAR AS line FROM audits
        UNION ALL SELECT w.conv_id, audit, p + 1, w.i + CASE WHEN audit[p] = 'I' THEN 0 ELSE 1 END,
            CASE audit[p] WHEN 'D' THEN s WHEN 'K' THEN CASE r WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE CASE s WHEN 3 THEN 4 ELSE 3 END END,
            CASE audit[p] WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text
                ELSE CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE audit[p] WHEN 'R' THEN text ELSE '' END END
        FROM walk w LEFT JOIN rows ON rows.conv_id IS NOT DISTINCT FROM w.conv_id AND rows.i = w.i WHERE p <= length(audit)),
    spelled AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY p), '')) AS repaired_sha256 FROM walk GROUP BY conv_id),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (following IS NOT NULL AND r || following NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
    SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
        coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
        coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) ids
    LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
    LEFT JOIN audits ON audits.conv_id IS NOT DISTINCT FROM ids.conv_id
    LEFT JOIN spelled ON spelled.conv_id IS NOT DISTINCT FROM ids.conv_id"""
