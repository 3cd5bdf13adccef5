"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A repair keeps, reroles or deletes each row and inserts empty turns, so that roles read ``s?(ua)+`` or nothing is left. The cheapest repair is a shortest path through four states (start, after the
system row, after a user, after an assistant). Rows are sorted once by range and numbered; a conversation's rows inside a block of numbers are a chunk, so one that holds a third of all rows is many.

Costs to the end are found from right to left. A chunk that isn't its conversation's last starts from a speculative cost vector. Fix-up passes give each chunk the vector that its right neighbour
arrived at and run it again, until the new vector differs from the old one by only a constant (then everything further left is known up to that constant). When no chunk changes, the stitched
costs are right everywhere, and tracing forward takes the least edit that keeps to them. Which state a chunk is entered in comes from composing the chunks' maps of states, by doubling.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, parallelism, stored, trimmed

#: Rows of a block of row numbers, and so of a chunk, at most.
CHUNK = 1 << 18
#: A chunk's row is a letter: role by its initial (system, user, assistant, other), lower case; upper case if truncated; "x" and the like, by PLAIN, if it has to be deleted.
PLAIN, CUT_OFF, DELETED = "suao", "SUAO", "wxyz"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that the next turn leads to, and whose turn it is.
NEXT = [(AFTER_U, "u"), (AFTER_U, "u"), (AFTER_A, "a"), (AFTER_U, "u")]
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Codes of edits (delete, keep, insert a user or assistant turn, rerole to user or assistant), with the initial that each counts as and the role that it gives.
EDITS, INITIALS = "DKijrt", "DKIIRR"
ROLES = {"i": "user", "j": "assistant", "r": "user", "t": "assistant"}
#: Costs to the end from each state when no row is left: two turns to insert after a system row, one after a user's.
END = (0, 2 * INSERT, INSERT, 0)


def _row_costs(letter: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs from each state before a row, given those after it."""
    if letter in DELETED:
        return tuple(c + DELETE for c in after)
    low = letter.lower()
    extra = TRUNCATED if letter in CUT_OFF else 0
    direct = []
    for state in range(4):
        to, role = NEXT[state]
        taken = after[to] + extra + (0 if low == role else REROLE)
        if state == START and low == "s":
            taken = min(taken, after[AFTER_S] + extra)
        direct.append(min(after[state] + DELETE, taken))
    # any number of insertions before the row: they lead round START -> user -> assistant -> user
    best = direct[:]
    for _ in range(3):
        best = [min(best[s], best[NEXT[s][0]] + INSERT) for s in range(4)]
    return tuple(best)


def _level(costs: tuple[int, ...]) -> tuple[int, ...]:
    low = min(costs)
    return tuple(c - low for c in costs)


def backward(letters: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost vectors before every row and at the end, each less its smallest entry."""
    out = [_level(end)]
    for letter in reversed(letters):
        out.append(_level(_row_costs(letter, out[-1])))
    return out[::-1]


def rerun(letters: str, old_end: tuple[int, ...], new_end: tuple[int, ...], old_start: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before the first row for a new one at the end; stops where it is the old one but for a constant."""
    old, new = _level(old_end), _level(new_end)
    for letter in reversed(letters):
        if old == new:
            return old_start
        old, new = _level(_row_costs(letter, old)), _level(_row_costs(letter, new))
    return new


def trace(letters: str, costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[list[str], int, int]:
    """ASCII-least cheapest edits from a state: codes of ``EDITS`` for each row (insertions before it, then its own), then those after the last row; the state at the end, and what they cost.

    Of equal costs D comes first, then I, K and R. Vectors are known up to a constant, so an option is cheapest if it is least among those of its state.
    """
    out, cost = [], 0
    for i, letter in enumerate(letters):
        after, mine = costs[i + 1], ""
        low, extra = letter.lower(), TRUNCATED if letter in CUT_OFF else 0
        while True:
            if letter in DELETED:
                mine, cost = mine + "D", cost + DELETE
                break
            to, role = NEXT[state]
            options = [(after[state] + DELETE, DELETE, "D", state), (_row_costs(letter, after)[to] + INSERT, INSERT, "i" if role == "u" else "j", to)]
            if state == START and low == "s":
                options.append((after[AFTER_S] + extra, extra, "K", AFTER_S))
            if low == role:
                options.append((after[to] + extra, extra, "K", to))
            else:
                options.append((after[to] + extra + REROLE, extra + REROLE, "r" if role == "u" else "t", to))
            least = min(o[0] for o in options)
            _, paid, edit, state = next(o for o in options if o[0] == least)
            mine, cost = mine + edit, cost + paid
            if edit not in "ij":
                break
        out.append(mine)
    tail = ""
    while last and END[state]:
        to, role = NEXT[state]
        tail, cost, state = tail + ("i" if role == "u" else "j"), cost + INSERT, to
    return [*out, tail], state, cost


@lru_cache(4096)
def _short(letters: str) -> tuple[list[str], int, int]:
    """Edits of a whole conversation of few rows; not many patterns of letters make up most conversations."""
    return trace(letters, backward(letters, END), START, True)


@trimmed
def _first_pass(batches):
    for b in batches:
        yield b.assign(left=[list(backward(x, tuple(end))[0]) for x, end in zip(b["letters"], b["ending"])])


@trimmed
def _fix_up(batches):
    for b in batches:
        yield b.assign(left=[list(rerun(x, tuple(old), tuple(new), tuple(left))) for x, old, new, left in zip(b["letters"], b["ending"], b["new"], b["left"])], ending=b["new"]).drop(columns="new")


@trimmed
def _maps(batches):
    """For every chunk, the state that it is left in by the state it is entered in."""
    for b in batches:
        made = []
        for x, end, last in zip(b["letters"], b["ending"], b["last"]):
            costs = backward(x, tuple(end))
            made.append([trace(x, costs, s, bool(last))[1] for s in range(4)])
        yield b[["conv_id", "at"]].assign(leads=made)


@trimmed
def _trace_all(batches):
    for b in batches:
        found = [_short(x) if whole and len(x) <= 64 else trace(x, backward(x, tuple(end)), int(s), bool(last)) for x, end, s, last, whole in zip(b["letters"], b["ending"], b["entered"], b["last"], b["whole"])]
        yield b.drop(columns=["letters", "ending", "entered", "last", "whole"]).assign(edits=[f[0] for f in found], cost=[f[2] for f in found])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults of known kinds, by crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``. ! ?`` out, 3 repeats it, 4 makes its role user.

    Takes and returns conv_id, turn, role, text; a null role or text becomes one space. Rows that are alike are damaged alike.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("once")).drop("once")


def _numbered(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows in order of conversation and turn with a number (row) and a dense block number (at), stored. Equal rows are dealt apart by their place in the input; which of them is which makes no difference."""
    spread = rows.withColumns({"h": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h"), F.col("salt")]
    table = stored(spread.repartitionByRange(parallelism(rows), *order).sortWithinPartitions(*order).drop("h", "salt").withColumn("row", F.monotonically_increasing_id()))
    part, index = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    held = {r["p"]: r["n"] for r in table.groupBy(part.alias("p")).agg((F.max(index) + 1).alias("n")).collect()}  # a row for each partition
    starts = np.cumsum([0, *[-(-held.get(p, 0) // chunk) for p in range(max(held, default=0) + 1)]])
    block = F.element_at(F.array(*[F.lit(int(x)) for x in starts]), (part + 1).cast("int")) + F.floor(index / chunk)
    return table.withColumn("at", block.cast("long"))


def _same(a: str, b: str, shift: int = 0) -> Column:
    return F.expr(f"{a}.conv_id <=> {b}.conv_id and {a}.at + {shift} = {b}.at")


def _stitched(chunks: DataFrame) -> DataFrame:
    """conv_id, at, ending (costs after the chunk, but for a constant), entered, last: of the chunks of conversations that have several."""
    ahead = chunks.select("conv_id", F.col("at")).alias("b")
    last = F.col("b.at").isNull()
    known = chunks.alias("a").join(ahead, _same("a", "b", 1), "left").select("a.conv_id", "a.at", "a.letters", last.alias("last"), F.when(last, F.array(*map(F.lit, END))).otherwise(F.array(*[F.lit(0)] * 4)).alias("ending"))
    state = cut(known.mapInPandas(_first_pass, "conv_id long, at long, letters string, last boolean, ending array<int>, left array<int>"))
    schema = state.schema
    while True:
        right = state.select("conv_id", "at", F.col("left").alias("new")).alias("b")
        met = state.alias("a").join(right, _same("a", "b", 1), "left").select("a.*", F.coalesce("b.new", "a.ending").alias("new"))
        level = F.transform("ending", lambda c: c - F.array_min("ending"))
        if not met.where(level != F.col("new")).where("not last").limit(1).count():
            break
        state = cut(met.mapInPandas(_fix_up, schema))
    maps = cut(state.mapInPandas(_maps, "conv_id long, at long, leads array<int>"))
    # leads becomes the map from the conversation's start: after round r it spans 2^r chunks
    span = 1
    while True:
        before = maps.alias("b")
        longer = maps.alias("a").join(before, _same("b", "a", span), "left")
        if not longer.where("b.at is not null").limit(1).count():
            break
        maps = cut(longer.select("a.conv_id", "a.at", F.when(F.col("b.at").isNull(), F.col("a.leads")).otherwise(F.transform("b.leads", lambda s: F.element_at("a.leads", s + 1))).alias("leads")))
        span *= 2
    entered = maps.select("conv_id", (F.col("at") + 1).alias("at"), F.element_at("leads", START + 1).alias("state"))
    return state.alias("a").join(entered.alias("b"), _same("a", "b"), "left").select("a.conv_id", "a.at", "a.ending", F.coalesce("b.state", F.lit(START)).alias("entered"), "a.last")


def repair_conversations(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text): a table of conversations and one of repaired turns.

    Rows are taken by turn, nulls first; rows of one turn by role, then a hash of the text; a null role or text is one space and a null conv_id is a conversation. A row's first fault counts: blank (no ``[^\\x20\\x09-\\x0D]``), duplicate (role
    and text seen earlier in the conversation), truncated (its last such character is none of ``. ! ?``). Edits: keep, 0; rerole to user or assistant, 3; delete, 4, required for blank and duplicate rows;
    insert an empty user or assistant turn, 3; a truncated row that stays costs 3 more. The initials of the roles that result read ``(s?(ua)+)?``; of the cheapest repairs the ASCII-least one is taken.

    First table, a row for each conversation: conv_id, gaps (whole numbers missing between the least and greatest turn, null turns aside; null beyond 64 bits), blank, duplicate, truncated, illegal (neighbouring roles other than
    system-user, user-assistant, assistant-user by their initials), cost. First table also: audit (the edits' initials in order). Second, a row for each edit: conv_id, row (the number of the row it belongs to; numbers rise along a conversation), place (0 for the row itself, below it for insertions before
    it, above for those after the last row), edit (D, I, K or R), role and text (null where deleted). An empty table gives two empty ones; extra columns are ignored.

    Where roles leave the phase of a long stretch open for every row (a conversation of nothing but unknown roles), vectors pass through chunks unchanged, and there are as many fix-up passes as that stretch has chunks.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    table = _numbered(rows, chunk)
    initial = F.substring("role", 1, 1)
    sort = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    facts = stored(table.select("conv_id", "turn", "row", "at", sort.alias("sort"), blank.alias("blank"), truncated.alias("truncated"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest")))
    firsts = facts.where("not blank").groupBy("conv_id", "digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").alias("b")
    marked = facts.alias("a").join(firsts, F.expr("a.conv_id <=> b.conv_id and a.digest = b.digest and not a.blank"), "left").select("a.*", F.coalesce(F.col("a.row") != F.col("b.first"), F.lit(False)).alias("duplicate"))
    letter = F.when(F.col("blank") | F.col("duplicate"), F.translate("sort", PLAIN, DELETED)).when(F.col("truncated"), F.upper("sort")).otherwise(F.col("sort"))
    faults = [F.sum(F.expr(c).cast("long")).alias(n) for n, c in (("blank", "blank"), ("duplicate", "duplicate"), ("truncated", "not blank and not duplicate and truncated"))]
    # a chunk is bounded, so gathering its letters and turns is
    ordered = F.array_sort(F.collect_list(F.struct("row", letter.alias("letter"))))
    chunks = marked.groupBy("conv_id", "at").agg(ordered.alias("z"), *faults, F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"))
    chunks = stored(chunks.withColumns({"first_row": F.expr("z[0].row"), "letters": F.array_join("z.letter", "")}).drop("z"))
    several = chunks.groupBy("conv_id").count().where("count > 1").select("conv_id").alias("b")
    spanning = cut(chunks.select("conv_id", "at", "letters").alias("a").join(several, F.expr("a.conv_id <=> b.conv_id"), "left_semi"))
    known = _stitched(spanning).alias("b")
    defaults = {"ending": F.array(*map(F.lit, END)), "entered": F.lit(START), "last": F.lit(True)}
    given = chunks.alias("a").join(known, _same("a", "b"), "left").select("a.conv_id", "a.at", "a.first_row", "a.letters", *[F.coalesce(f"b.{c}", x).alias(c) for c, x in defaults.items()], F.col("b.at").isNull().alias("whole"))
    traced = stored(given.mapInPandas(_trace_all, "conv_id long, at long, first_row long, edits array<string>, cost long"))
    return _summary(chunks, traced), _turns(table, traced)


def _summary(chunks: DataFrame, traced: DataFrame) -> DataFrame:
    """Sums over the chunks of each conversation. Neighbours on either side of a chunk's end count once: as a pair of roles, and as one turn if they are of the same."""
    plain = F.translate("letters", CUT_OFF + DELETED, PLAIN + PLAIN)
    legal = F.regexp_count(plain, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    within = chunks.withColumn("illegal", (F.length("letters") - 1 - legal).cast("long"))
    here, there = chunks.select("conv_id", "at", "high", F.substring(plain, -1, 1).alias("role")).alias("a"), chunks.select("conv_id", "at", "low", F.substring(plain, 1, 1).alias("role")).alias("b")
    seams = here.join(there, _same("a", "b", 1)).groupBy("a.conv_id").agg(
        F.sum(F.expr("cast(concat(a.role, b.role) not in ('su', 'ua', 'au') as long)")).alias("broken"), F.sum(F.expr("cast(coalesce(a.high = b.low, false) as long)")).alias("shared")
    ).alias("b")
    sums = within.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")], F.min("low").alias("low"), F.max("high").alias("high")).alias("a")
    audits = traced.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("at", F.array_join("edits", "").alias("edits")))).alias("z")).alias("c")
    wide = F.expr("cast(low as decimal(38,0))")
    gaps = F.coalesce(F.expr("cast(high as decimal(38,0))") - wide + 1 - F.col("turns") + F.coalesce("shared", F.lit(0)), F.lit(0)).try_cast("long")
    found = sums.join(seams, F.expr("a.conv_id <=> b.conv_id"), "left").join(audits, F.expr("a.conv_id <=> c.conv_id"))
    return found.select("a.conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("broken", F.lit(0))).alias("illegal"), "cost", F.translate(F.array_join("z.edits", ""), EDITS, INITIALS).alias("audit"))


def _turns(table: DataFrame, traced: DataFrame) -> DataFrame:
    """A row for each edit; kept and reroled ones meet their texts by row number."""
    per_row = traced.select("conv_id", "first_row", F.size("edits").alias("n"), F.posexplode("edits").alias("i", "codes")).where("codes != ''")
    each = per_row.select("conv_id", F.expr("first_row + least(i, n - 2)").alias("row"), F.expr("i = n - 1").alias("after"), F.length("codes").alias("m"), F.posexplode(F.expr("transform(sequence(1, length(codes)), k -> substring(codes, k, 1))")).alias("k", "code"))
    given = F.coalesce(*[F.when(F.col("code") == c, F.lit(role)) for c, role in ROLES.items()])
    edits = each.select("conv_id", "row", F.expr("if(after, k + 1, k + 1 - m)").alias("place"), "code", F.translate("code", EDITS, INITIALS).alias("edit"), given.alias("given"))
    stay = edits.where("code in ('K', 'r', 't')").join(table.select("row", "role", "text"), "row")
    kept = stay.select("conv_id", "row", "place", "edit", F.coalesce("given", "role").alias("role"), "text")
    rest = edits.where("code in ('D', 'i', 'j')").select("conv_id", "row", "place", "edit", F.col("given").alias("role"), F.when(F.col("code") != "D", "").alias("text"))
    return kept.unionByName(rest)


@trimmed
def _hash_lines(batches):
    """SHA-256 of each conversation's lines as they stream by in order; holds one running hash."""
    conv, running, began = None, None, False
    for b in batches:
        ids, hashes = [], []
        for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if not began or c != conv:
                if began:
                    ids.append(conv)
                    hashes.append(running.hexdigest())
                conv, running, began, joint = c, hashlib.sha256(), True, ""
            running.update(f"{joint}{role}:{text}".encode("utf-8", "surrogatepass"))
            joint = "\n"
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array(ids, pa.int64()), "sha256": pa.array(hashes, pa.string())})
    if began:
        yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "sha256": pa.array([running.hexdigest()], pa.string())})


def transcript_hashes(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired ``role:text`` lines joined by newlines, of ``repair_conversations``' second table. The hash of one conversation is sequential by nature: its rows stream through one task, which holds a batch of them."""
    order = ("conv_id", "row", "place")
    lines = turns.where("edit != 'D'").select(*order, "role", "text")
    return lines.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_hash_lines, "conv_id long, sha256 string")


def repair_report(conversations: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repair of ``rows`` in one row for each conv_id of ``conversations`` (a superset), those without any rows included: zeros, no edits and the hash of an empty string for them."""
    summary, turns = repair_conversations(rows, chunk)
    asked = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("o")
    found = asked.join(summary.alias("s"), F.expr("o.conv_id <=> s.conv_id"), "left").join(transcript_hashes(turns).alias("h"), F.expr("o.conv_id <=> h.conv_id"), "left")
    counts = [F.when(F.col("s.cost").isNull(), F.lit(0)).otherwise(F.col(f"s.{c}")).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("o.conv_id", *counts, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("h.sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
