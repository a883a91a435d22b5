"""Repair of conversation structure by dynamic programming over sorted turns, streamed through tasks.

A conversation's turns must read: a system turn at most, then user and assistant in turn, ending with the assistant. Edits keep,
re-role, delete or insert turns; the cheapest edits win, and of equally cheap ones the least string of edit letters.

Conversations are dealt out whole and sorted by turn from the last to the first. A pass carries four numbers a conversation, the
least cost from each state to its end, across Arrow batches, and writes beside every row one byte: the edit to choose in
each state (two bits each). Spark sorts the rows with their bytes the other way round, spilling a giant conversation to its
disk as any sort does, and a second pass follows the bytes from the first turn on. No pass holds more than a batch of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sondage.functions.columns import quoted

#: Edits by their two bits, in the order of their letters.
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
COST = (4, 3, 0, 3)
TRUNCATED_COST = 3
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn of the other role: assistant after user, else user.
NEXT = (USER, USER, ASSISTANT, USER)
NEVER = 1 << 60
#: Faults; a row has its first.
SOUND, BLANK, DUPLICATE, CUT = range(4)
FINAL = (0, 2 * COST[INSERT], COST[INSERT], 0)  # least cost where no row is left: a lone system turn needs a pair, a user turn an answer
LEGAL = {"su", "ua", "au"}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def kept_state(state: int, initial: str) -> int | None:
    """State after keeping a turn of this role, None where the pattern forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


_KEPT = {c: tuple(kept_state(s, c) for s in range(4)) for c in "sua"}
_NONE = (None,) * 4


def step_back(cost: tuple[int, ...], initial: str, fault: int) -> tuple[tuple[int, ...], int]:
    """Least costs from each state before a row, given those after it, and the byte of edits to choose (least letter among the cheapest)."""
    drop = [c + COST[DELETE] for c in cost]
    use, role = [NEVER] * 4, [NEVER] * 4
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == CUT else 0
        for s, t in enumerate(_KEPT.get(initial, _NONE)):
            if t is not None:
                use[s] = cost[t] + more
        role = [cost[t] + COST[REROLE] + more for t in NEXT]
    plain = [min(x) for x in zip(drop, use, role)]
    user, assistant = min(plain[USER], COST[INSERT] + plain[ASSISTANT]), min(plain[ASSISTANT], COST[INSERT] + plain[USER])
    after = (user, user, assistant, user)
    best = tuple(min(p, COST[INSERT] + a) for p, a in zip(plain, after))
    byte = 0
    for s in range(4):
        edit = DELETE if drop[s] == best[s] else INSERT if COST[INSERT] + after[s] == best[s] else KEEP if use[s] == best[s] else REROLE
        byte |= edit << 2 * s
    return best, byte


# ------------------------------------------------------------------ passes


def faults(df: DataFrame) -> DataFrame:
    """Rows dealt out by conversation as (conv, turn, role, text, again, fault); ``again`` numbers equal rows of a conversation by turn.

    A null role or text counts as one space. ``fault`` is 1 blank, 2 duplicate (role and text seen earlier), 3 truncated, else 0.
    """
    end = r"[^\x20\x09-\x0D]"
    rows = df.select(
        quoted("conv_id").cast("string").alias("conv"), quoted("turn").cast("long").alias("turn"),
        F.coalesce(quoted("role"), F.lit(" ")).alias("role"), F.coalesce(quoted("text"), F.lit(" ")).alias("text"),
    )
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv")
    numbered = dealt.withColumn("again", F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())))
    trimmed = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = (
        F.when(~F.col("text").rlike(end), BLANK).when(F.col("again") > 1, DUPLICATE)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT).otherwise(SOUND)
    )
    return numbered.withColumn("fault", fault.cast("int"))


def _sorted(df: DataFrame, *order: Column) -> DataFrame:
    return df.sortWithinPartitions(F.col("conv").asc_nulls_first(), *order)


def choices(df: DataFrame) -> DataFrame:
    """The rows of :func:`faults` with ``choice``, the byte of edits, and ``place``, the number of rows from here to the conversation's end."""

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, cost, place = object(), FINAL, 0
        for batch in batches:
            bytes_, places = [], []
            for c, role, fault in zip(batch["conv"].tolist(), batch["role"].tolist(), batch["fault"].tolist()):
                if c != conv:
                    conv, cost, place = c, FINAL, 0
                cost, byte = step_back(cost, role[:1], fault)
                place += 1
                bytes_.append(byte)
                places.append(place)
            yield batch.assign(choice=bytes_, place=places)

    late = _sorted(
        faults(df).select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", "again", "fault"),
        F.col("no_turn").asc(), F.col("turn").desc(), F.col("role").desc(), F.col("text").desc(), F.col("again").desc(),
    )
    return late.mapInPandas(back, "conv string, turn bigint, no_turn boolean, role string, text string, again int, fault int, choice int, place bigint")


class Walk:
    """One conversation from its first row on: state, edits and counts."""

    def __init__(self, conv: str | None):
        self.conv, self.state, self.edits, self.cost = conv, START, bytearray(), 0
        self.counts, self.illegal, self.before = [0] * 4, 0, None
        self.first, self.last, self.turns = None, None, 0
        self.digest, self.any = hashlib.sha256(), False

    def row(self, turn: int | None, role: str, text: str, fault: int, choice: int) -> Iterator[tuple[str, str | None, str]]:
        """(edit letter, role, text) of the row and of what is inserted before it."""
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        while (edit := choice >> 2 * self.state & 3) == INSERT:
            yield self._insert()
        self.cost += COST[edit] + (TRUNCATED_COST if fault == CUT and edit != DELETE else 0)
        if edit == DELETE:
            self.edits += b"D"
            yield "D", role, text
            return
        if edit == KEEP:
            self.state = kept_state(self.state, role[:1])
        else:
            self.state = NEXT[self.state]
            role = NAMES[self.state]
        yield self._put(LETTERS[edit], role, text)

    def close(self) -> Iterator[tuple[str, str | None, str]]:
        """What is inserted after the last row."""
        while self.state in (SYSTEM, USER):
            yield self._insert()

    def _insert(self) -> tuple[str, str, str]:
        self.state = NEXT[self.state]
        self.cost += COST[INSERT]
        return self._put("I", NAMES[self.state], "")

    def _put(self, letter: str, role: str, text: str) -> tuple[str, str, str]:
        self.edits += letter.encode()
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True
        return letter, role, text

    def report(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv, gaps, *self.counts[1:], self.illegal, self.cost, self.edits.decode(), self.digest.hexdigest())


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Walk, list, bool]]:
    """(walk, edits of a few rows, whether the conversation is over) in order."""
    walk = None
    columns = ["conv", "turn", "no_turn", "role", "text", "fault", "choice"]
    for batch in batches:
        for conv, turn, no_turn, role, text, fault, choice in zip(*[batch[c].tolist() for c in columns]):
            if walk is None or walk.conv != conv:
                if walk is not None:
                    yield walk, list(walk.close()), True
                walk = Walk(conv)
            yield walk, list(walk.row(None if no_turn else turn, role, text, fault, choice)), False
    if walk is not None:
        yield walk, list(walk.close()), True


def _in_order(df: DataFrame) -> DataFrame:
    return _sorted(choices(df), F.col("place").desc())


def repair(df: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text), one row per edit in order, deleted rows included (edit ``D``).

    ``df`` holds conv_id, turn, role, text; turns sort with nulls first, equal ones by role and text. Null roles and texts count as
    one space; rows with a null conv_id are a conversation of their own; repeated rows are duplicates, hence deleted; columns of
    other names are not read; an empty table gives an empty one. A conversation goes through one task, a batch of its rows at a time.
    """
    names = ["conv", "place", "edit", "role", "text"]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for walk, edits, _ in _walks(batches):
            n = len(walk.edits)
            for k, (letter, role, text) in enumerate(edits):
                out.append((walk.conv, n - len(edits) + k, letter, role, text))
                size += 100 + len(text)
            if size >= 4_000_000:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    done = _in_order(df).mapInPandas(follow, "conv string, place bigint, edit string, role string, text string")
    return done.select(F.col("conv").cast(df.schema["conv_id"].dataType).alias("conv_id"), "place", "edit", "role", "text")


def report(df: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``gaps`` counts missing turn numbers between the first and the last (null turns left out, none at all: 0), ``illegal`` the
    neighbours whose role initials are not su, ua or au, ``audit`` holds the edit letters, and ``repaired_sha256`` digests the
    ``role:text`` lines of the repaired conversation. Conversations of ``every`` without a row here get zeros, an empty audit and
    the digest of an empty string. Nulls, ties, repeated rows, clashing names and empty tables as in :func:`repair`.
    """
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for walk, _, over in _walks(batches):
            if over:
                out.append(walk.report())
                size += 200 + len(walk.edits)
                if size >= 4_000_000:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    counts = ", ".join(f"{c} bigint" for c in names[1:7])
    done = _in_order(df).mapInPandas(follow, f"conv string, {counts}, audit string, repaired_sha256 string")
    if every is not None:
        all_ = every.select(quoted("conv_id").cast("string").alias("id_")).distinct()
        done = all_.join(done, F.col("id_").eqNullSafe(F.col("conv")), "left").select(
            F.col("id_").alias("conv"), *[F.coalesce(c, F.lit(0)).alias(c) for c in names[1:7]],
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    return done.select(F.col("conv").cast(df.schema["conv_id"].dataType).alias("conv_id"), *names[1:])


def damaged(df: DataFrame) -> DataFrame:
    """Rows damaged by the crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out
    of it, 3 repeats it, 4 makes it the user's. Columns conv_id, turn, role, text; null roles and texts become one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(quoted("conv_id").cast("string"), space), F.lit(":"), F.coalesce(quoted("turn").cast("string"), space)).cast("binary")) % 20
    rows = df.select(quoted("conv_id").alias("conv_id"), quoted("turn").alias("turn"), F.coalesce(quoted("role"), space).alias("role"), F.coalesce(quoted("text"), space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (
        rows.where("kind <> 0")
        .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")
    )
