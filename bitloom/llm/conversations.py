"""Repair of conversation structure by the cheapest edits.

A conversation should read: a system turn or none, then user and assistant in turn; or nothing. A Viterbi
decoder keeps the cheapest edits into each of four states. Backpointers form a tree whose nodes
know how many heirs they have; as soon as all surviving states share an ancestor, the edits up to it are
settled and handed out. Ties go to the edits whose letters come first as text.

Conversations may be of any length: rows are sorted over the cluster and cut into blocks. Conversations that cross a
block are first summed up, block by block, as costs and ranks from every state to every other; the same
decoder picks the states between blocks, and then all blocks are decoded at once.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import CRC_TABLE, column, crc_sql, cut, prepare, runs, union

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3  # costs
TRUNCATED = 3  # cost of a truncated row that stays
BLOCK = 65_536  # rows that a decoder takes at a time
SPACE = " \t\n\x0b\f\r"

START, SYSTEM, USER, ASSISTANT, END = range(5)
ROLES = {USER: "user", ASSISTANT: "assistant"}
# (state, state that follows, letter of the role between): what a row that stays may be
STEPS = ((START, SYSTEM, "s"), (START, USER, "u"), (SYSTEM, USER, "u"), (ASSISTANT, USER, "u"), (USER, ASSISTANT, "a"))
INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # state after an inserted row
FINISH = ((START, END, 0, ""), (ASSISTANT, END, 0, ""), (USER, END, INSERT, "I"), (SYSTEM, END, 2 * INSERT, "II"))
# (b, a): whatever may follow state a can follow b at this extra cost at most
SLACK = {(ASSISTANT, START): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3, (USER, START): 7, (USER, SYSTEM): 3,
         (USER, ASSISTANT): 3, (SYSTEM, START): 6, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 6, (START, SYSTEM): 0,
         (START, USER): 3, (START, ASSISTANT): 0}


def moves(initial: str, truncated: bool) -> list[tuple[int, int, int, str]]:
    """(state, state, cost, letters) of all ways past a row: delete, or insert at most one row, then keep or rerole.

    An insertion before a deletion or two in a row never win: D sorts before I, and a pair only adds cost.
    """
    found = [(s, s, DELETE, "D") for s in (START, SYSTEM, USER, ASSISTANT)]
    for source, target, letter in STEPS:
        if initial == letter:
            cost, edit = KEEP, "K"
        elif letter == "s":
            continue
        else:
            cost, edit = REROLE, "R"
        cost += TRUNCATED * truncated
        found.append((source, target, cost, edit))
        found += [(s, target, cost + INSERT, "I" + edit) for s, after in INSERTED.items() if after == source]
    return found


class _Node:
    __slots__ = ("parent", "heirs", "item")

    def __init__(self, parent, item):
        self.parent, self.item, self.heirs = parent, item, set()
        if parent is not None:
            parent.heirs.add(self)


class Survivors:
    """Cheapest edits into every state. ``step`` returns the items settled by it: (tag, state, letters).

    Letters of different paths into the present row differ before either ends, so their order stays as it is
    whatever follows: complete unresolved suffixes are compared by the rank carried along with each state.
    """

    def __init__(self, state: int = START):
        self.root = _Node(None, None)
        self.best = {state: (0, 0, self.root)}
        self.spent = 0

    def step(self, tag, ways) -> list[tuple]:
        found: dict[int, tuple] = {}
        for source, target, cost, letters in ways:
            held = self.best.get(source)
            if held is not None:
                offer = (held[0] + cost, held[1], letters)
                if target not in found or offer < found[target][0]:
                    found[target] = (offer, held[2])
        costs = {s: offer[0] for s, (offer, _) in found.items()}
        # a state from which every way on is dearer than from another one is no survivor; ties stay
        kept = [s for s in found if not any(
            (b, s) in SLACK and costs[b] + SLACK[b, s] < costs[s] for b in costs)]
        kept.sort(key=lambda s: found[s][0][1:])
        least = min(costs[s] for s in kept)
        before = [held[2] for held in self.best.values()]
        self.best = {s: (costs[s] - least, rank, _Node(found[s][1], (tag, s, found[s][0][2])))
                     for rank, s in enumerate(kept)}
        self.spent += least
        for node in before:  # branches without heirs go
            while not node.heirs and node.parent is not None:
                node.parent.heirs.discard(node)
                node = node.parent
        return self._settled()

    def _settled(self) -> list[tuple]:
        out = []
        while len(self.root.heirs) == 1:
            self.root = self.root.heirs.pop()
            self.root.parent = None
            out.append(self.root.item)
        return out

    def exits(self) -> list[tuple[int, int, int]]:
        """(state, cost, rank) of the survivors."""
        return [(s, self.spent + cost, rank) for s, (cost, rank, _) in self.best.items()]

    def finish(self, state: int) -> list[tuple]:
        """The items of the path into ``state`` that are not settled yet."""
        node, path = self.best[state][2], []
        while node is not self.root:
            path.append(node.item)
            node = node.parent
        return path[::-1]


def _summaries(batches):
    """Rows (key, part, block, idx, initial, truncated), sorted: costs and ranks through each block."""
    for key, part, block, _, initial, truncated in runs(batches, 3):
        paths = [(state, Survivors(state)) for state in (START, SYSTEM, USER, ASSISTANT)]
        for letter, cut_off in zip(initial.to_pylist(), truncated.to_pylist(), strict=True):
            ways = moves(letter, cut_off)
            for _, path in paths:
                path.step(None, ways)
        rows = [(key[0].as_py(), part[0].as_py(), block[0].as_py(), entry, *found)
                for entry, path in paths for found in path.exits()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))],
            names=["key", "part", "block", "entry", "exit", "cost", "rank"])


def _borders(batches):
    """Rows (key, part, block, entry, exit, cost, rank), sorted: the states between blocks of a conversation.

    Keys follow each other; a group is the few rows of one block, so only unresolved blocks are held.
    """
    key, path = None, Survivors()

    def table(items):
        rows = [(*tag[:3], tag[3][state, letters], state) for tag, state, letters in items]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
            names=["key", "part", "block", "entry", "exit"])

    def last(path):
        items = [item for item in path.step(None, FINISH) if item[0] is not None]
        return table(items)

    for group in runs(batches, 3):
        name, part, block = (c[0].as_py() for c in group[:3])
        if name != key:
            if key is not None:
                yield last(path)
            key, path = name, Survivors()
        through = list(zip(*(c.to_pylist() for c in group[3:]), strict=True))
        # letters name entry and rank: ranks order the ways from one entry, and equal entries are compared first
        ways = [(entry, exit_, cost, chr(rank) + chr(entry)) for entry, exit_, cost, rank in through]
        entries = {(exit_, letters): entry for entry, exit_, _, letters in ways}
        settled = path.step((name, part, block, entries), ways)
        if settled:
            yield table(settled)
    if key is not None:
        yield last(path)


NO_EXIT = END


def _edits(batches):
    """Rows (key, part, block, idx, initial, truncated, entry, exit), sorted: the edit of every row.

    A row (key, part, idx, insert, edit, role): role of a row inserted before it, its own edit and new role.
    Rows added at the end of a conversation have the greatest part and idx.
    """
    last = (1 << 62, 1 << 62)
    for key, part, _, idx, initial, truncated, entry, exit_ in runs(batches, 3):
        name, at = key[0].as_py(), part[0].as_py()
        state, goal = entry[0].as_py(), exit_[0].as_py()
        path, settled = Survivors(state), []
        for row in zip(idx.to_pylist(), initial.to_pylist(), truncated.to_pylist(), strict=True):
            settled += path.step(row[0], moves(*row[1:]))
        settled += path.step(None, FINISH) if goal == NO_EXIT else path.finish(goal)
        rows = []
        for tag, state, letters in settled:
            if tag is None:
                rows += [(name, last[0], last[1] + k, None, "I", ROLES[USER] if len(letters) == 2 and k == 0 else ROLES[ASSISTANT])
                         for k in range(len(letters))]
            else:
                other = ROLES[ASSISTANT if state == USER else USER]
                rows.append((name, at, tag, other if letters[0] == "I" else None, letters[-1],
                             ROLES[state] if letters[-1] == "R" else None))
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
            names=["key", "part", "idx", "inserted", "edit", "new_role"])


def group_key(conversation: Column) -> Column:
    """A text that is never null and the same for rows of one conversation only."""
    return F.coalesce(F.concat(F.lit("="), conversation.cast("string")), F.lit(""))


def ordered_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Faults and places of rows (key, turn, role, text): equal rows as one, in order, written once.

    Adds copies (equal rows of one turn), blank, first (no such role and text earlier), truncated, initial,
    part and idx (order over all rows), block.
    """
    marked = rows.withColumn("digest", F.sha2("text", 256)).withColumn(
        "at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = marked.groupBy("key", "role", "digest").agg(F.min("at").alias("earliest"))
    equal = marked.groupBy("key", "turn", "role", "text", "digest", "at").agg(F.count("*").alias("copies"))
    held = equal.join(first, ["key", "role", "digest"]).select(
        "key", "turn", "role", "text", "copies", (F.col("at") == F.col("earliest")).alias("first"))
    tail = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    told = held.withColumn("blank", tail == "").withColumn(
        "truncated", ~tail.isin("", ".", "!", "?")).withColumn("initial", F.substring("role", 1, 1))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    placed = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "place", F.monotonically_increasing_id())
    return cut(placed.withColumn("part", F.shiftright("place", 33)).withColumn(
        "idx", F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).withColumn(
        "block", F.expr(f"idx DIV {block}L")).drop("place"))


def counts(placed: DataFrame) -> DataFrame:
    """Per key: gaps, blank, duplicate, truncated, illegal (all long)."""
    inside = Window.partitionBy("key", "part", "block").orderBy("idx")

    def illegal(before: str, after: str) -> Column:
        return (~F.concat(before, after).isin("su", "ua", "au")).cast("long")

    own = F.when(F.col("blank"), 0).otherwise(F.col("first").cast("long"))  # rows that are no fault by themselves
    segments = placed.select("key", "part", "block", "idx", "initial", "copies", "blank", "first", "truncated",
                             F.lag("initial").over(inside).alias("before")).groupBy("key", "part", "block").agg(
        F.sum(F.col("copies") - 1 + F.coalesce(illegal("before", "initial"), F.lit(0))).alias("illegal"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - own)).alias("duplicate"),
        F.sum(own * F.col("truncated").cast("long")).alias("truncated"),
        F.min_by("initial", "idx").alias("head"), F.max_by("initial", "idx").alias("tail"))
    across = Window.partitionBy("key").orderBy("part", "block")  # as many rows as a conversation has blocks
    faults = segments.withColumn("before", F.lag("tail").over(across)).groupBy("key").agg(
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.coalesce(illegal("before", "head"), F.lit(0))).alias("illegal"))
    turns = placed.where("turn IS NOT NULL").groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key").agg(
        F.expr("try_cast(CAST(max(turn) AS DECIMAL(38, 0)) - min(turn) + 1 - count(1) AS BIGINT)").alias("gaps"))
    return faults.join(turns.withColumn("known", F.lit(True)), "key", "left").select(
        "key", F.when(F.col("known"), F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal")


def decode(placed: DataFrame) -> DataFrame:
    """Edits of the rows that are neither blank nor duplicates, and of rows added at the end (``_edits``)."""
    live = placed.where("NOT blank AND first").select("key", "part", "block", "idx", "initial", "truncated")
    place = ["key", "part", "block"]
    crossing = live.select(*place).distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    through = live.join(crossing, "key", "left_semi").repartition(*place).sortWithinPartitions(*place, "idx").mapInArrow(
        _summaries, "key string, part long, block long, entry int, exit int, cost long, rank int")
    borders = through.repartition("key").sortWithinPartitions(*place, "entry", "exit").mapInArrow(
        _borders, "key string, part long, block long, entry int, exit int")
    # the last block of a conversation has nowhere to go but its end
    behind = Window.partitionBy("key").orderBy("part", "block")
    known = borders.withColumn("exit", F.when(F.lead("part").over(behind).isNull(), NO_EXIT).otherwise(F.col("exit")))
    return live.join(known, place, "left").select(
        *live.columns, F.coalesce("entry", F.lit(START)).alias("entry"), F.coalesce("exit", F.lit(NO_EXIT)).alias("exit")
    ).repartition(*place).sortWithinPartitions(*place, "idx").mapInArrow(
        _edits, "key string, part long, idx long, inserted string, edit string, new_role string")


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The edits of every conversation, and its faults.

    First frame, a row per edit: key (``group_key`` of the conversation), part, idx, step (in their
    order), edit (K, R, D or I), times (equal rows deleted at once), turn, role and text after the edit, cost. Rows
    of K, R and I make up the repaired conversation. Second frame, a row per key: gaps, blank, duplicate,
    truncated, illegal.

    Rows are taken by turn, nulls first, then role and text. A null conversation is one of its own; null
    roles and texts count as one space. Only rows with characters beyond white space are no blanks; texts are
    compared whole, however long. gaps is null where a long does not hold it. An empty
    table gives two empty frames; other columns are not read.
    """
    prepare(rows.sparkSession)
    clean = rows.select(
        group_key(column(conversation)).alias("key"), column(turn).cast("long").alias("turn"),
        *[F.coalesce(column(n).cast("string"), F.lit(" ")).alias(a) for n, a in ((role, "role"), (text, "text"))])
    placed = ordered_rows(clean, block)
    edits = cut(decode(placed))
    own = edits.where(f"part < {1 << 62}")
    joined = placed.join(own.select("part", "idx", "inserted", "edit", "new_role"), ["part", "idx"], "left")
    edit = "struct({} AS step, {} AS edit, {} AS times, {} AS role, {} AS text, {} AS cost)".format
    stays = f"CASE edit WHEN 'D' THEN {DELETE}L WHEN 'R' THEN {REROLE}L ELSE 0L END + " \
            f"CASE WHEN truncated AND edit <> 'D' THEN {TRUNCATED}L ELSE 0L END"
    spare = "CASE WHEN blank OR NOT first THEN copies ELSE copies - 1 END"
    listed = joined.withColumn("e", F.explode(F.expr(f"""filter(array(
        CASE WHEN inserted IS NOT NULL THEN {edit(0, "'I'", "1L", "inserted", "''", f"{INSERT}L")} END,
        CASE WHEN edit IS NOT NULL THEN {edit(1, "edit", "1L", "coalesce(new_role, role)", "text", stays)} END,
        CASE WHEN {spare} > 0 THEN {edit(2, "'D'", spare, "role", "text", f"{spare} * {DELETE}L")} END), e -> e IS NOT NULL)"""
    ))).select("key", "part", "idx", "turn", "e.*")
    ends = edits.where(f"part = {1 << 62}").select(
        "key", "part", "idx", F.lit(None).cast("long").alias("turn"), F.lit(0).alias("step"), "edit",
        F.lit(1).cast("long").alias("times"), F.col("new_role").alias("role"), F.lit("").alias("text"),
        F.lit(INSERT).cast("long").alias("cost"))
    return union(listed, ends), counts(placed)


def _digests(batches):
    """Rows (key, part, idx, step, edit, times, role, text, cost), sorted: (key, cost, audit, sha256).

    Texts are hashed as they come; of a conversation only the letters are held.
    """
    key, cost, letters, digest, first = None, 0, [], hashlib.sha256(), True

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array([cost], pa.int64()), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])],
            names=["key", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        for name, edit, times, role, text, price in zip(*(
                batch.column(c).to_pylist() for c in ("key", "edit", "times", "role", "text", "cost")), strict=True):
            if name != key:
                if key is not None:
                    yield row()
                key, cost, letters, digest, first = name, 0, [], hashlib.sha256(), True
            cost += price
            letters.append(edit * times)
            if edit != "D":
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
    if key is not None:
        yield row()


def digests(edits: DataFrame) -> DataFrame:
    """cost, audit and repaired_sha256 per key. A digest runs through its conversation in order, as a stream."""
    return edits.select("key", "part", "idx", "step", "edit", "times", "role", "text", "cost").repartition(
        "key").sortWithinPartitions("key", "part", "idx", "step").mapInArrow(
        _digests, "key string, cost long, audit string, repaired_sha256 string")


def damage(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Rows (conversation, turn, role, text) with planted faults, by crc32 of 'conversation:turn' modulo 20.

    0 drops the row, 1 empties its text, 2 takes '.', '!' and '?' out, 3 repeats it, 4 makes its role user. Nulls
    count as one space, in the text that is hashed too.
    """
    def filled(name: str) -> Column:
        return F.coalesce(column(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(filled(conversation), F.lit(":"), filled(turn)), "UTF-8")) % 20
    return rows.select(column(conversation), column(turn), filled(role).alias("role"), filled(text).alias("text"),
                       kind.alias("kind")).where("kind <> 0").select(
        column(conversation).alias("conv_id"), column(turn).cast("long").alias("turn"),
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def repaired(conversations: DataFrame) -> DataFrame:
    """Damage ``conversations`` (conv_id, turn, role, text), repair them and report every conversation."""
    prepare(conversations.sparkSession)
    edits, faults = repair(damage(conversations))
    named = conversations.select("conv_id").distinct().withColumn("key", group_key(F.col("conv_id")))
    return named.join(faults.withColumn("found", F.lit(True)), "key", "left").join(digests(edits), "key", "left").select(
        "conv_id", F.when(F.col("found"), F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps"),
        *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def oracle() -> str:
    """The same in DuckDB SQL: a recursion over the rows of all conversations with a path per state."""
    states = ("z", "s", "u", "a")  # nothing yet, after system, user, assistant

    def least(options: list[str]) -> str:
        return f"list_min([{', '.join(options)}])"

    def way(state: str, cost: str, letters: str) -> str:
        return f"CASE WHEN d.{state} IS NOT NULL THEN {{'c': d.{state}.c + {cost}, 'p': d.{state}.p || {letters}}} END"

    user = "(CASE WHEN n.initial = 'u' THEN 0 ELSE 3 END + n.cut)"
    assistant = "(CASE WHEN n.initial = 'a' THEN 0 ELSE 3 END + n.cut)"
    as_user, as_assistant = "CASE WHEN n.initial = 'u' THEN 'K' ELSE 'R' END", "CASE WHEN n.initial = 'a' THEN 'K' ELSE 'R' END"
    stay = {s: way(s, "4", "'D'") for s in states}
    go = {
        "z": [stay["z"]],
        "s": [stay["s"], f"CASE WHEN n.initial = 's' THEN {way('z', 'n.cut', repr('K'))} END"],
        "u": [stay["u"], *[way(s, user, as_user) for s in "zsa"], way("u", f"3 + {user}", f"'I' || {as_user}")],
        "a": [stay["a"], way("u", assistant, as_assistant), *[way(s, f"3 + {assistant}", f"'I' || {as_assistant}") for s in "zsa"]],
    }
    new = ", ".join(f"CASE WHEN n.dead THEN {stay[s]} ELSE {least(go[s])} END AS {s}" for s in states)
    end = least(["d.z", "d.a", way("u", "3", "'I'"), way("s", "6", "'II'")])
    return f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
{CRC_TABLE},
hashed AS (SELECT named.*, {crc_sql("name")} % 20 AS kind FROM named, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2
    THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed WHERE kind <> 0),
placed AS (SELECT *, rtrim(text, '{SPACE}') AS body, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
counted AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen FROM placed),
faulty AS MATERIALIZED (SELECT *, body = '' AS blank, body <> '' AND seen > 1 AS duplicate,
    body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, body = '' OR seen > 1 AS dead,
    CASE WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS cut,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM counted),
d AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'p': ''}} AS z, NULL::STRUCT(c BIGINT, p VARCHAR) AS s,
    NULL::STRUCT(c BIGINT, p VARCHAR) AS u, NULL::STRUCT(c BIGINT, p VARCHAR) AS a FROM conversations
    UNION ALL SELECT d.conv_id, d.pos + 1, {new}
    FROM d JOIN faulty n ON n.conv_id IS NOT DISTINCT FROM d.conv_id AND n.pos = d.pos + 1),
best AS (SELECT conv_id, {end} AS e FROM d QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
letters AS (SELECT conv_id, e.p AS audit, unnest(range(1, length(e.p) + 1)) AS i FROM best),
edits AS (SELECT conv_id, i, audit[i] AS edit, sum((audit[i] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS pos,
    sum((audit[i] <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS out_ FROM letters),
kept AS (SELECT e.conv_id, e.i, e.edit, n.role, CASE WHEN e.edit = 'I' THEN '' ELSE n.text END AS text,
    count(*) OVER w AS k, first_value(CASE WHEN e.edit = 'K' THEN n.initial ELSE 'u' END) OVER w AS head
    FROM edits e LEFT JOIN faulty n ON n.conv_id IS NOT DISTINCT FROM e.conv_id AND n.pos = e.pos WHERE e.edit <> 'D'
    WINDOW w AS (PARTITION BY e.conv_id ORDER BY e.i)),
said AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (k + (head = 's')::INT) % 2 = 1 THEN 'user'
    ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS digest FROM kept GROUP BY conv_id),
sums AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.e.c AS cost, b.e.p AS audit,
    coalesce(digest, '{hashlib.sha256().hexdigest()}') AS repaired_sha256
FROM best b LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM b.conv_id"""
