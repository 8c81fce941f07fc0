"""Repair of conversation structure by iterative-deepening A*.

Every conversation gets the cheapest edits after which its role initials read ``(s?(ua)+)?``: keep a row (0), give it the
role user or assistant (2), delete it (3), insert an empty user or assistant row (2); an undeleted truncated row
costs 1 more, blank and repeated rows can only be deleted.  Of equally cheap edits the ASCII-least string of
initials D, I, K, R wins.  A depth-first search tries edits in that order under rising cost bounds; a table of failed states
holds what each is known to need at least, so the first accepting path is the answer.

Rows are dealt by ranges of conversation and turn.  A conversation that lies within one range and is short is repaired where it
is.  All others, however long, are cut into blocks of at most :data:`BLOCK` rows: each is searched on its own from every role
state to every role state (a path through a block ends in a row, never in an insertion, so that paths of neighbours
join uniquely), a pass over these small tables picks the states between blocks, and texts and audits are streamed through
a hash in block order.  No task holds more than a block of texts and one byte a block of a conversation.

Nulls in id, turn, role and text read as one space where text is needed; null turns come first and count for no gap; null
ids are one conversation.  Rows of equal turn are ordered by role, then by the first 64 characters of the text, then by its MD5; rows
equal in all of these are interchangeable, and all but one are repeats.  A row whose role is empty cannot be kept.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from telemill.llm.shared import prepare, stage

#: Rows and bytes of text of one block.
BLOCK = 64
BLOCK_BYTES = 4 << 20

#: Role states: nothing yet, after system, after user, after assistant.  ``_NEXT`` gives the state after an initial.
_NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The initial that a changed or inserted row takes in each state, and what ends a conversation from there.
_FILL = "uuau"
_END = ["", "II", "I", ""]
_ROLE = {"u": "user", "a": "assistant"}
_NEVER = 1 << 30

#: A row as a byte: its initial's index in ``_INITIALS`` (4: another), 8 if truncated, 16 if it must go.
_INITIALS = "sua"
_TRUNCATED, _GONE = 8, 16


class Search:
    """Paths through ``rows`` (bytes as above) to state ``goal``, or to an accepting end where ``goal`` is None."""

    def __init__(self, rows: bytes, goal: int | None = None):
        self.rows, self.goal, n = rows, goal, len(rows)
        # Lower bounds of the cost from row i on, whatever the state; raised as states fail.
        least = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            code = rows[i]
            least[i] = least[i + 1] + (3 if code & _GONE else min(3, (code >> 3 & 1) + (0 if code & 7 < 3 else 2)))
        self.need = [list(least) for _ in range(4)]
        for state in range(4):
            self.need[state][n] = 2 * len(_END[state]) if goal is None else 0 if state == goal else _NEVER
        # "Nothing yet" and "after system" cannot be come back to, and only a kept row leads to the second.
        if goal in (0, 1):
            for state in {1, 2, 3} - {goal}:
                self.need[state] = [_NEVER] * (n + 1)
        if goal == 1:
            for i in range(n - 1, -1, -1):
                if rows[i] & (7 | _GONE):
                    self.need[0][i] = _NEVER
                else:
                    break

    def _edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Letter, cost, next row and next state of each edit, in ASCII order."""
        fill = _NEXT[state][_FILL[state]]
        if i == len(self.rows):
            if self.goal is None and _END[state]:
                yield "I", 2, i, fill
            return
        code = self.rows[i]
        yield "D", 3, i + 1, state
        yield "I", 2, i, fill
        if not code & _GONE:
            extra = code >> 3 & 1
            if code & 7 < 3:
                kept = _NEXT[state].get(_INITIALS[code & 7])
                if kept is not None:
                    yield "K", extra, i + 1, kept
            yield "R", 2 + extra, i + 1, fill

    def _ends(self, i: int, state: int) -> bool:
        return i == len(self.rows) and (not _END[state] if self.goal is None else state == self.goal)

    def _within(self, start: int, bound: int) -> str | None:
        """The first path from ``start`` that costs at most ``bound``."""
        if self._ends(0, start):
            return ""
        need, path = self.need, []
        # One frame a depth: row, state, budget, edits left, least that any edit would take.
        stack = [[0, start, bound, self._edits(0, start), _NEVER]]
        while stack:
            frame = stack[-1]
            for letter, cost, row, state in frame[3]:
                rest = frame[2] - cost
                if need[state][row] > rest:
                    frame[4] = min(frame[4], cost + need[state][row])
                    continue
                path.append((letter, cost))
                if self._ends(row, state):
                    return "".join(x for x, _ in path)
                stack.append([row, state, rest, self._edits(row, state), _NEVER])
                break
            else:
                row, state, _, _, least = stack.pop()
                need[state][row] = max(need[state][row], least)
                if stack:
                    _, cost = path.pop()
                    stack[-1][4] = min(stack[-1][4], cost + need[state][row])
        return None

    def best(self, start: int) -> tuple[int, str] | None:
        """Cost and edits of the cheapest path from ``start``, the ASCII-least of equally cheap ones; None if there is none."""
        while self.need[start][0] < _NEVER:
            bound = self.need[start][0]
            found = self._within(start, bound)
            if found is not None:
                return bound, found
        return None


def follow(rows: bytes, audit: str, state: int = 0) -> Iterator[tuple[int, str | None]]:
    """For each row that stays: its index (-1 if inserted) and its new role (None if kept)."""
    i = 0
    for letter in audit:
        if letter == "D":
            i += 1
        elif letter == "K":
            state = _NEXT[state][_INITIALS[rows[i] & 7]]
            yield i, None
            i += 1
        else:
            initial = _FILL[state]
            state = _NEXT[state][initial]
            yield (-1, _ROLE[initial]) if letter == "I" else (i, _ROLE[initial])
            i += letter == "R"


# -- rows ---------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Columns ``_c`` (id), ``_t`` (turn), ``_r`` (role), ``_x`` (text) and ``_n``: how often the row stands there after damage.

    A dropped row stays with ``_n`` 0, so that every conversation keeps a row.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    out = rows.select(
        F.col("conv_id").alias("_c"), F.col("turn").cast("long").alias("_t"), F.coalesce(F.col("role"), space).alias("_r"),
        F.coalesce(F.col("text"), space).alias("_x"), (F.crc32(name) % 20).alias("_f"))
    return out.select(
        "_c", "_t", F.when(F.col("_f") == 4, "user").otherwise(F.col("_r")).alias("_r"),
        F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace("_x", "[.!?]", "")).otherwise(F.col("_x")).alias("_x"),
        F.when(F.col("_f") == 0, 0).when(F.col("_f") == 3, 2).otherwise(1).alias("_n"))


def _last_sign() -> Column:
    """The last character that is no white space, or the empty text."""
    return F.right(F.rtrim("_x", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))


def ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows with ``_first`` (role and text not seen before), dealt and sorted by conversation, turn, role and text."""
    # Row numbers tell equal rows apart; both uses of `rows` read the same files, so they agree.
    own = rows.select(
        "*", F.md5(F.concat_ws(":", F.length("_r"), "_r", "_x")).alias("_h"), (_last_sign() != "").alias("_says"),
        F.monotonically_increasing_id().alias("_i"))
    place = F.struct("_t", "_i")
    again = own.where("_says AND _n > 0").groupBy("_c", "_h").agg(
        F.min(place).alias("_least"), F.count("*").alias("_count")).where("_count > 1").select(
        F.col("_c").alias("_c2"), F.col("_h").alias("_h2"), F.col("_least._i").alias("_first_i"))
    marked = own.join(again, F.col("_c").eqNullSafe(F.col("_c2")) & (F.col("_h") == F.col("_h2")), "left").select(
        "_c", "_t", "_r", "_x", "_n", "_says", "_h", "_i", F.left("_x", F.lit(64)).alias("_p"),
        F.coalesce(F.col("_first_i") == F.col("_i"), F.lit(True)).alias("_first"),
        (~_last_sign().isin(".", "!", "?")).alias("_cut"))
    keys = ["_c", "_t", "_r", "_p", "_h", F.desc("_first"), "_i"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return marked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select(
        "_c", "_t", "_r", "_x", "_n", "_first", "_says", "_cut")


_FACTS = "turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"
_PIECE = f"""_c {{id}}, part long, block long, {_FACTS}, cost long, audit string, repaired_sha256 string,
    costs array<int>, ranks array<int>, audits array<string>, rows binary, roles array<string>, texts array<string>"""
_NAMES = [f.split()[0] for f in _FACTS.split(", ")]


class _Block:
    """Rows of one conversation, one after another, and what is known of them."""

    def __init__(self, conv):
        self.conv, self.codes, self.roles, self.texts, self.bytes = conv, bytearray(), [], [], 0
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = self.first_role = self.last_role = None

    def add(self, turn, role: str, text: str, first: bool, says: bool, cut: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        initial = role[:1]
        if self.last_role is not None:
            self.illegal += self.last_role + initial not in ("su", "ua", "au")
        self.first_role = initial if self.first_role is None else self.first_role
        self.last_role = initial
        code = "sua".find(initial) if initial else -1
        code = 4 if code < 0 else code
        if not says:
            self.blank += 1
            code |= _GONE
        elif not first:
            self.duplicate += 1
            code |= _GONE
        elif cut:
            self.truncated += 1
            code |= _TRUNCATED
        self.codes.append(code)
        gone = code & _GONE
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.bytes += 0 if gone else len(text)

    def facts(self) -> dict:
        return {n: getattr(self, n) for n in _NAMES}

    def lines(self, audit: str, state: int = 0) -> Iterator[str]:
        for i, role in follow(self.codes, audit, state):
            yield f"{role}:{self.texts[i] if i >= 0 else ''}" if role else f"{self.roles[i]}:{self.texts[i]}"

    def whole(self) -> dict:
        cost, audit = Search(bytes(self.codes)).best(0)
        text = "\n".join(self.lines(audit))
        return {"_c": self.conv, **self.facts(), "cost": cost, "audit": audit,
                "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}

    def piece(self, part: int, number: int) -> dict:
        """Cost, rank and edits from each state to each state, the rank telling which edits are ASCII-less from the same state."""
        found = [[None] * 4 for _ in range(4)]
        for goal in range(4):
            search = Search(bytes(self.codes), goal)
            for start in range(4):
                found[start][goal] = search.best(start)
        costs, ranks, audits = [], [], []
        for ways in found:
            order = sorted({w[1] for w in ways if w})
            costs += [w[0] if w else -1 for w in ways]
            ranks += [order.index(w[1]) if w else -1 for w in ways]
            audits += [w[1] if w else None for w in ways]
        return {"_c": self.conv, "part": part, "block": number, **self.facts(), "costs": costs, "ranks": ranks,
                "audits": audits, "rows": bytes(self.codes), "roles": self.roles, "texts": self.texts}


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, count: int = 256, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(map(len, row.get("texts") or ())) + 400
        if len(held) >= count or weight >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _cutter(schema: pa.Schema):
    """Turns sorted rows into repaired conversations and, for long ones and those at a range's ends, pieces."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows():
            block, number, opened = None, 0, False
            for batch in batches:
                names = ("_c", "_t", "_r", "_x", "_n", "_first", "_says", "_cut")
                for conv, turn, role, text, n, first, says, cut in zip(*(_column(batch, x) for x in names)):
                    if block is None or conv != block.conv:
                        if block is not None:
                            # The first conversation of a range may have begun in the one before.
                            yield block.piece(part, number) if number or not opened else block.whole()
                            opened = True
                        block, number = _Block(conv), 0
                    for k in range(n):
                        if len(block.codes) >= BLOCK or block.bytes >= BLOCK_BYTES:
                            yield block.piece(part, number)
                            block, number = _Block(conv), number + 1
                        block.add(turn, role, text, first and k == 0, says, cut)
            if block is not None:
                yield block.piece(part, number)

        yield from _batches(rows(), schema)

    return run


# -- blocks of long conversations ---------------------------------------------


class _Chain:
    """Blocks of one conversation in order: the cheapest edits up to each role state, and which state each block began in."""

    def __init__(self):
        self.cost, self.rank, self.back, self.keys = [0, None, None, None], [0, 0, 0, 0], bytearray(), []

    def add(self, costs: list[int], ranks: list[int], key: tuple[int, int]) -> None:
        best = [None] * 4
        came = 0
        for goal in range(4):
            for start in range(4):
                if self.cost[start] is not None and costs[4 * start + goal] >= 0:
                    way = (self.cost[start] + costs[4 * start + goal], self.rank[start], ranks[4 * start + goal], start)
                    best[goal] = way if best[goal] is None else min(best[goal], way)
            came |= (best[goal][3] if best[goal] else 0) << 2 * goal
        # Edits of one block never begin those of another way through it, so earlier blocks decide first.
        order = sorted({w[1:3] for w in best if w})
        self.cost = [w[0] if w else None for w in best]
        self.rank = [order.index(w[1:3]) if w else 0 for w in best]
        self.back.append(came)
        self.keys.append(key)

    def states(self) -> Iterator[tuple[tuple[int, int], int, int, str]]:
        """For each block, last first: its key, the states before and after it, and what is inserted behind it."""
        _, _, state = min((c + 2 * len(_END[s]), self.rank[s], s) for s, c in enumerate(self.cost) if c is not None)
        tail = _END[state]
        for i in range(len(self.keys) - 1, -1, -1):
            before = self.back[i] >> 2 * state & 3
            yield self.keys[i], before, state, tail
            state, tail = before, ""


def _chooser(schema: pa.Schema):
    def run(batches):
        def rows():
            conv, chain = None, None
            for batch in batches:
                for c, part, block, costs, ranks in zip(*(_column(batch, x) for x in ("_c", "part", "block", "costs", "ranks"))):
                    if chain is None or c != conv:
                        yield from told(conv, chain)
                        conv, chain = c, _Chain()
                    chain.add(costs, ranks, (part, block))
            yield from told(conv, chain)

        def told(conv, chain):
            for (part, block), before, after, tail in (chain.states() if chain else ()):
                yield {"_c": conv, "part": part, "block": block, "before": before, "after": after, "tail": tail}

        yield from _batches(rows(), schema, 4096)

    return run


class _Whole:
    """Facts, audit and hash of a conversation whose blocks come in order."""

    def __init__(self, conv):
        self.conv, self.hash, self.audit, self.any, self.cost = conv, hashlib.sha256(), [], False, 0
        self.sums = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0)
        self.first_turn = self.last_turn = self.last_role = None

    def add(self, row: dict) -> None:
        for n in self.sums:
            self.sums[n] += row[n]
        if row["first_turn"] is not None:
            self.sums["turns"] -= row["first_turn"] == self.last_turn
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]
        if row["first_role"] is not None:
            if self.last_role is not None:
                self.sums["illegal"] += self.last_role + row["first_role"] not in ("su", "ua", "au")
            self.last_role = row["last_role"]
        way = 4 * row["before"] + row["after"]
        self.cost += row["costs"][way] + 2 * len(row["tail"])
        audit = row["audits"][way]
        block = _Block(self.conv)
        block.codes, block.roles, block.texts = row["rows"], row["roles"], row["texts"]
        self.audit.append(audit)
        for line in block.lines(audit, row["before"]):
            self._line(line)
        state = row["after"]
        for _ in row["tail"]:
            self._line(_ROLE[_FILL[state]] + ":")
            state = _NEXT[state][_FILL[state]]
        self.audit.append(row["tail"])

    def _line(self, line: str) -> None:
        self.hash.update((("\n" if self.any else "") + line).encode("utf-8", "surrogatepass"))
        self.any = True

    def row(self) -> dict:
        return {"_c": self.conv, **self.sums, "first_turn": self.first_turn, "last_turn": self.last_turn, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _joiner(schema: pa.Schema):
    def run(batches):
        def rows():
            whole = None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                    if whole is None or row["_c"] != whole.conv:
                        if whole is not None:
                            yield whole.row()
                        whole = _Whole(row["_c"])
                    whole.add(row)
            if whole is not None:
                yield whole.row()

        yield from _batches(rows(), schema)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: ``conv_id``, its faults, the cost and the initials of its edits, and the repaired text's hash.

    ``rows`` are those of :func:`damage`, or any with the same columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = prepare(rows.sparkSession)
    kind = rows.schema["_c"].dataType.simpleString()

    def arrow(ddl: str) -> pa.Schema:
        from pyspark.sql.types import StructType
        return to_arrow_schema(StructType.fromDDL(ddl))

    piece = _PIECE.format(id=kind)
    pieces = stage(ordered(rows).mapInArrow(_cutter(arrow(piece)), piece), "conversations")
    cut = pieces.where("block IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = f"_c {kind}, part long, block long, before long, after long, tail string"
    states = cut.select("_c", "part", "block", "costs", "ranks").repartition(parts, "_c").sortWithinPartitions(
        "_c", "part", "block").mapInArrow(_chooser(arrow(chosen)), chosen).select(
        F.col("part").alias("_part"), F.col("block").alias("_block"), F.col("_c").alias("_c2"), "before", "after", "tail")
    out = f"_c {kind}, turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, " \
          "cost long, audit string, repaired_sha256 string"
    names = [f.split()[0] for f in out.split(", ")]
    joined = cut.join(
        states, (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block")) & F.col("_c").eqNullSafe(F.col("_c2"))
    ).select(*cut.columns, "before", "after", "tail").repartition(parts, "_c").sortWithinPartitions("_c", "part", "block").mapInArrow(
        _joiner(arrow(out)), out)
    return pieces.where("block IS NULL").select(*names).union(joined).select(
        F.col("_c").alias("conv_id"), F.coalesce(F.expr("last_turn - first_turn + 1 - turns"), F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
