"""Conversation structure repair: cheapest edits by composing the turns, an edit transducer and a grammar of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import kept, release, table
from .words import trimmed

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar (s?(ua)+)?: state -> {role initial: next state}; states 0 and 3 accept.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: White space, inside a character class.
_SPACE = r"\x20\x09-\x0D"


def _choice(initial: str, truncated: bool, after: list[int]) -> tuple[list[int], str]:
    """(cost to the end from each grammar state before a row, the row's policy) from the costs after the row.

    Weights are (cost, labels), least first.  The composition is deterministic in its labels
    (from a state each letter leads to one state), so of paths of equal cost the one whose
    first letter is less is less, and strings need not be compared: the policy has the letter
    for each state, D, K, R, or I (insert, then look again from the state it leads to).
    Inserts go round in the grammar, but meeting a state again only adds cost, so relaxing
    them as often as there are states finds all that matter.
    """
    ways: list[dict[str, int]] = []
    extra = TRUNCATED if truncated else 0
    for state, arcs in enumerate(GRAMMAR):
        own = {"D": after[state] + DELETE, "R": after[arcs[_new_role(state)]] + REROLE + extra}
        if initial in arcs:
            own["K"] = after[arcs[initial]] + KEEP + extra
        ways.append(own)
    cost = [min(w.values()) for w in ways]
    for _ in GRAMMAR:
        cost = [min(c, cost[GRAMMAR[k][_new_role(k)]] + INSERT) for k, c in enumerate(cost)]
    for state, own in enumerate(ways):
        own["I"] = cost[GRAMMAR[state][_new_role(state)]] + INSERT
    return cost, "".join(min(w, key=lambda x: (w[x], x)) for w in ways)


def _at_end() -> list[int]:
    """Cost from each grammar state after the last row: inserts up to an accepting state."""
    out = []
    for state in range(len(GRAMMAR)):
        n = 0
        while state not in ACCEPTS:
            state, n = GRAMMAR[state][_new_role(state)], n + 1
        out.append(n * INSERT)
    return out


def _new_role(state: int) -> str:
    return next(x for x in GRAMMAR[state] if x in ROLES)


class _Walk:
    """Follows policies from the first row of a conversation on; gives (edit, role, text) one after another."""

    def __init__(self):
        self.state = 0

    def _insert(self) -> tuple[str, str, str]:
        initial = _new_role(self.state)
        self.state = GRAMMAR[self.state][initial]
        return "I", ROLES[initial], ""

    def row(self, policy: str, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        while policy[self.state] == "I":
            yield self._insert()
        edit = policy[self.state]
        if edit != "D":
            initial = role[:1] if edit == "K" else _new_role(self.state)
            self.state = GRAMMAR[self.state][initial]
            role = role if edit == "K" else ROLES[initial]
        yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        while self.state not in ACCEPTS:
            yield self._insert()


def _policies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from the last of each conversation to its first -> the same with a policy each (DDDD where the row must go)."""
    conversation, after = object(), []
    for batch in batches:
        out = []
        for conv, role, must_go, truncated, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "must_go", "truncated", "copies")), strict=True):
            if conv != conversation:
                conversation, after = conv, _at_end()
            # rows that must go are best deleted before anything is inserted: D is the least letter, at no more cost
            gone = copies if must_go else copies - 1
            after = [x + gone * DELETE for x in after]
            policy = "D" * len(GRAMMAR)
            if not must_go:
                after, policy = _choice(role[:1], truncated, after)
            out.append(policy)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "policy"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows from the first of each conversation to its last -> (conv_id, turn, role before, edit, role, text, truncated) for each edit."""
    conversation, walk = object(), None
    for batch in batches:
        columns = ("conv_id", "turn", "role", "text", "truncated", "copies", "policy")
        for conv, turn, role, text, truncated, copies, policy in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if walk is None or conv != conversation:
                if walk is not None:
                    yield from ((conversation, None, None, *x, False) for x in walk.end())
                conversation, walk = conv, _Walk()
            for edit, new_role, new_text in walk.row(policy, role, text):
                own = edit != "I"
                yield conv, turn if own else None, role if own else None, edit, new_role, new_text, own and truncated
            for _ in range(copies - 1):
                yield conv, turn, role, "D", role, text, truncated
    if walk is not None:
        yield from ((conversation, None, None, *x, False) for x in walk.end())


_EDITS = "conv_id {id}, place long, edit string, turn long, role string, text string"


def _edits(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in _EDITS.split(", ")]
        rows, size, conversation, place = [], 0, object(), 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for conv, turn, _, edit, role, text, _ in _walked(batches):
            place = place + 1 if conv == conversation else 0
            conversation = conv
            rows.append((conv, place, edit, turn, role, text))
            size += len(text) + 100
            if size > 1 << 22:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return trimmed(run)


_DIGESTS = "conv_id {id}, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        costs = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
        digest = last = None
        names = [x.split()[0] for x in _DIGESTS.split(", ")]

        def ended() -> pa.RecordBatch:
            out = [(c, i, k, "".join(a), d.hexdigest()) for c, i, k, a, d in rows]
            types = (id_type, pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for conv, _, before, edit, role, text, truncated in _walked(batches):
            if not rows or conv != rows[-1][0]:
                if len(rows) >= 4096:
                    yield ended()
                    rows = []
                digest, last = None, None
                rows.append([conv, 0, 0, [], hashlib.sha256()])
            row = rows[-1]
            if before is not None:
                row[1] += last is not None and last + before[:1] not in ("su", "ua", "au")
                last = before[:1]
            row[2] += costs[edit] + (TRUNCATED if truncated and edit != "D" else 0)
            row[3].append(edit)
            if edit != "D":
                row[4].update((b"" if digest is None else b"\n") + f"{role}:{text}".encode())
                digest = True
        if rows:
            yield ended()

    return trimmed(run)


class Repaired:
    """The result of repair(): rows with faults and policies, and what follows from them."""

    def __init__(self, rows: DataFrame, ids: DataFrame):
        self.rows, self.ids = rows, ids
        self._id = ids.schema["conv_id"].dataType

    def _in_order(self) -> DataFrame:
        rows = self.rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
        return rows.select("conv_id", "turn", "role", "text", "truncated", "copies", "policy")

    def _typed(self) -> tuple[str, pa.DataType]:
        from pyspark.sql.pandas.types import to_arrow_type

        return self._id.simpleString(), to_arrow_type(self._id)

    def edits(self) -> DataFrame:
        """(conv_id, place, edit, turn, role, text): the edits in order; K, R and I give the repaired turns, D what is deleted."""
        name, kind = self._typed()
        return self._in_order().mapInArrow(_edits(kind), _EDITS.format(id=name))

    def summary(self) -> DataFrame:
        """A row for each conversation, those without a row left included: gaps, faults, cost, audit and a hash of the repaired turns."""
        name, kind = self._typed()
        first = F.when(F.col("must_go"), 0).otherwise(1)  # copies of a row after its first are duplicates
        counts = self.rows.groupBy(F.col("conv_id").alias("_counted")).agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
            F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(~F.col("blank"), F.col("copies") - first).otherwise(0)).alias("duplicate"),
            F.sum(F.when(F.col("truncated") & ~F.col("must_go"), 1).otherwise(0)).alias("truncated"),
        )
        walked = self._in_order().mapInArrow(_digests(kind), _DIGESTS.format(id=name)).withColumnRenamed("conv_id", "_walked")
        out = self.ids.join(counts, F.col("conv_id").eqNullSafe(F.col("_counted")), "left").join(walked, F.col("conv_id").eqNullSafe(F.col("_walked")), "left")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        empty = F.lit(hashlib.sha256().hexdigest())
        return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def repair(turns: DataFrame, ids: DataFrame | None = None) -> Repaired:
    """Finds the faults of conversations and their cheapest repair into ``(s?(ua)+)?`` by role initials.

    ``turns`` has conv_id, turn, role and text; rows are taken by turn (nulls first), then role,
    then text.  A row is blank without a character that is no white space, a duplicate if its
    role and text stand earlier in the conversation, truncated if its last such character is
    none of ``.!?``; the first of these counts.  Edits: Keep (0), Rerole to user or assistant
    (3), Delete (4; blank and duplicate rows must go), Insert an empty user or assistant turn
    (3); a truncated row that stays adds 3.  The cheapest sequence of edits is taken, of several
    the one whose initials come first in ASCII.

    This is the shortest path through the composition of three machines: the rows (an acceptor,
    a chain), the edits (a transducer of one state) and the grammar of roles, expanded only as
    far as a row is met.  It is found in topological order over weights (cost, labels): a pass
    over the rows from last to first gives each row a policy, the least edit for each state of
    the grammar, and one from first to last follows it.  Both are streams of sorted rows that
    hold four numbers a conversation, so a conversation of any length needs no more memory than
    a row; since its edits depend on each other in sequence, one task streams it.  Equal rows
    are one row with a count before that, and whether a row was seen earlier is an aggregate by
    role and text (128 bits), which Spark splits where one text is frequent.

    Edge cases: a null role or text is one space, so a null text is blank; a null id is a
    conversation, a null turn comes first and counts for no gap; repeated rows are duplicates;
    an empty role has no initial; columns other than these four are not read; an empty table
    gives an empty result.  ``ids`` (conv_id): conversations to report, all of ``turns`` by default.
    """
    given = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    inked = F.regexp_replace("text", rf"[{_SPACE}]+\z", "")
    rows = kept(
        given.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"name": F.md5("text"), "blank": inked == "", "truncated": ~F.substring(inked, -1, 1).isin(".", "!", "?")})
    )
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("name").alias("_name")).agg(F.min(at).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("name") == F.col("_name"))
    faulty = rows.join(seen, same).withColumn("must_go", F.col("blank") | ~F.col("turn").eqNullSafe(F.col("first.turn")))
    faulty = faulty.select("conv_id", "turn", "role", "text", "copies", "blank", "truncated", "must_go")
    backwards = faulty.repartition("conv_id").sortWithinPartitions("conv_id", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in faulty.schema) + ", policy string"
    out = kept(backwards.mapInArrow(trimmed(_policies), schema))
    release(rows)
    return Repaired(out, (turns if ids is None else ids).select("conv_id").distinct())


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations with planted faults, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space there and in role and text."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    rows = turns.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair(damaged(turns), turns).summary()
