"""Conversation repair by cost-to-go over a suffix-shared automaton.

Roles of a sound conversation read ``(s?(ua)+)?`` by their initials.  Rows may be
kept (0), get the role the grammar wants, user or assistant (1), or go (2); an empty
row may be put in anywhere (5).  Blank rows and repeated ones must go; a truncated row
that stays adds 5.  The cheapest edits are wanted, of equal costs the least audit
(the edits' initials in order: D, I, K, R).

What edits cost depends only on a row's role initial and fault, so a conversation is
a short string of such letters, its signature.  The signatures of all conversations are
sorted from their ends: those with a common ending are neighbours, and an ending is a
node of the minimal automaton that they share.  Each node keeps, for each state of the
grammar, the cost to go and the first edit of the best audit from there (the rest of the
audit is that of the node it leads to).  A task walks its sorted range and holds one path:
a node met before is not computed again, and a signature of thousands of conversations
is solved once.  The sort key ends with the id, so that a very common signature is
cut over many tasks.

No conversation's texts are gathered.  Faults come from aggregates over digests (combined
before the shuffle); signatures are read from range-sorted pieces, so a conversation that
holds a third of all rows is spread over tasks.  Only its audit, a letter a row,
is one value, as the result asks.  The edits are applied by streaming a
conversation's rows in order; since its digest is one SHA-256 over all its rows, that last step
is one pass in one task, which holds a batch at a time.

Defined results: null roles and texts count as one space; rows are ordered by turn
(nulls first), then role, then the SHA-256 of the text; a null id is a conversation like
others; roles that do not begin with s, u or a (empty ones too) fit nowhere; a
conversation without rows after damage has zeros, an empty audit and the digest
of the empty string; a span of turns beyond a long gives null gaps; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import BLANKS, small_batches, stored, table

#: Letters of a signature: a to p, role initial (s, u, a, other) plus four times the fault.
INITIALS = "sua"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
MUST_GO = "x"
REROLE, DELETE, INSERT, KEEP_TRUNCATED = 1, 2, 5, 5
#: States of the grammar: start, after s, after u, after a; those it may end in.
ENDS = (0, 3)
#: The state after the row that a state wants (user, but assistant after user).
WANTED = (2, 2, 3, 2)
#: The state after keeping a row by its initial (s, u, a, other), or -1.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
WANTED_ROLE = ("user", "user", "assistant", "user")
#: Neighbouring initials that are sound: s u, u a, a u (as first * 4 + second).
SOUND = (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies: rows after the damage of the query.  A
    dropped row stays with no copies, so its conversation is not lost."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    case = F.crc32(F.concat_ws(":", *shown)) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.when(case == 4, "user").otherwise(role).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"))


def rows_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """The same columns of conversations as they are."""
    blank = F.lit(" ")
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _initial() -> Column:
    first = F.substring("role", 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _marked(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv, turn, role, text): its copies, its letter without
    regard to others, and whether it is the first of its role and text."""
    seen = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(seen == "", BLANK).when(F.right(seen, F.lit(1)).isin(".", "!", "?"), NO_FAULT).otherwise(TRUNCATED)
    base = rows.select("conv", "turn", "role", _digest().alias("digest"), (fault * 4 + _initial()).alias("code"),
                       F.col("copies").cast("bigint").alias("copies"))
    firsts = base.where("copies > 0").groupBy("conv", "role", "digest").agg(
        F.bool_or(F.col("turn").isNull()).alias("no_turn"), F.min("turn").alias("turn"))
    firsts = firsts.select("conv", F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "role", "digest",
                           F.lit(0).alias("code"), F.lit(0).cast("bigint").alias("copies"), F.lit(1).alias("first"))
    return base.withColumn("first", F.lit(0)).unionByName(firsts).groupBy("conv", "turn", "role", "digest").agg(
        F.sum("copies").alias("copies"), F.max("code").alias("code"), F.max("first").alias("first"))


def _pieces(marked: DataFrame) -> DataFrame:
    """The signatures piece by piece, in order of ``part``: conv, part, letters, how
    many distinct turns, the first and the last of them."""
    order = ["conv", "turn", "role", "digest"]
    kind = marked.schema["conv"].dataType.simpleString()
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "copies", "code", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_, conv = TaskContext.get().partitionId(), False, None
        for batch in batches:
            convs = batch.column("conv")
            done = []
            for c, turn, copies, code, first in zip(*(x.to_pylist() for x in batch.columns)):
                if not open_ or c != conv:
                    if open_:
                        done.append((conv, part, letters.decode(), turns, start, last))
                    open_, conv, letters, turns, start, last = True, c, bytearray(), 0, None, None
                if not copies:
                    continue
                if code >> 2 != BLANK:
                    again = DUPLICATE * 4 + (code & 3)
                    letters += bytes([97 + (code if first else again)]) + bytes([97 + again]) * (copies - 1)
                else:
                    letters += bytes([97 + code]) * copies
                if turn is not None and turn != last:
                    turns, start, last = turns + 1, turn if start is None else start, turn
            yield _records(done, convs.type)
        if open_:
            yield _records([(conv, part, letters.decode(), turns, start, last)], convs.type)

    def _records(done: list, conv_type: pa.DataType) -> pa.RecordBatch:
        kinds = [conv_type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["conv", "part", "letters", "turns", "start", "last"]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)

    small_batches(marked.sparkSession)
    return ranged.mapInArrow(run, f"conv {kind}, part int, letters string, turns bigint, start bigint, last bigint")


def _signatures(pieces: DataFrame) -> DataFrame:
    """conv, letters, gaps."""
    whole = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(
        F.struct("part", "letters", "turns", "start", "last"))).alias("p"))
    timed = F.filter("p", lambda x: x["turns"] > 0)
    n = F.size(timed)
    # A turn cut over two pieces is counted in both.
    both = F.arrays_zip(F.slice(timed, 1, F.greatest(n - 1, F.lit(0))).getField("last").alias("a"),
                        F.slice(timed, 2, F.greatest(n - 1, F.lit(0))).getField("start").alias("b"))
    cut = F.size(F.filter(both, lambda x: x["a"] == x["b"]))
    turns = F.aggregate(timed, F.lit(0).cast("bigint"), lambda a, x: a + x["turns"]) - cut
    wide = "decimal(38,0)"
    span = F.array_max(timed.getField("last")).cast(wide) - F.array_min(timed.getField("start")).cast(wide) + 1 - turns.cast(wide)
    return whole.select("conv", F.array_join(F.col("p.letters"), "").alias("letters"),
                        F.when(n == 0, 0).otherwise(span.try_cast("bigint")).alias("gaps"))


class Automaton:
    """The path of endings of the signature at hand: for each node and state the cost to
    go and the first edit of the best audit.  ``solve`` keeps what is shared with the last one."""

    def __init__(self):
        self.key = ""
        # The empty ending: state 1 lacks u a, state 2 lacks a.
        self.cost = array("q", [0, 2 * INSERT, INSERT, 0])
        self.edit = bytearray(b"-II-")

    def _push(self, letter: str) -> None:
        cost, edit, rest = self.cost, self.edit, len(self.cost) - 4
        code = -1 if letter == MUST_GO else ord(letter) - 97
        extra = KEEP_TRUNCATED if code >> 2 == TRUNCATED else 0
        best = []
        for q in range(4):
            options = [(cost[rest + q] + DELETE, "D")]
            if code >= 0:
                to = KEPT[q][code & 3]
                if to >= 0:
                    options.append((cost[rest + to] + extra, "K"))
                options.append((cost[rest + WANTED[q]] + REROLE + extra, "R"))
            best.append(min(options))
        # Two insertions lead from 2 or 3 back there, so one at most is worth it.
        two, three = min(best[2], (best[3][0] + INSERT, "I")), min(best[3], (best[2][0] + INSERT, "I"))
        insert = (two[0] + INSERT, "I")
        for c, e in (min(best[0], insert), min(best[1], insert), two, three):
            cost.append(c)
            edit.append(ord(e))

    def solve(self, key: str) -> tuple[int, str]:
        """Cost and audit of a signature written backwards."""
        n, limit = 0, min(len(key), len(self.key))
        while n < limit and key[n] == self.key[n]:
            n += 1
        del self.cost[4 * (n + 1):], self.edit[4 * (n + 1):]
        for letter in key[n:]:
            self._push(letter)
        self.key = key
        node, q, audit, edit = len(key), 0, bytearray(), self.edit
        while (e := edit[4 * node + q]) != 45:
            audit.append(e)
            if e == 73:  # I
                q = WANTED[q]
                continue
            if e == 75:  # K
                q = KEPT[q][(ord(key[node - 1]) - 97) & 3]
            elif e == 82:  # R
                q = WANTED[q]
            node -= 1
        return self.cost[4 * len(key)], audit.decode()


def _counts(letters: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and unsound neighbours."""
    codes = np.frombuffer(letters.encode(), np.uint8) - 97
    faults = np.bincount(codes >> 2, minlength=4)
    roles = codes & 3
    sound = np.isin(roles[:-1] * 4 + roles[1:], SOUND).sum()
    return int(faults[BLANK]), int(faults[DUPLICATE]), int(faults[TRUNCATED]), max(0, len(roles) - 1) - int(sound)


SOLVED = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _solved(signatures: DataFrame) -> DataFrame:
    """conv and ``SOLVED``: signatures sorted from their ends, solved along one path."""
    kind = signatures.schema["conv"].dataType.simpleString()
    # Blank and repeated rows of any role must go: one letter.
    gone = "".join(chr(97 + f * 4 + i) for f in (BLANK, DUPLICATE) for i in range(4))
    key = F.reverse(F.translate("letters", gone, MUST_GO * len(gone)))
    order = ["key", "letters", "conv"]
    ranged = signatures.withColumn("key", key).repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", "gaps", "letters", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, key, solved, letters, counted = Automaton(), None, None, None, None
        for batch in batches:
            out = []
            for x, k in zip(batch.column("letters").to_pylist(), batch.column("key").to_pylist()):
                if k != key:
                    key, solved = k, automaton.solve(k)
                if x != letters:
                    letters, counted = x, _counts(x)
                out.append((*counted, *solved))
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("gaps"), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))],
                names=["conv", *SOLVED])

    small_batches(signatures.sparkSession)
    return ranged.mapInArrow(run, f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
                                  "illegal bigint, cost bigint, audit string")


class _Edits:
    """The edits of one conversation, asked for row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit or "", 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield "I", WANTED_ROLE[self.state], ""
            self.at, self.state = self.at + 1, WANTED[self.state]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What stands before and in place of the next row: edit, role, text."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state][INITIALS.find(role[:1])]
            yield edit, role, text
        elif edit == "R":
            role, self.state = WANTED_ROLE[self.state], WANTED[self.state]
            yield edit, role, text


def _streams(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Each conversation's solution, followed by its rows in order."""
    heads = solved.withColumn("tag", F.lit(0))
    body = rows.where("copies > 0").withColumn("tag", F.lit(1)).withColumn("digest", _digest())
    both = heads.unionByName(body, allowMissingColumns=True).repartition("conv")
    return both.sortWithinPartitions("conv", "tag", "turn", "role", "digest").select(
        "tag", "conv", "role", "text", "copies", *SOLVED)


def solutions(rows: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of ``rows``
    (as of ``rows_of`` or ``damaged``), one row per conversation."""
    pieces = stored(_pieces(stored(_marked(rows), "turns")), "pieces")
    return stored(_solved(_signatures(pieces)), "audits")


def repair(rows: DataFrame) -> DataFrame:
    """``solutions`` with repaired_sha256, the digest of the repaired ``role:text``
    rows joined by newlines."""
    solved = solutions(rows)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            done = []
            for tag, conv, role, text, copies, *known in zip(*(c.to_pylist() for c in batch.columns)):
                if tag == 0:
                    if head:
                        done.append(close(head, edits, sha, any_))
                    head, edits, sha, any_ = (conv, *known), _Edits(known[-1]), hashlib.sha256(), False
                    continue
                for _ in range(copies):
                    for _, r, t in edits.row(role, text):
                        sha.update((f"\n{r}:" if any_ else f"{r}:").encode())
                        sha.update(t.encode())
                        any_ = True
            yield records(done, batch)
        if head:
            yield records([close(head, edits, sha, any_)], batch)

    def close(head: tuple, edits: _Edits, sha, any_: bool) -> tuple:
        for _, r, _ in edits.inserted():
            sha.update((f"\n{r}:" if any_ else f"{r}:").encode())
            any_ = True
        return (*head, sha.hexdigest())

    def records(done: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [batch.column("conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)],
                                          names=["conv", *SOLVED, "repaired_sha256"])

    small_batches(rows.sparkSession)
    return _streams(rows, solved).mapInArrow(
        run, f"conv {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
             "cost bigint, audit string, repaired_sha256 string")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv, position (from 0), edit (K, R or I), role, text."""
    solved = solutions(rows)
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, conv, n = _Edits(""), None, 0
        for batch in batches:
            done = []
            for tag, c, role, text, copies, *known in zip(*(x.to_pylist() for x in batch.columns)):
                if tag == 0:
                    for n, made in enumerate(edits.inserted(), n):
                        done.append((conv, n, *made))
                    edits, conv, n = _Edits(known[-1]), c, 0
                    continue
                for _ in range(copies):
                    for made in edits.row(role, text):
                        done.append((conv, n, *made))
                        n += 1
            yield records(done, batch)
        if conv is not None or n or edits.audit:
            yield records([(conv, i, *made) for i, made in enumerate(edits.inserted(), n)], batch)

    def records(done: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds = [batch.column("conv").type, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)],
                                          names=["conv", "position", "edit", "role", "text"])

    small_batches(rows.sparkSession)
    return _streams(rows, solved).mapInArrow(run, f"conv {kind}, position bigint, edit string, role string, text string")


def op12_conversation_repair(spark, sf_dir):
    return repair(damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


OP12_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda ch: [ord(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda s, x: CASE WHEN xor(s, x) & 1 = 1 THEN xor(xor(s, x) >> 1, 3988292384) ELSE xor(s, x) >> 1 END), 4294967295) % 20 AS h
  FROM src
), d AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
         CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END AS x
  FROM d
), m AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM r
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
         WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM m
), s AS (
  SELECT conv_id, count(*) + 1 AS i, [
    {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}, {'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']},
    {'c': 5::BIGINT, 'a': 'I', 't': ['assistant:']}, {'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}] AS b
  FROM f GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, [
    list_min([e[1], {'c': two.c + 5, 'a': 'I' || two.a, 't': list_prepend('user:', two.t)}]),
    list_min([e[2], {'c': two.c + 5, 'a': 'I' || two.a, 't': list_prepend('user:', two.t)}]), two, three]
  FROM (
    SELECT *, list_min([e[3], {'c': e[4].c + 5, 'a': 'I' || e[4].a, 't': list_prepend('assistant:', e[4].t)}]) AS two,
           list_min([e[4], {'c': e[3].c + 5, 'a': 'I' || e[3].a, 't': list_prepend('user:', e[3].t)}]) AS three
    FROM (
      SELECT f.conv_id, f.i, list_transform([1, 2, 3, 4], lambda q: list_min([
          {'c': b[q].c + 2, 'a': 'D' || b[q].a, 't': b[q].t},
          CASE WHEN fault IN ('', 't') AND [[2, 3, 0, 0], [0, 3, 0, 0], [0, 0, 4, 0], [0, 3, 0, 0]][q][x] > 0 THEN
            {'c': b[[[2, 3, 0, 0], [0, 3, 0, 0], [0, 0, 4, 0], [0, 3, 0, 0]][q][x]].c + CASE fault WHEN 't' THEN 5 ELSE 0 END,
             'a': 'K' || b[[[2, 3, 0, 0], [0, 3, 0, 0], [0, 0, 4, 0], [0, 3, 0, 0]][q][x]].a,
             't': list_prepend(role || ':' || text, b[[[2, 3, 0, 0], [0, 3, 0, 0], [0, 0, 4, 0], [0, 3, 0, 0]][q][x]].t)} END,
          CASE WHEN fault IN ('', 't') THEN
            {'c': b[[3, 3, 4, 3][q]].c + 1 + CASE fault WHEN 't' THEN 5 ELSE 0 END, 'a': 'R' || b[[3, 3, 4, 3][q]].a,
             't': list_prepend(['user:', 'user:', 'assistant:', 'user:'][q] || text, b[[3, 3, 4, 3][q]].t)} END])) AS e
      FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1
    )
  )
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before * 4 + x NOT IN (6, 11, 14)) AS illegal
  FROM f GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.b[1].c, 0) AS cost,
       coalesce(s.b[1].a, '') AS audit, sha256(coalesce(array_to_string(s.b[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id AND s.i = 1
"""
