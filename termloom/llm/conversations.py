"""Repair the structure of conversations by the cheapest edits: a DP over a trie of signatures.

A conversation's rows, in order of turn (nulls first), then role and text, become a
signature of a character a row: the role's initial, upper case where the text is cut off,
or ``d`` where the row must go (blank, or a repeat of an earlier role and text). The
cheapest edits depend on the signature alone. Signatures are read from the last row to the
first, because of ties: a layer of the DP then holds the cheapest edits of what follows, and
putting an edit in front never changes which of two rests is the lesser string. Sorted
signatures come to a task one after the other, so the trie needs no more than the path to
the last one: the layers of the shared prefix stay, the others are computed, and the
answer is read at the terminal node. A range of the sorted signatures is a part of the trie.

Edits of a row: Keep (0), Rerole to user or assistant (1), Delete (2); Insert an empty turn of
user or assistant anywhere (5); a row that is cut off and not deleted adds 5. Role
initials afterwards are ``(s?(ua)+)?``. In one state each edit leads to one state, so of two
equally cheap ways the first different edit decides, and a node holds a cost and an edit a
state. Texts never meet in one row: a task streams a conversation's sorted rows behind its
answer. What it holds of a conversation is its signature and audit, a byte a row, which
the result holds too; the repaired text is hashed as it passes, as its hash demands.

Defined cases: a null role or text is one space (so the row is blank); a null conv_id is a
conversation of its own, null turns come first and count in no gap; rows that repeat are
duplicates; ties in turn are ordered by role and text; a conversation without rows keeps a
row of zeros, an empty audit and the hash of the empty text; an empty table gives no rows;
very long texts pass in the batches that Arrow makes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import common

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: States by what was kept last: nothing, system, user, assistant; the role that must follow, and its state.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_WANTS = ("user", "user", "assistant", "user")
_THEN = (_USER, _USER, _ASSISTANT, _USER)
#: A layer: costs by state, edits by state.
Layer = tuple[tuple[int, ...], str]
#: Nothing follows: a system or user turn wants the ones that are missing.
_LAST: Layer = ((0, 2 * INSERT, INSERT, 0), " II ")
_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def turns(rows: DataFrame) -> DataFrame:
    """Only the columns that the operator uses; a null role or text is one space."""
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that a checksum of conv_id and turn picks: one row in five or so."""
    shown = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    code = F.crc32(F.concat_ws(":", *shown).cast("binary")) % 20
    text = F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = turns(rows).withColumn("code", code).filter("code <> 0")
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def signatures(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal), a row a conversation.

    ``rows`` has conv_id, turn, role and text. ``conversations`` (conv_id) names those that
    are told of even without a row. The signature begins with the last row.
    """
    rows = turns(rows)
    heads = (rows if conversations is None else conversations).select("conv_id").distinct()
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition("conv_id")  # a head has no role
    again = Window.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy(F.col("turn").asc_nulls_first())
    rest = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    told = dealt.withColumn("nth", F.row_number().over(again))
    told = told.withColumn("fault", F.when(rest == "", F.lit("b")).when(F.col("nth") > 1, F.lit("d")).when(~F.substring(rest, -1, 1).isin(".", "!", "?"), F.lit("t")).otherwise(F.lit("")))
    ordered = told.sortWithinPartitions("conv_id", F.col("role").isNotNull(), *in_order(), "nth").select("conv_id", "turn", initial.alias("initial"), known.alias("known"), "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        own: _Signature | None = None
        conv_id = None
        for batch in batches:
            for conv, turn, initial, known, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "known", "fault")), strict=True):
                if initial is None:  # the head of the next conversation
                    if own is not None:
                        out.append((conv_id, *own.told()))
                    own, conv_id = _Signature(), conv
                else:
                    own.add(turn, initial, known, fault)
            if len(out) >= common.BATCH_ROWS:
                yield _batch(out, schema)
                out = []
        if own is not None:
            out.append((conv_id, *own.told()))
        if out:
            yield _batch(out, schema)

    schema = _schema(ordered, f"conv_id {_kind(rows)}, signature string, {_STATS}")
    return ordered.mapInArrow(run, f"conv_id {_kind(rows)}, signature string, {_STATS}")


class _Signature:
    """What is told of a conversation, row by row."""

    def __init__(self):
        self.symbols = bytearray()
        self.faults = {"": 0, "b": 0, "d": 0, "t": 0}
        self.least = self.last_turn = self.last_initial = None
        self.n_turns = self.illegal = 0

    def add(self, turn: int | None, initial: str, known: str, fault: str) -> None:
        self.faults[fault] += 1
        symbol = "d" if fault in ("b", "d") else known.upper() if fault == "t" else known
        if self.last_initial is not None:
            self.illegal += self.last_initial + initial not in ("su", "ua", "au")
        self.symbols += symbol.encode()
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn

    def told(self) -> tuple:
        gaps = self.last_turn - self.least + 1 - self.n_turns if self.n_turns else 0
        return self.symbols[::-1].decode(), gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal


def layer(symbol: str, rest: Layer) -> Layer:
    """The cheapest edits of a row and what follows, by the state before it; ties take the least edit."""
    after, _ = rest
    role, kept = symbol.lower(), CUT_OFF if symbol.isupper() else 0
    best = []
    for state in range(4):
        options = [(DELETE + after[state], "D")]
        if role != "d":
            then = _THEN[state]
            options.append((REROLE + kept + after[then], "R"))
            if role == _WANTS[state][0]:
                options.append((kept + after[then], "K"))
            elif role == "s" and state == _START:
                options.append((kept + after[_SYSTEM], "K"))
        best.append(min(options))
    # two insertions in a row before a row lead back to the state, or to one that a single one reaches
    plain = best[:]
    for state in (_USER, _ASSISTANT):
        best[state] = min(plain[state], (INSERT + plain[_THEN[state]][0], "I"))
    for state in (_START, _SYSTEM):
        best[state] = min(plain[state], (INSERT + best[_USER][0], "I"))
    return tuple(c for c, _ in best), "".join(e for _, e in best)


class Trie:
    """The path of a prefix trie to the signature that was asked for last, with a layer a node.

    Asked in sorted order, every node is computed once.
    """

    def __init__(self):
        self.path, self.layers, self.computed = "", [_LAST], 0

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, audit) at the terminal node of a signature."""
        shared = _shared(self.path, signature)
        del self.layers[shared + 1 :]
        for symbol in signature[shared:]:
            self.layers.append(layer(symbol, self.layers[-1]))
            self.computed += 1
        self.path = signature
        at, state, audit = len(signature), _START, []
        while (edit := self.layers[at][1][state]) != " ":
            audit.append(edit)
            if edit == "K" and state == _START and signature[at - 1] in "sS":
                state = _SYSTEM
            elif edit != "D":
                state = _THEN[state]
            at -= edit != "I"
        return self.layers[-1][0][_START], "".join(audit)


def _shared(a: str, b: str) -> int:
    """The length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def cheapest_edits(told: DataFrame) -> DataFrame:
    """The rows of ``signatures`` with cost and audit in place of the signature."""
    spark = told.sparkSession
    written, _ = common.materialize(told, "signatures")  # the ranges come from a sample of it
    dealt = written.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature")
    kind = f"conv_id {_kind(told)}, cost long, audit string, {_STATS}"
    schema = _schema(told, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last, answer = Trie(), None, (0, "")
        for batch in batches:
            costs, audits = [], []
            for signature in batch.column("signature").to_pylist():
                if signature != last:
                    answer, last = trie.answer(signature), signature
                costs.append(answer[0])
                audits.append(answer[1])
            values = {"cost": costs, "audit": audits} | {c: batch.column(c) for c in schema.names if c not in ("cost", "audit")}
            yield pa.RecordBatch.from_arrays([common.as_array(values[f.name], f.type) for f in schema], schema=schema)

    return dealt.mapInArrow(run, spark.createDataFrame([], kind).schema)


def _edited(batches: Iterator[pa.RecordBatch], head: list[str]) -> Iterator[tuple]:
    """Of each conversation its head, a tuple, and then (edit, role, text) of every repaired turn."""
    audit, at, state = "", 0, _START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            yield "I", _WANTS[state], ""
            at, state = at + 1, _THEN[state]

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*head, "role", "text")]
        for *values, role, text in zip(*columns, strict=True):
            if role is None:
                yield from inserted()
                audit, at, state = values[head.index("audit")], 0, _START
                yield (None, *values)
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "K" and state == _START and role[:1] == "s":
                yield edit, role, text
                state = _SYSTEM
                continue
            yield edit, role if edit == "K" else _WANTS[state], text
            state = _THEN[state]
    yield from inserted()


def _behind_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Each conversation's answer, and behind it its rows in order."""
    both = turns(rows).unionByName(answers, allowMissingColumns=True).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.col("role").isNotNull(), *in_order())


def repaired(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, places from 0."""
    dealt = _behind_answers(rows, answers.select("conv_id", "audit"))
    kind = f"conv_id {_kind(rows)}, place long, edit string, role string, text string"
    schema = _schema(rows, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, place, out = None, 0, []
        for edit, *values in _edited(batches, ["conv_id", "audit"]):
            if edit is None:
                conv_id, place = values[0], 0
                continue
            out.append((conv_id, place, edit, *values))
            place += 1
            if len(out) >= common.BATCH_ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return dealt.mapInArrow(run, kind)


def digests(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers with the SHA-256 of the repaired ``role:text``, joined by newlines."""
    head = answers.columns
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in answers.schema) + ", repaired_sha256 string"
    schema = _schema(rows, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, digest, first, out = None, hashlib.sha256(), True, []
        for edit, *values in _edited(batches, head):
            if edit is not None:
                role, text = values
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
                continue
            if known is not None:
                out.append((*known, digest.hexdigest()))
            known, digest, first = values, hashlib.sha256(), True
            if len(out) >= common.BATCH_ROWS:
                yield _batch(out, schema)
                out = []
        if known is not None:
            out.append((*known, digest.hexdigest()))
        if out:
            yield _batch(out, schema)

    return _behind_answers(rows, answers).mapInArrow(run, kind)


def _kind(df: DataFrame) -> str:
    return df.schema["conv_id"].dataType.simpleString()


def _schema(df: DataFrame, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], kind).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
