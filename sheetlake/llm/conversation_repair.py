"""Repair of damaged conversations: cheapest edits, and of equally cheap ones the least audit.

A repaired conversation's role initials read ``(s?(ua)+)?``.  States of the output so far: nothing yet,
after the system turn, after a user turn, after an assistant turn; a node is a row's position with a state.  Costs to the end come from a
dynamic program over positions.  Arcs that lie on a cheapest path carry one audit letter each; nodes are
ranked by their least audit of length 1, 2, 4, ... (a rank of twice the length is the rank of the pair of
ranks here and where the pointer leads), pointers double alongside, and the path is read off the doubled
pointers.

Rows are sorted over the cluster by conversation and turn.  A piece is a run of rows of one
conversation in one task, bounded in rows and bytes.  Nearly all conversations are one piece and are
repaired where they lie.  Of those that go over a task's edge or a piece's bound, a piece sends its
four-by-four cost matrix; one small row a piece gives the costs at its end and, once ranked, its
way through the states; then all pieces write their part of the audit side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.tables import arrow_map, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Audit letters in ASCII order; column k of the arcs.
LETTERS = b"DIKR"
#: States of the output: nothing, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant turn that the repair chooses (Insert, Rerole).
CHOSEN = np.array([USER, USER, ASSISTANT, USER])
#: State after keeping a row of class other, s, u, a (columns); -1: not allowed.
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
FAR = 1 << 60
MOST = (1 << 63) - 1
END = (0, FAR, FAR, 0)
#: A row's code: class of its initial, and its fault.
OTHER, BLANK, DUPLICATE, SHORT, GONE = 0, 4, 8, 12, 16
#: Bounds of a piece, and rows ranked together.
PIECE_ROWS, PIECE_BYTES, TOGETHER = 4096, 4 << 20, 4096

ROLE_NAME = {USER: "user", ASSISTANT: "assistant"}


# ---- the dynamic program and the ranking, on the codes of some rows ------------------------------------


def _close(a: int, b: int, c: int, d: int) -> tuple[int, int, int, int]:
    """Costs once turns may be inserted: after a user turn an assistant turn, else a user turn."""
    user, last = min(c, INSERT + d), min(d, INSERT + c)
    return min(a, INSERT + user), min(b, INSERT + user), user, last


def costs(codes: bytes, end: tuple[int, ...], closes: bool) -> np.ndarray:
    """Least cost from every position and state to the end; ``closes``: turns may be inserted at the end."""
    out = np.empty((len(codes) + 1, 4), np.int64)
    a, b, c, d = _close(*end) if closes else end
    out[len(codes)] = a, b, c, d
    for i in range(len(codes) - 1, -1, -1):
        code = codes[i]
        kind, fault = code & 3, code & 28
        na, nb, nc, nd = a + DELETE, b + DELETE, c + DELETE, d + DELETE
        if fault != BLANK and fault != DUPLICATE:
            extra = TRUNCATED if fault == SHORT else 0
            redo = REROLE + extra
            na, nb, nc, nd = min(na, redo + c), min(nb, redo + c), min(nc, redo + d), min(nd, redo + c)
            if kind == 1:
                na = min(na, extra + b)
            elif kind == 2:
                na, nb, nd = min(na, extra + c), min(nb, extra + c), min(nd, extra + c)
            elif kind == 3:
                nc = min(nc, extra + d)
        a, b, c, d = _close(na, nb, nc, nd)
        out[i] = a, b, c, d
    return out


def passage(codes: bytes, closes: bool) -> list[int]:
    """Cost matrix of some rows: from each state before them to each state after them, row by row."""
    columns = [costs(codes, tuple(0 if s == t else FAR for s in range(4)), closes)[0] for t in range(4)]
    return [min(int(columns[t][s]), FAR) for s in range(4) for t in range(4)]


class Ranked:
    """Least cheapest path from every node of some runs of rows, by prefix doubling."""

    def __init__(self, runs: list[tuple[bytes, tuple[int, ...], bool]]):
        starts = np.cumsum([0, *[len(codes) + 1 for codes, _, _ in runs]])
        self.starts = starts
        total = int(starts[-1])
        cost = np.concatenate([costs(*run) for run in runs])
        code = np.full(total, GONE, np.int64)  # of the row at a position; at the end of a run there is none
        inserts = np.ones(total, bool)
        for (codes, _, closes), at in zip(runs, starts, strict=False):
            code[at : at + len(codes)] = np.frombuffer(codes, np.uint8)
            inserts[at + len(codes)] = closes
        row, state = np.repeat(np.arange(total), 4), np.tile(np.arange(4), total)
        here = cost.ravel()
        after = np.append(here, [FAR] * 4)
        kind, fault = code[row] & 3, code[row] & 28
        real, sound = fault != GONE, (fault != GONE) & (fault != BLANK) & (fault != DUPLICATE)
        extra = np.where(fault == SHORT, TRUNCATED, 0)
        kept = KEPT[state, kind]
        arcs = np.full((4 * total, 4), -1, np.int64)

        def arc(column: int, ok: np.ndarray, to: np.ndarray, price: np.ndarray | int) -> None:
            to = np.where(ok, to, 0)
            best = ok & (here < FAR) & (after[to] + price == here)
            arcs[best, column] = to[best]

        arc(0, real, 4 * (row + 1) + state, DELETE)
        arc(1, inserts[row], 4 * row + CHOSEN[state], INSERT)
        arc(2, sound & (kept >= 0), 4 * (row + 1) + kept, KEEP + extra)
        arc(3, sound, 4 * (row + 1) + CHOSEN[state], REROLE + extra)
        # The arcs of a node carry different letters, so the first power chooses among them.
        some = arcs >= 0
        letter = some.argmax(axis=1)
        ends = ~some.any(axis=1)
        self.letter = np.where(ends, -1, letter)
        pointer = np.where(ends, np.arange(4 * total), arcs[np.arange(4 * total), letter])
        rank = self.letter + 1
        self.pointers = [pointer]
        while not ends[pointer].all():
            pair = rank * (int(rank.max()) + 1) + rank[pointer]
            rank = np.unique(pair, return_inverse=True)[1].ravel()
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        self.rank, self.ends = rank, ends

    def paths(self, runs: list[int], states: list[int]) -> list[tuple[str, list[tuple[int, int, int]], int]]:
        """For runs entered in given states: audit, edits as (letter, row or -1, state after), last state."""
        entry = 4 * self.starts[np.array(runs, int)] + np.array(states, int)
        owner, step, node = np.arange(len(runs)), np.zeros(len(runs), np.int64), entry
        for k in range(len(self.pointers) - 1, -1, -1):
            on = self.pointers[k][node]
            go = ~self.ends[on]
            owner, step, node = (
                np.concatenate([owner, owner[go]]), np.concatenate([step, step[go] + (1 << k)]),
                np.concatenate([node, on[go]]),
            )
        order = np.lexsort((step, owner))
        owner, node = owner[order], node[order]
        walks = ~self.ends[node]
        owner, node = owner[walks], node[walks]
        letter, to = self.letter[node], self.pointers[0][node]
        row = np.where(letter == 1, -1, node // 4)
        cut = np.searchsorted(owner, np.arange(len(runs) + 1))
        out = []
        for k, run in enumerate(runs):
            part = slice(cut[k], cut[k + 1])
            rows = np.where(row[part] < 0, -1, row[part] - self.starts[run])
            edits = list(zip(letter[part].tolist(), rows.tolist(), (to[part] & 3).tolist(), strict=True))
            audit = bytes(LETTERS[x] for x, _, _ in edits).decode()
            out.append((audit, edits, int(to[part][-1] & 3) if edits else int(states[k])))
        return out


def repaired(edits: list[tuple[int, int, int]], roles: list[str], texts: list[str]) -> list[dict]:
    """The turns that edits leave."""
    turns = []
    for letter, row, state in edits:
        if letter == 1:
            turns.append({"role": ROLE_NAME[state], "text": ""})
        elif letter:
            turns.append({"role": roles[row] if letter == 2 else ROLE_NAME[state], "text": texts[row]})
    return turns


# ---- rows ----------------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """Rows after damage by crc32(`conv_id:turn`) % 20; dropped rows stay as ``gone``, for their conv_id.

    Columns conv_id, turn, role, text, gone.  A null counts as one space, in the number too.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    number = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        space("role").alias("role"), space("text").alias("text"), number.alias("number"),
    )
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("number") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("number") == 1, "").when(F.col("number") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("number") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("number") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def coded(rows: DataFrame) -> DataFrame:
    """Rows with their code, but for duplicates, and what they are sorted by.

    ``uid`` only deals equal rows over several tasks; which of them comes first makes no difference.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(OTHER)
    fault = F.when(F.col("gone"), GONE).when(last == "", BLANK).when(~last.isin(".", "!", "?"), SHORT).otherwise(0)
    return rows.select(
        "conv_id", "turn", F.col("turn").isNotNull().alias("known"), "role", F.substring("text", 1, 64).alias("head"),
        F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256)).alias("sha"),
        F.monotonically_increasing_id().alias("uid"), "text", (kind + fault).cast("int").alias("code"),
    )


_PIECES = (
    "conv_id bigint, part int, seq int, whole boolean, codes binary, roles array<string>, texts array<string>, "
    "low bigint, high bigint, turns bigint, shas array<binary>"
)
_PIECE_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("codes", pa.binary()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("low", pa.int64()), ("high", pa.int64()),
    ("turns", pa.int64()), ("shas", pa.list_(pa.binary())),
])


def _piece(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows into pieces; a piece is whole if its conversation can lie in no other."""
    part, seq = TaskContext.get().partitionId(), 0
    name, first = object(), True
    codes, roles, texts, turns, shas, size, began = bytearray(), [], [], [], [], 0, True
    met: set[bytes] = set()  # role and text of the conversation's rows so far, in this task
    done: list[dict] = []

    def cut(closes: bool) -> None:
        """``closes``: the conversation ends here, and not with the partition."""
        nonlocal seq, codes, roles, texts, turns, shas, size, began
        whole = closes and began and not first
        known = [t for t in turns if t is not None]
        done.append({
            "conv_id": name, "part": part, "seq": seq, "whole": whole, "codes": bytes(codes), "roles": roles, "texts": texts,
            "low": known[0] if known else None, "high": known[-1] if known else None, "turns": len(set(known)),
            "shas": [] if whole else shas,
        })
        seq += 1
        codes, roles, texts, turns, shas, size, began = bytearray(), [], [], [], [], 0, False

    def told() -> pa.RecordBatch:
        nonlocal done
        out, done = pa.RecordBatch.from_pylist(done, _PIECE_SCHEMA), []
        return out

    started, held = False, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "sha", "code")]
        for conv, turn, role, text, sha, code in zip(*columns, strict=True):
            if started and conv != name:
                cut(True)
                first, began, met = False, True, set()
            name, started = conv, True
            if code < GONE:
                if codes and (len(codes) >= most_rows or size + len(text) > most_bytes):
                    cut(False)
                if code & 28 == BLANK:
                    sha = None
                elif sha in met:
                    code, sha = code & 3 | DUPLICATE, None
                else:
                    met.add(sha)
                codes.append(code)
                roles.append(role)
                texts.append(text)
                turns.append(turn)
                shas.append(sha)
                size += len(text)
                held += len(text) + 64
            if held >= most_bytes or len(done) >= 1024:
                if done:
                    yield told()
                held = size
    if started:
        cut(False)
    if done:
        yield told()


def pieces_of(turns: DataFrame) -> DataFrame:
    """The damaged rows as pieces in order of (part, seq), written to the shared folder."""
    rows = coded(damaged(turns))
    order = ["conv_id", "known", "turn", "role", "head", "sha", "uid"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = partial(_piece, most_rows=PIECE_ROWS, most_bytes=PIECE_BYTES)
    return stored(arrow_map(ordered.select("conv_id", "turn", "role", "text", "sha", "code"), cut, _PIECES))


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes with the duplicates of other pieces, and the cost matrices of the piece: inside, and as the last one."""
    for row in _rows(batches):
        codes = bytearray(row["codes"])
        for at in row["again"] or ():
            codes[at] = codes[at] & 3 | DUPLICATE
        ways = [*passage(bytes(codes), False), *passage(bytes(codes), True)]
        yield pa.RecordBatch.from_pylist(
            [{"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "codes": bytes(codes), "ways": ways,
              "n": len(codes), "last": codes[-1] if codes else None,
              **{c: row[c] for c in ("low", "high", "turns")}}], _WEIGHED_SCHEMA,
        )


_WEIGHED = (
    "conv_id bigint, part int, seq int, codes binary, ways array<bigint>, n int, last int, low bigint, high bigint, turns bigint"
)
_WEIGHED_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("codes", pa.binary()), ("ways", pa.list_(pa.int64())),
    ("n", pa.int32()), ("last", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
])


def weighed(cut: DataFrame) -> DataFrame:
    """Pieces of conversations that span several: final codes and cost matrices, without texts.

    Within a task repeats are known already, so a text comes up once a task here.
    """
    place = F.struct("part", "seq", "pos")
    met = cut.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none"), "part", "seq",
        F.posexplode("shas").alias("pos", "sha"),
    ).where("sha is not null")
    first = met.groupBy("conv", "none", "sha").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = met.join(first, ["conv", "none", "sha"]).where(place != F.col("first")).groupBy("part", "seq").agg(
        F.collect_list("pos").alias("again")  # PIECE_ROWS at most
    )
    rows = cut.select("conv_id", "part", "seq", "codes", "low", "high", "turns").join(again, ["part", "seq"], "left")
    return stored(arrow_map(rows, _weigh, _WEIGHED))


# ---- pieces --------------------------------------------------------------------------------------------

_EDITED = (
    "conv_id bigint, part int, seq int, audit string, turns array<struct<role: string, text: string>>, cost bigint, "
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
)
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_EDITED_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("turns", pa.list_(_TURN)),
    *[(c, pa.int64()) for c in ("cost", "gaps", "blank", "duplicate", "truncated", "illegal")],
])
_LEGAL = {(1, 2), (2, 3), (3, 2)}


def _counts(codes: bytes, before: int | None = None) -> dict:
    """Faults of some rows, and neighbours that are not legal; ``before``: class of the row before them."""
    kinds = [c & 3 for c in codes] if before is None else [before, *[c & 3 for c in codes]]
    faults = [c & 28 for c in codes]
    return {
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(SHORT),
        "illegal": sum(pair not in _LEGAL for pair in zip(kinds, kinds[1:], strict=False)),
    }


def _edited(pieces: list[dict]) -> pa.RecordBatch:
    """Repair pieces whose costs at the end and entry are known."""
    ranked = Ranked([(p["codes"], tuple(p["end"]), p["closes"]) for p in pieces])
    out = []
    for p, (audit, edits, _) in zip(pieces, ranked.paths(list(range(len(pieces))), [p["entry"] for p in pieces]), strict=True):
        out.append({
            "conv_id": p["conv_id"], "part": p["part"], "seq": p["seq"], "audit": audit,
            "turns": repaired(edits, p["roles"], p["texts"]), **p["told"],
        })
    return pa.RecordBatch.from_pylist(out, _EDITED_SCHEMA)


def _grouped(rows: Iterator[dict], edit: Callable[[dict], dict], together: int) -> Iterator[pa.RecordBatch]:
    """Pieces in lots of about so many rows."""
    lot, size = [], 0
    for row in rows:
        lot.append(edit(row))
        size += len(row["codes"]) + 1
        if size >= together:
            yield _edited(lot)
            lot, size = [], 0
    if lot:
        yield _edited(lot)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _repair_whole(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    def edit(p: dict) -> dict:
        gaps = min(p["high"] - p["low"] + 1 - p["turns"], MOST) if p["turns"] else 0
        told = {"cost": int(costs(p["codes"], END, True)[0][NOTHING]), "gaps": gaps, **_counts(p["codes"])}
        return p | {"end": END, "closes": True, "entry": NOTHING, "told": told}

    yield from _grouped(_rows(batches), edit, together)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for row in _rows(batches):
        if held and row["conv_id"] != held[0]["conv_id"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


_ENDS = (
    "part int, seq int, end array<bigint>, closes boolean, before int, cost bigint, gaps bigint"
)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From one small row a piece: costs at the end of each piece, and what concerns the conversation."""
    for held in _by_conversation(batches):
        full = [p for p in held if p["n"]]
        out, end, closes = [], np.array(END, dtype=np.int64), True
        for p in reversed(full):
            out.append({"part": p["part"], "seq": p["seq"], "end": end.tolist(), "closes": closes})
            ways = np.array(p["ways"], np.int64).reshape(2, 4, 4)[int(closes)]
            end, closes = np.minimum((ways + end[None, :]).min(axis=1), FAR), False
        out.reverse()
        low = min((p["low"] for p in full if p["turns"]), default=0)
        high = max((p["high"] for p in full if p["turns"]), default=-1)
        known = [p for p in full if p["turns"]]
        turns = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
        for k, row in enumerate(out):
            row["before"] = full[k - 1]["last"] & 3 if k else None
            row["cost"], row["gaps"] = (int(end[NOTHING]), min(high - low + 1 - turns, MOST)) if not k else (0, 0)
        if not full:  # all rows dropped: one empty piece stands for the conversation
            p = held[0]
            out = [{"part": p["part"], "seq": p["seq"], "end": list(END), "closes": True, "before": None, "cost": 0, "gaps": 0}]
        yield pa.RecordBatch.from_pylist(out, pa.schema([
            ("part", pa.int32()), ("seq", pa.int32()), ("end", pa.list_(pa.int64())), ("closes", pa.bool_()),
            ("before", pa.int32()), ("cost", pa.int64()), ("gaps", pa.int64()),
        ]))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the least cheapest path leaves a piece, for each state it may enter in."""
    for row in _rows(batches):
        ranked = Ranked([(row["codes"], tuple(row["end"]), row["closes"])])
        first = costs(row["codes"], tuple(row["end"]), row["closes"])[0]
        exits = [ranked.paths([0], [s])[0][2] if first[s] < FAR else s for s in range(4)]
        yield pa.RecordBatch.from_pylist(
            [{"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "exits": exits}],
            pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("exits", pa.list_(pa.int32()))]),
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for held in _by_conversation(batches):
        state, out = NOTHING, []
        for p in held:
            out.append({"part": p["part"], "seq": p["seq"], "entry": state})
            state = p["exits"][state]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("entry", pa.int32())]))


def _repair_pieces(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    def edit(p: dict) -> dict:
        return p | {"told": {"cost": p["cost"], "gaps": p["gaps"], **_counts(p["codes"], p["before"])}}

    yield from _grouped(_rows(batches), edit, together)


def _in_order(df: DataFrame) -> DataFrame:
    """All pieces of a conversation in one task, in order."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def _repaired(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of one piece, and the pieces of the others."""
    pieces = pieces_of(turns)
    texts = ["conv_id", "part", "seq", "roles", "texts"]
    whole = arrow_map(pieces.where("whole").select(*texts, "codes", "low", "high", "turns"), partial(_repair_whole, together=TOGETHER), _EDITED)
    cut = pieces.where(~F.col("whole"))
    small = weighed(cut)
    ends = stored(arrow_map(_in_order(small.drop("codes")), _ends, _ENDS))
    known = small.select("conv_id", "part", "seq", "codes").join(ends, ["part", "seq"])
    exits = arrow_map(known, _ways, "conv_id bigint, part int, seq int, exits array<int>")
    entries = arrow_map(_in_order(exits), _entries, "part int, seq int, entry int")
    rest = cut.select(*texts).join(known.drop("conv_id").join(entries, ["part", "seq"]), ["part", "seq"])
    return whole, arrow_map(rest, partial(_repair_pieces, together=TOGETHER), _EDITED)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Damage ``turns`` (conv_id, turn, role, text), find their faults and repair them.

    Returns the pieces of the repaired conversations, in order of (part, seq): conv_id, audit,
    ``turns`` (array of role, text), and counts to be summed over a conversation: cost, gaps, blank,
    duplicate, truncated, illegal.  Nulls in role and text, and in the number that damage is chosen by, are
    one space; a null turn comes first and counts for no gap; rows without conv_id form one conversation.
    Rows of one turn are ordered by role, the first 64 characters of the text, then a digest; a
    repeated row stays and is a duplicate.  Every conv_id has a piece, also with all rows dropped.  An empty
    table gives no rows.  Other columns are ignored.
    """
    whole, rest = _repaired(turns)
    return whole.unionByName(rest)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row a conversation; its text is hashed as it streams past."""
    name, started, sha, audits, sums, any_turn, out = None, False, None, [], None, False, []

    def close() -> None:
        out.append({"conv_id": name, **dict(zip(_COUNTS, sums, strict=True)), "audit": "".join(audits), "repaired_sha256": sha.hexdigest()})

    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for row in _rows(batches):
        if not started or row["conv_id"] != name:
            if started:
                close()
            name, started, sha, audits, sums, any_turn = row["conv_id"], True, hashlib.sha256(), [], [0] * len(_COUNTS), False
        audits.append(row["audit"])
        sums = [a + row[c] for a, c in zip(sums, _COUNTS, strict=True)]
        for turn in row["turns"]:
            sha.update(("\n" if any_turn else "").encode() + f"{turn['role']}:{turn['text']}".encode())
            any_turn = True
        if len(out) >= 1024:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if started:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def digest_repairs(turns: DataFrame) -> DataFrame:
    """One row per conv_id: its counts, audit and the sha256 of its repaired turns (`role:text`, one a line).

    A conversation's digest needs its turns in one task, one after the other; they are hashed as they
    come, not collected.
    """
    whole, rest = _repaired(turns)
    return arrow_map(whole, _digest, _DIGESTS).unionByName(arrow_map(_in_order(rest), _digest, _DIGESTS))


_DIGESTS = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
