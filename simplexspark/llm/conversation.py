"""Repair of conversation structure by lightest derivations.

Turns are kept, given another role, deleted or inserted so that the roles read ``(s?(ua)+)?``. A repair is a derivation: an item
(turns covered, state before, state after) follows from a shorter item and one edit, and an item of two adjacent pieces
follows from an item of each, a hyperedge with two antecedents. Every deduction adds the costs of its antecedents and appends
their edits, so its weight (cost, turns covered, audit) is larger than that of each antecedent: only keeping a turn
may cost nothing, and it covers one turn more. Of two items over the same turns with equal costs neither audit begins the
other, since both hold the same number of inserted turns, so what is appended never turns their order around. The
weights are thus superior functions, and Knuth's agenda, which pops the lightest item first, finalises each item at its
best audit.

Rows are sorted by conversation and turn over all tasks. A conversation that lies inside one task and is not long is repaired
where it is read. The first and the last one of a task, and long ones, are cut into pieces of at most ``PIECE_ROWS`` turns or
``PIECE_CHARS`` characters; a piece derives its items for every state before and after it, pieces are combined in a
tree of ``FAN``, and the edits of the whole are dealt back to the pieces. No task holds a conversation. Turns that repeat
across pieces are found by their first place, one row a distinct turn, so a turn that is repeated without end is no hot key.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from simplexspark.sources.stages import cut

PIECE_ROWS, PIECE_CHARS, FAN = 512, 4 << 20, 64
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user, after an assistant. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The one state that an inserted turn, or one with a new role, can lead to.
NEXT = (USER, USER, ASSISTANT, USER)
ENDS = (START, ASSISTANT)
FOLLOWS = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, CUT_OFF = "-bdt"

Item = tuple[int, int, int]  # state before, turns or pieces covered, state after
TURNS = "array<struct<edit:string,role:string,text:string>>"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
TURNS_TYPE = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def lightest(axioms: Iterable[Item], deduce: Callable[[Item], Iterable[tuple[Item, int, str]]], ends: Callable[[Item], bool]) -> dict[Item, tuple[int, str]]:
    """Knuth's agenda: items with their lightest (cost, audit), until one that ``ends`` is final. ``deduce`` gives what follows
    from an item together with antecedents that are final, with the cost and the edits they add."""
    agenda = [(0, item[1], "", item) for item in axioms]
    final: dict[Item, tuple[int, str]] = {}
    while agenda:
        cost, _, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = cost, audit
        if ends(item):
            break
        for reached, more, edits in deduce(item):
            if reached not in final:
                heapq.heappush(agenda, (cost + more, reached[1], audit + edits, reached))
    return final


def edits_of(faults: str, initials: list[str]) -> Callable[[Item], Iterator[tuple[Item, int, str]]]:
    """Deductions by one edit: of the next turn, or an inserted one."""
    def deduce(item: Item) -> Iterator[tuple[Item, int, str]]:
        before, i, state = item
        yield (before, i, NEXT[state]), INSERT, "I"
        if i < len(faults):
            yield (before, i + 1, state), DELETE, "D"
            if faults[i] in (FINE, CUT_OFF):
                more = TRUNCATED if faults[i] == CUT_OFF else 0
                if (state, initials[i]) in STEP:
                    yield (before, i + 1, STEP[state, initials[i]]), KEEP + more, "K"
                yield (before, i + 1, NEXT[state]), REROLE + more, "R"
    return deduce


def repair(faults: str, initials: list[str]) -> tuple[int, str]:
    """Cost and audit of the best repair of a whole conversation."""
    n = len(faults)
    final = lightest([(START, 0, START)], edits_of(faults, initials), lambda item: item[1] == n and item[2] in ENDS)
    return next(reversed(final.values()))


def piece_items(faults: str, initials: list[str]) -> dict[tuple[int, int], tuple[int, str]]:
    """Lightest (cost, audit) of a piece by state before and after."""
    n = len(faults)
    final = lightest([(p, 0, p) for p in range(4)], edits_of(faults, initials), lambda item: False)
    return {(p, q): weight for (p, i, q), weight in final.items() if i == n}


def joined_items(pieces: list[dict[tuple[int, int], tuple[int, str]]]) -> dict[tuple[int, int], tuple[int, str]]:
    """The same of adjacent pieces: an item of the first ones and one of the next, which begins in the state the former ends in."""
    def deduce(item: Item) -> Iterator[tuple[Item, int, str]]:
        before, k, state = item
        if k < len(pieces):
            for after in range(4):
                if (state, after) in pieces[k]:
                    yield (before, k + 1, after), *pieces[k][state, after]
    final = lightest([(p, 0, p) for p in range(4)], deduce, lambda item: False)
    return {(p, q): weight for (p, k, q), weight in final.items() if k == len(pieces)}


def faults_of(rows: list[tuple], first: set[int] | None = None) -> str:
    """First fault of each turn (number, role, text). ``first`` has the places of turns that no earlier one repeats; without it
    the rows are the whole conversation."""
    out, seen = [], set()
    for i, (_, role, text) in enumerate(rows):
        body = text.rstrip(SPACE)
        if not body:
            out.append(BLANK)
        elif (i not in first) if first is not None else (role, text) in seen:
            out.append(DUPLICATE)
        else:
            out.append(FINE if body[-1] in ".!?" else CUT_OFF)
        if first is None:
            seen.add((role, text))
    return "".join(out)


def measured(rows: list[tuple], faults: str) -> dict:
    """What a piece adds to the report, and what its neighbours must know."""
    turns = [t for t, _, _ in rows if t is not None]
    initials = [role[:1] for _, role, _ in rows]
    return {"n": len(rows), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT_OFF),
            "illegal": sum(a + b not in FOLLOWS for a, b in zip(initials, initials[1:])), "head": initials[0], "tail": initials[-1],
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "distinct": len(set(turns))}


def both(a: dict, b: dict) -> dict:
    """The measures of two adjacent pieces."""
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "distinct")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["tail"] + b["head"] not in FOLLOWS)
    out["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"head": a["head"], "tail": b["tail"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def report(m: dict, cost: int, audit: str) -> dict:
    gaps = 0 if m["low"] is None else m["high"] - m["low"] + 1 - m["distinct"]
    return {"gaps": min(gaps, 2**63 - 1), **{k: m[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}


def applied(rows: list[tuple], edits: str, done: int, odd: bool) -> list[dict]:
    """The turns that the edits leave, with those deleted. ``done`` turns stand before; a conversation with an odd number of turns
    begins with a system turn, so the place of a turn settles its role."""
    out, at = [], 0
    for edit in edits:
        role = "user" if (done - odd) % 2 == 0 else "assistant"
        if edit == "I":
            out.append({"edit": edit, "role": role, "text": ""})
        else:
            _, own, text = rows[at]
            at += 1
            out.append({"edit": edit, "role": role if edit == "R" else own, "text": text})
        done += edit != "D"
    return out


def left_turns(audit: str) -> int:
    return len(audit) - audit.count("D")


MEASURES = "n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, distinct long"
MEASURE_NAMES = [m.split(" ")[0] for m in MEASURES.split(", ")]
ITEMS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def sorted_out(conv_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function over the sorted rows of a task: repaired conversations, and the rows of those that may go on elsewhere."""
    schema = pa.schema([("conv", conv_type), ("piece", pa.int64()), ("i", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                        ("turns", TURNS_TYPE), *[(k, pa.int64()) for k in NUMBERS], ("audit", pa.string())])

    def sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        rows: list[tuple] = []
        base, pieces, chars, now, open_ = TaskContext.get().partitionId() << 32, 0, 0, None, True

        def to_piece() -> None:
            nonlocal pieces
            out.extend({"conv": now, "piece": base + pieces, "i": i, "turn": t, "role": r, "text": x} for i, (t, r, x) in enumerate(rows))
            pieces += bool(rows)
            rows.clear()

        def whole() -> None:
            faults = faults_of(rows)
            cost, audit = repair(faults, [role[:1] for _, role, _ in rows])
            turns = applied(rows, audit, 0, bool(left_turns(audit) % 2))
            out.append({"conv": now, "turns": turns, **report(measured(rows, faults), cost, audit)})
            rows.clear()

        begun = False
        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and conv != now:
                    to_piece() if open_ else whole()
                    open_, chars = False, 0
                elif len(rows) >= PIECE_ROWS or chars >= PIECE_CHARS:
                    to_piece()
                    open_, chars = True, 0
                begun, now = True, conv
                rows.append((turn, role, text))
                chars += len(text)
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
        to_piece()  # the last one may go on in the next task
        yield pa.RecordBatch.from_pylist(out, schema)

    return sort_out


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Pieces of the repaired conversations: conv_id, piece, turns (edit, role, text in order, those with edit D are deleted) and on
    the first piece of each conversation its report: gaps, blank, duplicate, truncated, illegal, cost, audit.

    Most conversations are one piece, 0. Null roles and texts count as one space; rows with a null id are one conversation.
    Turns are ordered by number (nulls first), then by role, beginning and hash of the text; equal rows stand side by side
    and the later ones are duplicates. gaps is bounded by the largest long. Other columns are not read; an empty table gives none.
    """
    spark = rows.sparkSession
    conv, text = F.col(f"`{conv_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" "))
    plain = rows.select(conv.alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), text.alias("text"))
    # The range key must be short, and equal rows without end must not be one range.
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("role", "text"), F.monotonically_increasing_id()]
    keyed = plain.withColumns({f"k{i}": c for i, c in enumerate(order[2:])})
    order = [*order[:2], *[F.col(f"k{i}") for i in range(4)]]
    kind = rows.select(conv.alias("conv")).schema[0].dataType.simpleString()
    arrow = to_arrow_type(rows.select(conv).schema[0].dataType)
    spread = keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    schema = f"conv {kind}, piece long, i int, turn long, role string, text string, turns {TURNS}, {REPORT}"
    sorted_ = cut(spread.select("conv", "turn", "role", "text").mapInArrow(sorted_out(arrow), schema), "conversations")
    whole = sorted_.where("piece is null").select("conv", F.lit(0).alias("piece"), "turns", *NUMBERS, "audit")
    parts = open_pieces(sorted_.where("piece is not null").select("conv", "piece", "i", "turn", "role", "text"), kind, arrow)
    return whole.unionByName(parts).withColumnRenamed("conv", "conv_id")


def open_pieces(rows: DataFrame, kind: str, arrow: pa.DataType) -> DataFrame:
    """Repaired pieces of conversations that are spread over several, from rows (conv, piece, i, turn, role, text)."""
    said = F.trim(F.col("text"), F.lit(SPACE)) != ""
    first = rows.where(said).groupBy("conv", "role", F.sha2("text", 256)).agg(F.min(F.struct("piece", "i")).alias("at")).select("at.*")
    types = {**dict.fromkeys(MEASURE_NAMES, pa.int64()), "head": pa.string(), "tail": pa.string()}
    schema = pa.schema([("conv", arrow), ("piece", pa.int64()), *types.items(), ("pieces", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("items", ITEMS)])
    spec = f"conv {kind}, piece long, {MEASURES}, pieces array<long>, sizes array<long>, items array<struct<p:int,q:int,cost:long,audit:string>>"

    def in_order(table: pa.Table) -> list[tuple]:
        table = table.sort_by("i")
        return list(zip(*(table[c].to_pylist() for c in ("turn", "role", "text"))))

    def as_row(conv, piece: int, m: dict, pieces: list[int], sizes: list[int], items: dict) -> pa.Table:
        listed = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in items.items()]
        return pa.Table.from_pylist([{"conv": conv, "piece": piece, **m, "pieces": pieces, "sizes": sizes, "items": listed}], schema)

    def derive(mine: pa.Table, firsts: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return pa.Table.from_pylist([], schema)
        turns = in_order(mine)
        faults = faults_of(turns, set(firsts["i"].to_pylist()))
        piece = mine["piece"][0].as_py()
        return as_row(mine["conv"][0].as_py(), piece, measured(turns, faults), [piece], [len(turns)], piece_items(faults, [r[:1] for _, r, _ in turns]))

    def combine(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["piece"])
        m = {k: parts[0][k] for k in MEASURE_NAMES}
        for p in parts[1:]:
            m = both(m, p)
        items = joined_items([{(x["p"], x["q"]): (x["cost"], x["audit"]) for x in p["items"]} for p in parts])
        return as_row(parts[0]["conv"], parts[0]["piece"], m, [i for p in parts for i in p["pieces"]], [n for p in parts for n in p["sizes"]], items)

    table = cut(rows.groupBy("piece").cogroup(first.groupBy("piece")).applyInArrow(derive, spec), "conversation-pieces")
    for shift in (6, 32, 38, 44, 50):
        most = table.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
        if most <= FAN:
            break
        table = cut(table.groupBy("conv", F.shiftright("piece", shift).alias("above")).applyInArrow(combine, spec), "conversation-pieces")
    table = table.groupBy("conv").applyInArrow(combine, spec)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edits of each piece; the report goes to the first one."""
        names = ["conv", "source", "piece", "edits", "done", "odd", *NUMBERS, "audit"]
        kinds = [arrow, pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * len(NUMBERS), pa.string()]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cost, audit = min((x["cost"], x["audit"]) for x in row["items"] if x["p"] == START and x["q"] in ENDS)
                whole, at, done = report(row, cost, audit), 0, 0
                for k, (source, n) in enumerate(zip(row["pieces"], row["sizes"])):
                    end = at
                    while n:
                        n -= audit[end] != "I"
                        end += 1
                    end = len(audit) if k == len(row["pieces"]) - 1 else end
                    out.append({"conv": row["conv"], "source": source, "piece": k, "edits": audit[at:end], "done": done, "odd": bool(left_turns(audit) % 2), **(whole if not k else {})})
                    done += left_turns(audit[at:end])
                    at = end
            yield pa.RecordBatch.from_pylist(out, pa.schema(list(zip(names, kinds))))

    def write(mine: pa.Table, plan: pa.Table) -> pa.Table:
        out = [{"conv": p["conv"], "piece": p["piece"], "turns": applied(in_order(mine), p["edits"], p["done"], p["odd"]), **{k: p[k] for k in (*NUMBERS, "audit")}} for p in plan.to_pylist()]
        return pa.Table.from_pylist(out, pa.schema([("conv", arrow), ("piece", pa.int32()), ("turns", TURNS_TYPE), *[(k, pa.int64()) for k in NUMBERS], ("audit", pa.string())]))

    plan = cut(table.mapInArrow(settle, f"conv {kind}, source long, piece int, edits string, done long, odd boolean, {REPORT}"), "conversation-edits")
    return rows.groupBy("piece").cogroup(plan.groupBy("source")).applyInArrow(write, f"conv {kind}, piece int, turns {TURNS}, {REPORT}")
