"""Repair of conversation structure: weighted CYK parsing over spans of rows.

A repaired conversation reads ``(s?(ua)+)?`` by the first letters of its roles. Rows are kept (cost 0),
re-roled (1) or deleted (2), empty ones inserted (5); a truncated row that stays costs ``TRUNCATED`` more; blank and
duplicate rows must go. Of the cheapest repairs the one with the ASCII-least string of edit initials counts.

The repair grammar is in Chomsky normal form. Its nonterminals ``[p, q]`` derive the rows of a span between two
states of the pattern (start, after s, after u, after a); rules are ``[p, q] -> [p, r] [r, q]`` for every state
between, terminals are the edits of one row, and both are closed under insertion, so that a cell already has
all inserted rows at its ends. A cell of the chart is the minimum (cost, audit) of a nonterminal over a span, and cells are
combined bottom-up by span length over all splits. Audits of one span and cost are never prefixes of each
other (a longer one has more insertions), so minima of parts give the minimum of the whole.

A chart spans at most ``BLOCK`` rows: its (cost, audit, length) is one 64-bit number, and many sequences go through
numpy together. Longer conversations are blocks, whose top cells are the leaves of a chart over blocks, and so on.

Skew: conversations of more than ``LONG`` rows are not given to one task. Their rows are numbered over ranges of the
order, duplicates found by an aggregate, blocks parsed and combined level by level as Spark groups of at most ``BLOCK``
rows. Only the text digest of a conversation, sequential by definition, streams through one task, with
the audit as its only state.

Defined cases: a NULL role or text is one space; an empty role has no initial and can only be re-roled or deleted. NULL turns come
first; equal turns are ordered by role, then text. NULL conversation ids are one conversation. ``present=False`` marks
rows that only say that their conversation exists; without other rows it has zeros, an empty audit and the hash of
the empty string. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, functions as F

from slicelake.llm.common import SPACES, column, hash128, ready, stored
from slicelake.operators.skew import numbered

BLOCK = 16          # rows of a chart
LONG = 20_000       # rows of a conversation that one task handles
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LETTERS = "DIKR"    # in ASCII order, two bits each

# states: 0 start, 1 after s, 2 after u, 3 after a; a repair ends in 0 (nothing) or 3
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
CELLS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
RULES = [[(CELLS.index((p, r)), CELLS.index((r, q))) for r in range(4) if (p, r) in CELLS and (r, q) in CELLS] for p, q in CELLS]
LEFT = np.array([a for rules in RULES for a, _ in rules])
RIGHT = np.array([b for rules in RULES for _, b in rules])
FIRSTS = np.cumsum([0] + [len(rules) for rules in RULES[:-1]])
ENDS = [CELLS.index((0, 0)), CELLS.index((0, 3))]

Cell = tuple[int, str] | None     # cost and audit; None where nothing can be derived


def _least(cells) -> Cell:
    return min((c for c in cells if c), default=None)


def _join(a: list[Cell], b: list[Cell]) -> list[Cell]:
    """One split of a span: the minimum over the rules of every nonterminal."""
    return [
        _least((a[x][0] + b[y][0], a[x][1] + b[y][1]) for x, y in rules if a[x] and b[y]) for rules in RULES
    ]


def _cells(steps: list[tuple[tuple[int, int], int, str]]) -> list[Cell]:
    return [_least((cost, letter) for pair, cost, letter in steps if pair == cell) for cell in CELLS]


# any number of insertions is at most two: more end where fewer do
_ONE = _cells([((p, p), 0, "") for p in range(4)] + [((p, q), INSERT, "I") for (x, p), q in STEPS.items() if x in "ua"])
INSERTED = _join(_ONE, _ONE)


def _leaf(initial: str, must_go: bool, truncated: bool) -> list[Cell]:
    """The cells of one row: its edits between insertions."""
    edits = [((p, p), DELETE, "D") for p in range(4)]
    if not must_go:
        more = TRUNCATED if truncated else 0
        edits += [((p, q), REROLE + more, "R") for (x, p), q in STEPS.items() if x in "ua"]
        edits += [((p, q), KEEP + more, "K") for (x, p), q in STEPS.items() if x == initial]
    return _join(_join(INSERTED, _cells(edits)), INSERTED)


# kinds of rows: 0 must go; 1 + 2 * (place of the initial in "sua", 3 for others) + truncated; PAD is no row at all
KINDS = [_leaf("", True, False)] + [_leaf(x, False, t) for x in "sua-" for t in (False, True)]
PAD = len(KINDS)


def kind_of(initial: str, must_go: bool, truncated: bool) -> int:
    if must_go:
        return 0
    return 1 + 2 * ("sua".index(initial) if initial and initial in "sua" else 3) + truncated


# a packed cell: cost in 7 bits, then 26 letters of 2 bits, then the length in 5 bits; comparing numbers compares
# (cost, audit). Over BLOCK rows the cheapest repair costs at most 2 * BLOCK + 10, so an audit has at most 24 letters.
CODE_BITS, LENGTH_BITS = 52, 5
BAD = np.uint64(127 << (CODE_BITS + LENGTH_BITS))


def _pack(cell: Cell) -> int:
    if cell is None:
        return int(BAD)
    cost, audit = cell
    code = 0
    for i, letter in enumerate(audit):
        code |= LETTERS.index(letter) << (CODE_BITS - 2 * (i + 1))
    return cost << (CODE_BITS + LENGTH_BITS) | code << LENGTH_BITS | len(audit)


def _unpack(packed: int) -> Cell:
    cost, length = packed >> (CODE_BITS + LENGTH_BITS), packed & 31
    if cost == 127:
        return None
    code = packed >> LENGTH_BITS
    return cost, "".join(LETTERS[code >> (CODE_BITS - 2 * (i + 1)) & 3] for i in range(length))


LEAVES = np.array([[_pack(cell) for cell in cells] for cells in [*KINDS, INSERTED]], np.uint64)


def _combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Packed cells of neighbouring spans to those of their union, for arrays of spans."""
    a, b = left[..., LEFT], right[..., RIGHT]
    above, mask = np.uint64(CODE_BITS + LENGTH_BITS), np.uint64((1 << CODE_BITS) - 1)
    length = a & np.uint64(31)
    cost = (a >> above) + (b >> above)
    code = (a >> np.uint64(LENGTH_BITS) & mask) | ((b >> np.uint64(LENGTH_BITS) & mask) >> (length << np.uint64(1)))
    both = cost << above | code << np.uint64(LENGTH_BITS) | (length + (b & np.uint64(31)) & np.uint64(31))
    return np.minimum.reduceat(np.where(cost >= 127, BAD, both), FIRSTS, axis=-1)


def chart(kinds: np.ndarray) -> np.ndarray:
    """Top cells of many sequences of equal length: a matrix of kinds to a matrix of packed cells."""
    n = kinds.shape[1]
    spans = {1: LEAVES[kinds]}
    for length in range(2, n + 1):
        places, best = n - length + 1, None
        for cut in range(1, length):
            found = _combine(spans[cut][:, :places], spans[length - cut][:, cut : cut + places])
            best = found if best is None else np.minimum(best, found)
        spans[length] = best
    return spans[n][:, 0]


def parse_blocks(blocks: list[bytes]) -> dict[bytes, list[Cell]]:
    """The top cells of every distinct block of at most ``BLOCK`` kinds; shorter ones are padded with insertions."""
    out = {}
    by_width: dict[int, list[bytes]] = {}
    for block in dict.fromkeys(blocks):
        by_width.setdefault(next(w for w in (1, 2, 4, 8, BLOCK) if len(block) <= w), []).append(block)
    for width, some in by_width.items():
        for part in range(0, len(some), 2048):
            rows = some[part : part + 2048]
            padded = np.frombuffer(b"".join(b.ljust(width, bytes([PAD])) for b in rows), np.uint8).reshape(-1, width)
            for block, cells in zip(rows, chart(padded).tolist()):
                out[block] = [_unpack(c) for c in cells]
    return out


def parse_cells(leaves: list[list[Cell]]) -> list[Cell]:
    """The chart over leaves that are themselves cells of blocks, all splits of every span."""
    spans = {(i, 1): leaf for i, leaf in enumerate(leaves)}
    for length in range(2, len(leaves) + 1):
        for i in range(len(leaves) - length + 1):
            found = [_join(spans[i, cut], spans[i + cut, length - cut]) for cut in range(1, length)]
            spans[i, length] = [_least(cells) for cells in zip(*found)]
    return spans[0, len(leaves)]


def parse(kinds: bytes, known: dict[bytes, list[Cell]]) -> tuple[int, str]:
    """Cost and audit of a whole conversation, with the cells of its blocks in ``known``."""
    level = [known[kinds[i : i + BLOCK]] for i in range(0, len(kinds), BLOCK)]
    while len(level) > 1:
        level = [parse_cells(level[i : i + BLOCK]) for i in range(0, len(level), BLOCK)]
    return _least(level[0][i] for i in ENDS) if level else (0, "")


class Repair:
    """The repaired rows of one conversation, in order, as its rows come."""

    NAMES = {"s": "system", "u": "user", "a": "assistant"}

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _next(self) -> str:
        letter = "u" if ("u", self.state) in STEPS else "a"
        self.state = STEPS[letter, self.state]
        return self.NAMES[letter]

    def inserted(self):
        """Insertions that come before the next row."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[role[0], self.state]
            yield "K", role, text
        elif edit == "R":
            yield "R", self._next(), text


def digest_of(rows) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in rows).encode()).hexdigest()


def _staged(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    base = rows.select(
        column(conv).alias("conv"),
        column(turn).cast("bigint").alias("turn"),
        F.coalesce(column(role), F.lit(" ")).alias("role"),
        F.coalesce(column(text), F.lit(" ")).alias("text"),
        (F.coalesce(column(present), F.lit(True)) if present else F.lit(True)).alias("present"),
    )
    bare = F.trim("text", F.lit(SPACES))
    return base.withColumns(
        {"blank": F.length(bare) == 0, "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?")}
    )


FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LEGAL = ("su", "ua", "au")


def _measure(rows: list[tuple]) -> tuple[list[int], bytes]:
    """The counts of faults and the kinds of a conversation's rows, given in order."""
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, kinds, blanks, copies, cuts = set(), bytearray(), 0, 0, 0
    for _, _, role, text, _, blank, cut in rows:
        copy = not blank and (role, text) in seen
        seen.add((role, text))
        blanks, copies, cuts = blanks + blank, copies + copy, cuts + (cut and not blank and not copy)
        kinds.append(kind_of(role[:1], blank or copy, cut))
    illegal = sum(a[2][:1] + b[2][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return [gaps, blanks, copies, cuts, illegal], bytes(kinds)


def _conversations(batches):
    """(id, rows) of whole conversations from batches sorted by conversation, in lists of a batch's worth."""
    rest: list[tuple] = []
    for batch in batches:
        rows = rest + list(zip(*(c.to_pylist() for c in batch.columns)))
        last, cut = rows[-1][0] if rows else None, len(rows)
        while cut and rows[cut - 1][0] == last:
            cut -= 1
        rest = rows[cut:]
        yield [(k, [r for r in some if r[4]]) for k, some in groupby(rows[:cut], lambda r: r[0])]
    yield [(k, [r for r in some if r[4]]) for k, some in groupby(rest, lambda r: r[0])]


def _repairs(batches):
    """(id, rows, faults, cost, audit) of every conversation."""
    for some in _conversations(batches):
        measured = [_measure(rows) for _, rows in some]
        known = parse_blocks([k[i : i + BLOCK] for _, k in measured for i in range(0, len(k), BLOCK)])
        yield [(conv, rows, faults, *parse(kinds, known)) for (conv, rows), (faults, kinds) in zip(some, measured)]


def _edited(rows: list[tuple], audit: str) -> list[tuple[str, str, str]]:
    repair = Repair(audit)
    return [x for r in rows for x in repair.row(r[2], r[3])] + list(repair.inserted())


def _gathered(staged: DataFrame) -> DataFrame:
    parts = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged.repartition(parts, "conv").sortWithinPartitions("conv", "turn", "role", "text")


def _split(staged: DataFrame, long: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary conversations, and of those with more than ``long`` rows if there are any."""
    many = staged.groupBy(F.col("conv").alias("many")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long).select("many")
    if many.isEmpty():
        return staged, None
    many = stored(many, "long-conversations")
    same = F.col("conv").eqNullSafe(F.col("many"))
    return staged.join(many, same, "left_anti"), staged.join(many, same, "left_semi")


def _summaries(staged: DataFrame) -> DataFrame:
    """Every conversation in one task's stream."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = staged.schema["conv"].dataType
    key = to_arrow_type(kind)

    def run(batches):
        for some in _repairs(batches):
            if some:
                convs, rows, faults, costs, audits = zip(*some)
                digests = [digest_of(_edited(r, audit)) for r, audit in zip(rows, audits)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(convs, key), *[pa.array(f, pa.int64()) for f in zip(*faults)],
                        pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(digests, pa.string()),
                    ],
                    names=["conv", *FAULTS, "cost", "audit", "repaired_sha256"],
                )

    return _gathered(staged).mapInArrow(run, f"conv {kind.simpleString()}, {SUMMARY}")


def _parse_long(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv`` with counts of faults, and ``conv`` with cost and audit, of numbered rows; no task sees a whole conversation."""
    key = hash128("role", "text")
    keyed = placed.withColumn("key", F.when(~F.col("blank"), key))
    firsts = (
        keyed.where("present AND NOT blank").groupBy(F.col("conv").alias("c"), F.col("key").alias("k"))
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))
    thin = stored(
        keyed.where("present").join(firsts, same, "left")
        .withColumn("copy", F.coalesce(F.col("at") > F.col("first"), F.lit(False)))
        .select("conv", "at", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "copy",
                (F.col("cut") & ~F.col("blank") & ~F.col("copy")).alias("cut")),
        "conversation-kinds",
    )
    pairs = thin.select(F.col("conv").alias("c"), (F.col("at") + 1).alias("after"), F.col("initial").alias("before"))
    beside = thin.join(pairs, (F.col("at") == F.col("after")) & F.col("conv").eqNullSafe(F.col("c")))
    illegal = beside.groupBy("conv").agg(F.count_if(~F.concat("before", "initial").isin(*LEGAL)).alias("illegal"))
    faults = thin.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.count_if("blank").alias("blank"), F.count_if("copy").alias("duplicate"), F.count_if("cut").alias("truncated"),
    )
    kind = thin.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, span bigint, costs array<bigint>, audits array<string>"

    def row(frame, span, cells):
        out = frame[["conv"]].head(1).copy()
        out["span"], out["costs"] = span, [[c[0] if c else None for c in cells]]
        out["audits"] = [[c[1] if c else None for c in cells]]
        return out

    def parse_block(keys, frame):
        frame = frame.sort_values("at")
        kinds = bytes(kind_of(i, b or d, c) for i, b, d, c in zip(frame["initial"], frame["blank"], frame["copy"], frame["cut"]))
        return row(frame, keys[1], parse_blocks([kinds])[kinds])

    def combine(keys, frame):
        frame = frame.sort_values("span")
        leaves = [[(int(c), a) if a is not None else None for c, a in zip(*x)] for x in zip(frame["costs"], frame["audits"])]
        return row(frame, keys[1], parse_cells(leaves))

    span = F.floor(F.col("at") / BLOCK).alias("span")
    cells = stored(thin.groupBy("conv", span).applyInPandas(parse_block, schema), "conversation-cells")
    while not cells.groupBy("conv").count().where("count > 1").isEmpty():
        part = F.floor(F.col("span") / BLOCK).alias("part")
        cells = stored(cells.groupBy("conv", part).applyInPandas(combine, schema), "conversation-cells")
    ends = F.array(*[F.struct(F.col("costs")[i].alias("cost"), F.col("audits")[i].alias("audit")) for i in ENDS])
    best = F.array_min(F.filter(ends, lambda x: x["audit"].isNotNull()))
    parsed = cells.select("conv", best.alias("best")).select("conv", "best.cost", "best.audit")
    return faults.join(illegal.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left").select(
        "conv", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal")
    ), parsed


def _streamed(placed: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rows of long conversations in order, the audit of each (``at`` -1, in ``text``) before them."""
    heads = parsed.select("conv", F.lit(-1).cast("bigint").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = placed.where("present").select("conv", "at", "role", "text").unionByName(heads)
    return both.repartition(parts, "conv").sortWithinPartitions("conv", "at")


def _edits_of(batches):
    """(conversation, edit, role, text) of the repaired rows of streamed conversations; edit NULL begins one."""
    repair = conv = None
    for batch in batches:
        for conv_, at, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at == -1:
                if repair:
                    yield from ((conv, *x) for x in repair.inserted())
                conv, repair = conv_, Repair(text)
                yield conv, None, None, None
            else:
                yield from ((conv, *x) for x in repair.row(role, text))
    if repair:
        yield from ((conv, *x) for x in repair.inserted())


def _long_summaries(staged: DataFrame) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    kind = staged.schema["conv"].dataType
    key = to_arrow_type(kind)
    placed = numbered(staged, [F.col(c) for c in ("conv", "turn", "role", "text")], "at", "conversation-rows")
    faults, parsed = _parse_long(placed)
    parsed = stored(parsed, "conversation-audits")

    def digests(batches):
        def done():
            return pa.RecordBatch.from_arrays([pa.array([conv], key), pa.array([sha.hexdigest()])], names=["conv", "repaired_sha256"])

        sha = None
        for conv_, edit, role, text in _edits_of(batches):
            if edit is None:
                if sha:
                    yield done()
                conv, sha, first = conv_, hashlib.sha256(), True
            else:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if sha:
            yield done()

    digest = _streamed(placed, parsed).mapInArrow(digests, f"conv {kind.simpleString()}, repaired_sha256 string")
    out = faults
    for more in (parsed, digest):
        more = more.withColumnRenamed("conv", "c")
        out = out.join(more, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return out


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None, long: int = LONG,
) -> DataFrame:
    """One row per conversation: its id, the counts of its faults, ``cost``, ``audit`` and the digest of its repair."""
    ready(rows.sparkSession)
    few, many = _split(_staged(rows, conv, turn, role, text, present), long)
    out = _summaries(few)
    if many is not None:
        out = out.unionByName(_long_summaries(many))
    return out.withColumnRenamed("conv", conv)


def repaired_rows(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None, long: int = LONG,
) -> DataFrame:
    """The rows of the repaired conversations: id, ``place`` from 0, ``edit`` (K, R or I), ``role``, ``text``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    ready(rows.sparkSession)
    few, many = _split(_staged(rows, conv, turn, role, text, present), long)
    kind = few.schema["conv"].dataType
    key = to_arrow_type(kind)
    schema = f"conv {kind.simpleString()}, place bigint, edit string, role string, text string"

    def batch(rows):
        columns = list(zip(*rows))
        kinds = [key, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv", "place", "edit", "role", "text"])

    def run(batches):
        for some in _repairs(batches):
            out = [(conv_, i, *x) for conv_, r, _, _, audit in some for i, x in enumerate(_edited(r, audit))]
            if out:
                yield batch(out)

    def stream(batches):
        out, place, size = [], 0, 0
        for conv_, *x in _edits_of(batches):
            place = 0 if x[0] is None else place + 1
            if x[0]:
                out.append((conv_, place - 1, *x))
                size += len(x[2])
            if size > 4 << 20 or len(out) >= 10_000:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    found = _gathered(few).mapInArrow(run, schema)
    if many is not None:
        placed = numbered(many, [F.col(c) for c in ("conv", "turn", "role", "text")], "at", "conversation-rows")
        parsed = stored(_parse_long(placed)[1], "conversation-audits")
        found = found.unionByName(_streamed(placed, parsed).mapInArrow(stream, schema))
    return found.withColumnRenamed("conv", conv)
