"""Repair of conversation structure by a min-plus matrix scan.

A repaired conversation's role initials are nothing, or an optional ``s`` and then ``ua`` once or more. Its automaton
has four states: nothing yet, after s, after u, after a. A turn is a 4 x 4 matrix whose element (i, j) is the
cheapest (cost, audit) that takes state i over this turn to state j: any inserts first (their closure is a matrix of
its own), then one edit. Audits are the edits' initials: Keep, Rerole, Delete, Insert. Matrices multiply by
(min, +): costs add, audits join, and the less (cost, audit) stays. Products may be taken in any grouping:

* joining on the left or right keeps the order of two audits of one span and one cost, as neither can be a proper
  prefix of the other (it would lack inserts only, which cost);
* so rows are sorted by range over all tasks, cut into chunks of at most ``CHUNK`` turns and ``CHUNK_BYTES``, each
  chunk is reduced to a matrix by a tree, and the chunks of a long conversation are reduced by a tree of
  ``FAN`` branches over as many tasks. No task holds a conversation.

The audit is then cut at the chunks' ends and each chunk is replayed where it lies. The digest of a repaired text
follows its order, so the chunks of one long conversation stream through one task for it, one at a time.

Defined cases: a null role or text is one space; a null conversation id is a conversation of its own; null turns come
first; rows of one turn go by role, text (code points); rows that repeat all of it are adjacent; no rows
give no conversations; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, lean, saved

CHUNK, CHUNK_BYTES, FAN = 1024, 4 << 20, 32
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Initials that may follow one another, and the states that a role may be put after.
LEGAL, BEFORE = {"su", "ua", "au"}, {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def product(x: Matrix, y: Matrix) -> Matrix:
    out = []
    for i in range(0, 16, 4):
        for j in range(4):
            best = None
            for k in range(4):
                a, b = x[i + k], y[4 * k + j]
                if a is not None and b is not None:
                    c = a[0] + b[0]
                    if best is None or c <= best[0]:
                        new = (c, a[1] + b[1])
                        best = new if best is None or new < best else best
            out.append(best)
    return tuple(out)


def _matrix(steps: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(steps.get((i, j)) for i in range(4) for j in range(4))


#: One insert at most between two states is enough but for a whole pair: more would come back to a state met before.
IDENTITY = _matrix({(i, i): (0, "") for i in range(4)})
ONE_INSERT = _matrix({**{(i, i): (0, "") for i in range(4)}, **{(i, AFTER[r]): (INSERT, "I") for r in "ua" for i in BEFORE[r]}})
INSERTS = product(ONE_INSERT, ONE_INSERT)


def turn_matrix(initial: str, fault: int) -> Matrix:
    steps = {(i, i): (DELETE, "D") for i in range(4)}
    if fault not in (BLANK, DUPLICATE):
        more = CUT if fault == TRUNCATED else 0
        ways = [(r, REROLE + more, "R") for r in "ua"] + ([(initial, more, "K")] if initial in BEFORE else [])
        for role, cost, name in ways:
            for i in BEFORE[role]:
                steps[i, AFTER[role]] = min((cost, name), steps.get((i, AFTER[role]), (cost, name)))
    return product(INSERTS, _matrix(steps))


def reduce_tree(matrices: list[Matrix]) -> Matrix:
    while len(matrices) > 1:
        paired = [product(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = paired + matrices[len(matrices) & ~1 :]
    return matrices[0] if matrices else IDENTITY


def cheapest(whole: Matrix) -> tuple[int, str]:
    """(cost, audit) of a conversation, from the product of its turns."""
    closed = product(whole, INSERTS)
    return min(e for e in (closed[START], closed[ASSISTANT]) if e is not None)


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts that the edits leave, from a state on."""
    out, turn = ([], []), iter(zip(roles, texts))
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(turn)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = AFTER[role[0]]
        out[0].append(role)
        out[1].append(text)
    return out


def cut_audit(audit: str, sizes: list[int]) -> list[tuple[int, str]]:
    """(state, audit) of each chunk of so many turns; inserts go with the turn after them, the last with the last chunk."""
    left = len(audit) - audit.count("D")
    first = SYSTEM if left % 2 else USER  # only a kept s makes the number of turns that are left odd
    out, at, made = [], 0, 0
    for k, size in enumerate(sizes):
        end, seen = at, 0
        while seen < size:
            seen += audit[end] != "I"
            end += 1
        end = len(audit) if k == len(sizes) - 1 else end
        state = START if not made else SYSTEM if first == SYSTEM and made == 1 else USER if (made - (first == SYSTEM)) % 2 else ASSISTANT
        out.append((state, audit[at:end]))
        made += end - at - audit.count("D", at, end)
        at = end
    return out


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ordered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text, copies, fault (of the first copy), in order over all tasks. Rows that repeat all
    four are counted before they are sent; whether a role and text came earlier is asked only of those that repeat."""
    rows = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    rows = saved(rows, "conversation-rows")
    said = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    said = said.select(*(F.col(c).alias(f"__{c}") for c in ("conv_id", "role", "digest")), F.col("first.turn").alias("__turn"), F.lit(True).alias("__again"))
    rows = rows.join(said, _same("conv_id", "__conv_id") & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest")), "left")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", BLANK).when(F.col("__again") & ~_same("turn", "__turn"), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED)
    rows = rows.select("conv_id", "turn", "role", "text", "copies", F.coalesce(fault, F.lit(NONE)).alias("fault"))
    key = ["conv_id", "turn", "role", "text"]
    return rows.repartitionByRange(*key).sortWithinPartitions(*key)


#: What a chunk or several of them come to.
SPAN = "rows long, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>"
SPAN_NAMES = [part.split(" ", 1)[0] for part in SPAN.split(", ")]
SPAN_TYPES = [*[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
CHUNK_NAMES = ["conv_id", "part", "seq", *SPAN_NAMES, "roles", "texts"]
CHUNK_TYPES = [pa.int64()] * 3 + SPAN_TYPES + [pa.list_(pa.string())] * 2


def _packed(matrix: Matrix) -> tuple[list, list]:
    return [e and e[0] for e in matrix], [e and e[1] for e in matrix]


def _matrix_of(costs: list, audits: list) -> Matrix:
    return tuple(None if c is None else (c, a) for c, a in zip(costs, audits))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def span_of(turns: list[tuple]) -> tuple:
    """The span of a chunk's turns (turn, role, fault)."""
    known: dict = {}
    numbers = [t for t, _, _ in turns if t is not None]
    initials = [role[:1] for _, role, _ in turns]
    faults = [fault for _, _, fault in turns]
    matrix = reduce_tree([known.get(k) or known.setdefault(k, turn_matrix(*k)) for k in zip(initials, faults)])
    counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    ends = (numbers[0], numbers[-1]) if numbers else (None, None)
    return (len(turns), len({*numbers}), *ends, *counts, illegal, initials[0], initials[-1], *_packed(matrix))


def joined(spans: list[tuple]) -> tuple:
    """The span of consecutive spans."""
    rows, turns = sum(s[0] for s in spans), sum(s[1] for s in spans)
    numbered = [s for s in spans if s[2] is not None]
    turns -= sum(a[3] == b[2] for a, b in zip(numbered, numbered[1:]))
    ends = (numbered[0][2], numbered[-1][3]) if numbered else (None, None)
    illegal = sum(s[7] for s in spans) + sum(a[9] + b[8] not in LEGAL for a, b in zip(spans, spans[1:]))
    matrix = reduce_tree([_matrix_of(s[10], s[11]) for s in spans])
    return (rows, turns, *ends, *(sum(s[k] for s in spans) for k in (4, 5, 6)), illegal, spans[0][8], spans[-1][9], *_packed(matrix))


def chunks(rows: DataFrame) -> DataFrame:
    """Chunks of one conversation each, in order by part and seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, done, size, conv = TaskContext.get().partitionId(), 0, [], [], 0, None

        def close() -> None:
            nonlocal held, seq, size
            if held:
                span = span_of([(t, role, fault) for t, role, fault, _ in held])
                done.append((conv, part, seq, *span, [r for _, r, _, _ in held], [x for _, _, _, x in held]))
                held, seq, size = [], seq + 1, 0

        for batch in batches:
            for c, turn, role, text, copies, fault in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if c != conv:
                    close()
                    conv = c
                for k in range(copies):
                    if len(held) == CHUNK or size > CHUNK_BYTES:
                        close()
                    held.append((turn, role, fault if not k or fault == BLANK else DUPLICATE, "" if fault == BLANK or k else text))
                    size += len(held[-1][3])
                if len(done) >= 500:
                    yield _batch(done, CHUNK_NAMES, CHUNK_TYPES)
                    done.clear()
            yield _batch(done, CHUNK_NAMES, CHUNK_TYPES)
            done.clear()
        close()
        yield _batch(done, CHUNK_NAMES, CHUNK_TYPES)

    return rows.mapInArrow(lean(run), f"conv_id long, part long, seq long, {SPAN}, roles array<string>, texts array<string>")


def reduced(spans: DataFrame) -> DataFrame:
    """conv_id, idx (0) and the span of each conversation, from those of its consecutive chunks (conv_id, idx, ...)."""
    names, types = ["conv_id", "idx", *SPAN_NAMES], [pa.int64(), pa.int64(), *SPAN_TYPES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            done = []
            for conv, idx, *span in zip(*(batch.column(k).to_pylist() for k in range(len(names)))):
                if held and (conv, idx // FAN) != group:
                    done.append((*group, *joined(held)))
                    held = []
                group = (conv, idx // FAN)
                held.append(tuple(span))
            yield _batch(done, names, types)
        yield _batch([(*group, *joined(held))] if held else [], names, types)

    while True:
        branch = F.floor(F.col("idx") / FAN)
        dealt = spans.select(*names).repartition("conv_id", branch).sortWithinPartitions("conv_id", "idx")
        spans = saved(dealt.mapInArrow(lean(run), f"conv_id long, idx long, {SPAN}"), "conversation-spans")
        if not spans.where("idx > 0").limit(1).count():
            return spans


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after repair. Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    Turns: conv_id, part, seq, roles, texts - the repaired turns of a chunk; by part and seq chunks are in order."""
    pieces = saved(chunks(ordered(rows, conv_id, turn, role, text)), "conversation-chunks")
    several = saved(pieces.groupBy("conv_id").agg(F.count("*").alias("__chunks")).where("__chunks > 1").select(F.col("conv_id").alias("__long")), "conversation-long")
    is_long = _same("conv_id", "__long")
    short = pieces.join(several, is_long, "left_anti")
    spans = pieces.join(several, is_long).drop("__long")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "seq")) - 1
    spans = saved(spans.select("conv_id", "part", "seq", idx.cast("long").alias("idx"), *SPAN_NAMES), "conversation-spans")
    whole = reduced(spans)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
        for batch in batches:
            out = []
            for conv, *s in zip(*(batch.column(k).to_pylist() for k in range(1 + len(SPAN_NAMES)))):
                gaps = 0 if s[2] is None else s[3] - s[2] + 1 - s[1]
                out.append((conv, gaps, *s[4:8], *cheapest(_matrix_of(s[10], s[11]))))
            yield _batch(out, names, [pa.int64()] * 7 + [pa.string()])

    all_spans = short.select("conv_id", *SPAN_NAMES).unionByName(whole.select("conv_id", *SPAN_NAMES))
    decided = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    conversations = saved(all_spans.mapInArrow(lean(decide), decided), "conversation-audits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, audit, sizes in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows_ = [(conv, k, *piece) for k, piece in enumerate(cut_audit(audit, sizes))]
                yield _batch(rows_, ["__conv", "__idx", "state", "audit"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    sizes = spans.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "rows"))).getField("rows").alias("sizes"))
    cuts = conversations.join(several, is_long).select("conv_id", "audit").join(sizes.select(F.col("conv_id").alias("__long"), "sizes"), is_long)
    cuts = cuts.select("conv_id", "audit", "sizes").mapInArrow(lean(cut), "__conv long, __idx long, state long, audit string")
    at = spans.select("conv_id", "part", "seq", "idx").join(cuts, _same("conv_id", "__conv") & (F.col("idx") == F.col("__idx")))
    at = at.select(F.col("part").alias("__part"), F.col("seq").alias("__seq"), "state", "audit")
    cells = ["conv_id", "part", "seq", "state", "audit", "roles", "texts"]
    long_ = pieces.join(at, (F.col("part") == F.col("__part")) & (F.col("seq") == F.col("__seq"))).select(*cells)
    one = conversations.select(F.col("conv_id").alias("__long"), "audit")
    short = short.withColumn("state", F.lit(START).cast("long")).join(one, is_long).select(*cells)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_ in range(0, batch.num_rows, 256):
                part = batch.slice(at_, 256)
                left = [replay(a, s, r, x) for s, a, r, x in zip(*(part.column(k).to_pylist() for k in (3, 4, 5, 6)))]
                columns = [pa.array([x[k] for x in left], pa.list_(pa.string())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["conv_id", "part", "seq", "roles", "texts"])

    turns = short.unionByName(long_).mapInArrow(lean(play), "conv_id long, part long, seq long, roles array<string>, texts array<string>")
    return conversations, saved(turns, "conversation-turns")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 (hex) of the repaired ``role:text`` lines. Chunks of a conversation stream by in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, written = None, None, False
        for batch in batches:
            done = []
            for c, roles, texts in zip(batch.column(0), batch.column(3), batch.column(4)):
                c = c.as_py()
                if digest is None or c != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest, written = c, hashlib.sha256(), False
                for role, text in zip(roles.as_py(), texts.as_py()):
                    digest.update((("\n" if written else "") + f"{role}:{text}").encode("utf-8", "replace"))
                    written = True
            yield _batch(done, ["conv_id", "sha256"], [pa.int64(), pa.string()])
        yield _batch([] if digest is None else [(conv, digest.hexdigest())], ["conv_id", "sha256"], [pa.int64(), pa.string()])

    dealt = turns.select("conv_id", "part", "seq", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return dealt.mapInArrow(lean(run), "conv_id long, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the stated faults put in, by crc32 of ``conv_id:turn`` modulo 20."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.where("kind <> 0").withColumn("__copy", F.explode(times))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows``, damaged and repaired: counts, cost, audit and the digest of what is left."""
    conversations, turns = repair(damaged(rows))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = out.join(conversations.withColumnRenamed("conv_id", "__c"), _same("conv_id", "__c"), "left")
    out = out.join(digests(turns).withColumnRenamed("conv_id", "__d"), _same("conv_id", "__d"), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
