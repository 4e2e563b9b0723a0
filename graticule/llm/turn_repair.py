"""Repair of conversation structure by Wagner-Fischer alignment to an alternating grammar.

A conversation's role initials should read ``(s?(ua)+)?``.  Its turns are aligned to the
grammar string of each feasible length: keeping a turn is free, a new role, ``user`` or
``assistant``, costs 2, a deletion 3 and an inserted empty turn 2; blank and repeated
turns must go, and a truncated turn that stays adds 1.  Only the band of cells that the
incumbent cost can still reach is filled (Ukkonen 1985): the incumbent starts as a small
threshold that doubles until an alignment fits, then it is the cheapest one so far, and
lengths and cells that cost more are skipped.  The edits are traced back to the
ASCII-least audit of their initials, and the audits of all cheapest lengths are compared.

One conversation may be very long, so turns are sorted by ranges over all tasks and cut
into segments of at most 32 turns.  A segment is aligned from each state of the grammar
(start, after system, after user, after assistant) that it may begin in to each that it
may end in.  One walk over the segments from the last to the first picks the cheapest
end for each beginning, another one from the first fixes the states; both stream a row
of costs for each segment, without turns, and keep four numbers.  Insertions belong to
the turn after them, so no audit of a segment is the beginning of another one, and the
least audit of a conversation is made of the segments' least audits.

Null roles and texts count as one space, which is neither a role of the grammar nor a
visible text.  A null conversation id is a conversation like any other.  Turns are taken
by number, null numbers first, then by role and text.  Very long texts pass through in
segments with fewer turns.  An empty table gives no rows.  Other columns are not read.
"""

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graticule.llm.common import SPACE, named
from graticule.session import durable

TURNS = 32  # at most, in a segment
CHARS = 1 << 20  # of text in a segment, unless one turn has more
START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ENDINGS = ["", "II", "I", ""]  # what completes the grammar from each state
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60


def goal(begin, end, length):
    """The grammar's string of ``length`` symbols from one state to another, or None."""
    for head in ("", "s") if begin == START else ("",):
        state, rest = SYSTEM if head else begin, length - len(head)
        if rest > 0:
            pair = "au" if state == USER else "ua"
            body = (pair * rest)[:rest]
            state = USER if body[-1] == "u" else ASSISTANT
        if rest >= 0 and state == end:
            return head + (body if rest else "")
    return None


def price(code):
    """What deleting a turn costs beyond the unavoidable."""
    return 0 if code == "-" else DELETE - TRUNCATED if code.isupper() else DELETE


def align(codes, target, limit):
    """Cheapest edits of ``codes`` into ``target`` up to ``limit``: (cost, audit) or None.

    Codes are role initials, in capitals for truncated turns, and ``-`` for turns that
    must go.  The cost is what exceeds the price of deletions and truncations that
    nothing avoids; leaving the diagonal by one turn then costs 2 at least.
    """
    kept, m = sum(c != "-" for c in codes), len(target)
    shift = m - kept
    spare = (limit // 2 - abs(shift)) // 2
    if spare < 0:
        return None
    low, high = min(0, shift) - spare, max(0, shift) + spare
    after = {m: 0}
    table, before = [after], kept
    for code in reversed(codes):
        free = code != "-"
        before -= free
        drop = price(code)
        role, row = code.lower(), {}
        for j in range(min(m, before + high), max(0, before + low) - 1, -1):
            ways = [after.get(j, NEVER) + drop]
            if j < m and target[j] != "s":
                ways.append(row.get(j + 1, NEVER) + INSERT)
            if j < m and free and (target[j] == role or target[j] != "s"):
                ways.append(after.get(j + 1, NEVER) + (0 if target[j] == role else REROLE))
            if min(ways) + 2 * abs(j - before) <= limit:
                row[j] = min(ways)
        table.append(row)
        after = row
    table.reverse()
    if 0 not in table[0]:
        return None
    i = j = 0
    audit = []
    while i < len(codes):
        code, cost = codes[i], table[i][j]
        drop = price(code)
        if table[i + 1].get(j, NEVER) + drop == cost:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and table[i].get(j + 1, NEVER) + INSERT == cost:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if target[j] == code.lower() else "R")
            i, j = i + 1, j + 1
    return table[0][0], "".join(audit)


def cheapest(codes, begin, end):
    """Cheapest edits over the grammar strings of every feasible length: (cost, audit) or None."""
    if end < begin and (begin, end) != (ASSISTANT, USER):
        return None
    if begin == START and end == SYSTEM and "s" not in codes.lower():
        return None
    kept = sum(c != "-" for c in codes)
    limit, most = 2, DELETE * kept + 2 * INSERT
    while True:
        best = None
        for length in sorted(range(max(0, kept - limit // 2), kept + limit // 2 + 1),
                             key=lambda m: abs(m - kept)):
            incumbent = best[0] if best else limit
            if 2 * abs(length - kept) > incumbent:
                break
            target = goal(begin, end, length)
            found = align(codes, target, incumbent) if target is not None else None
            if found and (best is None or found < best):
                best = found
        if best or limit > most:
            break
        limit *= 2
    if best is None:
        return None
    unavoidable = DELETE * (len(codes) - kept) + TRUNCATED * sum(c.isupper() for c in codes)
    return best[0] + unavoidable, best[1]


@functools.lru_cache(200_000)
def ways(codes, begins):
    """[(begin, end, cost, audit)] of a segment that begins in one of ``begins``."""
    found = [(b, e, cheapest(codes, b, e)) for b in begins for e in range(4)]
    return [(b, e, *way) for b, e, way in found if way]


def repair_one(codes):
    """(cost, audit) of a whole conversation."""
    return min((cost + INSERT * len(ENDINGS[end]), audit + ENDINGS[end])
               for _, end, cost, audit in ways(codes, (START,))) if codes else (0, "")


def rebuild(roles, texts, codes, begin, audit):
    """The turns that an audit leaves or makes, from the state ``begin`` on."""
    turns, i, state = [], 0, begin
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            turns.append((roles[i], texts[i]))
            symbol = codes[i].lower()
        else:
            symbol = "a" if state == USER else "u"
            turns.append((ROLES[symbol], texts[i] if edit == "R" else ""))
        i += edit != "I"
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[symbol]
    return turns


def faults(turns: DataFrame, conversation="conv_id", turn="turn", role="role", text="text"):
    """Stored rows _conv, turn, role, text, _row, initial and fault (or null).

    Nulls in role and text become one space.  The first of blank, duplicate and
    truncated counts; equal rows differ by the stored number ``_row`` only.
    """
    rows = durable(turns.select(
        named(conversation).alias("_conv"), named(turn).cast("bigint").alias("turn"),
        F.coalesce(named(role), F.lit(" ")).alias("role"),
        F.coalesce(named(text), F.lit(" ")).alias("text"),
    ).withColumn("_row", F.monotonically_increasing_id()))
    same = rows.groupBy("_conv", "role", F.sha2("text", 256).alias("_text")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("turn", "_row")).alias("_first"))
    same = same.where("_n > 1").select(
        F.col("_conv").alias("_c"), F.col("role").alias("_r"), "_text", F.col("_first._row").alias("_f"))
    rows = rows.withColumn("_sha", F.sha2("text", 256))
    marked = rows.join(same, rows["_conv"].eqNullSafe(same["_c"]) & (rows["role"] == same["_r"])
                       & (rows["_sha"] == same["_text"]), "left")
    shown = F.regexp_replace("text", SPACE + "$", "")
    fault = (F.when(shown == "", "blank").when(F.col("_f") != F.col("_row"), "duplicate")
             .when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "truncated"))
    return marked.select("_conv", "turn", "role", "text", "_row",
                         F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def code_of(initial: Column, fault: Column) -> Column:
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return (F.when(fault.isin("blank", "duplicate"), "-")
            .when(fault == "truncated", F.upper(known)).otherwise(known))


WAYS = "array<struct<begin:int,end:int,cost:bigint,audit:string>>"


def segments(marked: DataFrame, per_task=100_000, most=TURNS) -> DataFrame:
    """Stored segments: _conv, _at (their order), codes, roles, texts, initials, illegal, ways.

    A hot conversation spans tasks.  Only a segment that may go on from another task is
    aligned from every state; one that begins its conversation starts at the start.
    """
    parts = max(1, -(-marked.count() // per_task))
    order = ["_conv", "turn", "role", "text", "_row"]
    ranged = marked.select(*order, "initial", code_of(F.col("initial"), F.col("fault")).alias("code"))
    ranged = ranged.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = marked.schema["_conv"].dataType.simpleString()
    id_type = ranged.schema["_conv"].dataType

    def cut(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        place, done = TaskContext.get().partitionId() << 33, 0
        names = ["_conv", "_at", "codes", "roles", "texts", "first", "last", "illegal", "ways"]
        kinds = [to_arrow_type(id_type), pa.int64(), pa.string(), pa.list_(pa.string()),
                 pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(),
                 pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()),
                                     ("cost", pa.int64()), ("audit", pa.string())]))]
        out, conv, rows, size, begins = [], None, [], 0, (START, SYSTEM, USER, ASSISTANT)

        def segment():
            nonlocal done
            roles, texts, initials, codes = zip(*rows)
            pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            code = "".join(codes)
            out.append((conv, place + done, code, list(roles), list(texts), initials[0], initials[-1],
                        pairs, [dict(zip(("begin", "end", "cost", "audit"), w))
                                for w in ways(code, begins)]))
            done += 1

        def batch():
            columns = zip(*out)
            made = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        seen = 0
        for given in batches:
            columns = [given.column(c).to_pylist() for c in (
                "_conv", "role", "text", "initial", "code")]
            for c, role, text, initial, code in zip(*columns):
                other = seen and c != conv
                if rows and (other or len(rows) == most or size + len(text) > CHARS):
                    segment()
                    rows, size = [], 0
                    begins = (START, SYSTEM, USER, ASSISTANT)
                if other:
                    begins = (START,)
                conv, seen = c, seen + 1
                rows.append((role, text, initial, code))
                size += len(text)
            if out:
                yield batch()
        if rows:
            segment()
            yield batch()

    return durable(ranged.mapInArrow(
        cut, f"_conv {kind}, _at bigint, codes string, roles array<string>, texts array<string>, "
             f"first string, last string, illegal bigint, ways {WAYS}"))


def runs(batches, names):
    """Rows of a sorted stream with a flag for the first one of each conversation."""
    before = None
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            yield row, before is None or before[0] != row[0]
            before = row[:1]


def batches_of(rows, names, kinds, size=512):
    """Record batches of an iterator of rows."""
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names=names)


def states(cut: DataFrame) -> DataFrame:
    """For each segment: _at, begin, end, cost and illegal pairs, the one before it counted.

    ``end`` carries the grammar's completion: 4 + state for the last segment.
    """
    kind = cut.schema["_conv"].dataType.simpleString()
    id_type = cut.schema["_conv"].dataType

    def backward(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        def rows():
            left = None
            for (conv, at, found, first, last, illegal), fresh in runs(
                    batches, ["_conv", "_at", "ways", "first", "last", "illegal"]):
                if fresh:
                    left = [INSERT * len(e) for e in ENDINGS]
                best = [None] * 4
                for w in found:
                    total = w["cost"] + left[w["end"]]
                    way = (total, w["audit"], w["end"], w["cost"])
                    if best[w["begin"]] is None or way < best[w["begin"]]:
                        best[w["begin"]] = way
                left = [w[0] if w else NEVER for w in best]
                yield (conv, at, fresh, first, last, illegal, [w[2] if w else -1 for w in best],
                       [w[3] if w else 0 for w in best])

        names = ["_conv", "_at", "final", "first", "last", "illegal", "next", "costs"]
        kinds = [to_arrow_type(id_type), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(),
                 pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield from batches_of(rows(), names, kinds)

    def forward(batches):
        def rows():
            state = last_initial = None
            for (_, at, final, first, last, illegal, following, costs), fresh in runs(
                    batches, ["_conv", "_at", "final", "first", "last", "illegal", "next", "costs"]):
                begin = START if fresh else state
                state = following[begin]
                if not fresh:
                    illegal += last_initial + first not in ("su", "ua", "au")
                last_initial = last
                cost = costs[begin] + (INSERT * len(ENDINGS[state]) if final else 0)
                yield at, begin, state, final, cost, illegal

        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        yield from batches_of(rows(), ["_at", "begin", "end", "final", "cost", "illegal"], kinds)

    small = cut.select("_conv", "_at", "ways", "first", "last", "illegal")
    back = small.repartition("_conv").sortWithinPartitions("_conv", F.col("_at").desc()).mapInArrow(
        backward, f"_conv {kind}, _at bigint, final boolean, first string, last string, illegal bigint, "
                  "next array<int>, costs array<bigint>")
    return back.repartition("_conv").sortWithinPartitions("_conv", "_at").mapInArrow(
        forward, "_at bigint, begin int, end int, final boolean, cost bigint, illegal bigint")


def repair(marked: DataFrame, per_task=100_000, most=TURNS) -> DataFrame:
    """Repaired segments in order of ``_at``: _conv, _at, cost, illegal, audit, turns.

    ``marked`` comes from ``faults``; ``turns`` are the role and text of each turn that
    stays, changed or not, or is inserted.
    """
    cut = segments(marked, per_task, most)

    @F.arrow_udf("struct<audit:string,turns:array<struct<role:string,text:string>>>")
    def apply(codes: pa.Array, roles: pa.Array, texts: pa.Array, found: pa.Array, begin: pa.Array,
              end: pa.Array, final: pa.Array) -> pa.Array:
        out = []
        for code, role, text, ways_, b, e, last in zip(*(
                x.to_pylist() for x in (codes, roles, texts, found, begin, end, final))):
            audit = next(w["audit"] for w in ways_ if (w["begin"], w["end"]) == (b, e))
            audit += ENDINGS[e] if last else ""
            out.append({"audit": audit, "turns": [
                {"role": r, "text": t} for r, t in rebuild(role, text, code, b, audit)]})
        return pa.array(out, pa.struct([("audit", pa.string()), ("turns", pa.list_(pa.struct(
            [("role", pa.string()), ("text", pa.string())])))]))

    done = cut.drop("illegal").join(states(cut), "_at")
    done = done.withColumn("_done", apply("codes", "roles", "texts", "ways", "begin", "end", "final"))
    return done.select("_conv", "_at", "cost", "illegal", "_done.audit", "_done.turns")


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: _conv, cost, illegal, audit and the hash of its turns.

    The hash runs over a conversation's segments one after the other, as it must.
    """
    kind = repaired.schema["_conv"].dataType.simpleString()
    id_type = repaired.schema["_conv"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        def rows():
            open_ = None
            for (conv, cost, illegal, audit, turns), fresh in runs(
                    batches, ["_conv", "cost", "illegal", "audit", "turns"]):
                if fresh:
                    if open_:
                        yield open_[0], open_[1], open_[2], "".join(open_[3]), open_[4].hexdigest()
                    open_, any_ = [conv, 0, 0, [], hashlib.sha256()], False
                open_[1] += cost
                open_[2] += illegal
                open_[3].append(audit)
                for t in turns:
                    open_[4].update((("\n" if any_ else "") + t["role"] + ":" + t["text"]).encode())
                    any_ = True
            if open_:
                yield open_[0], open_[1], open_[2], "".join(open_[3]), open_[4].hexdigest()

        kinds = [to_arrow_type(id_type), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield from batches_of(rows(), ["_conv", "cost", "illegal", "audit", "sha"], kinds)

    return repaired.repartition("_conv").sortWithinPartitions("_conv", "_at").mapInArrow(
        run, f"_conv {kind}, cost bigint, illegal bigint, audit string, sha string")


def damage(turns: DataFrame) -> DataFrame:
    """``conversations`` with faults by checksum of ``conv_id:turn``: every fault one in twenty.

    Nulls in role and text become one space, and so do null numbers in the checksum.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat_ws(":", *part).cast("binary")) % 20).alias("_k"))
    rows = rows.where("_k <> 0").select(
        "conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_k") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


def audit(turns: DataFrame, ids: DataFrame, per_task=100_000, most=TURNS) -> DataFrame:
    """One row per id of ``ids`` (column conv_id): its turns' faults, repair costs and digests."""
    marked = durable(faults(turns))
    numbers = marked.groupBy("_conv", "turn").agg(
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    counts = numbers.groupBy("_conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    done = digests(repair(marked, per_task, most)).withColumnRenamed("_conv", "_c")
    both = counts.join(done, counts["_conv"].eqNullSafe(done["_c"])).drop("_c")
    ids = ids.select("conv_id").distinct()
    return ids.join(both, ids["conv_id"].eqNullSafe(both["_conv"]), "left").select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in (
            "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
