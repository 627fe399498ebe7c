"""Repair of conversations by aligning their turns to the alternating grammar ``(s?(ua)+)?``.

The turns of a conversation are aligned, as in Wagner and Fischer's table, to the target strings ``uaua..`` and ``suaua..`` of every feasible
length.  Targets are counted from their end, so one table of (turns left, target signs left) serves all lengths that end alike.  Only diagonals
whose insertions or deletions alone do not exceed the incumbent cost (of a first greedy repair) are filled, as Ukkonen bounds them.  All lengths of
least cost are traced back, each to its least audit in ASCII order, and the least of these is taken.

A long conversation is cut into blocks of ``BLOCK`` turns.  A block's tables start from the cost of what follows it, by the phase of the grammar
at its end; insertions stand before a turn, and only behind the last turn of all in the last block, so that no audit of a block is the beginning
of another one and the least audits of the blocks make the least audit of the whole.

Sorting and damage are DataFrame work.  Faults and audits come from a narrow table (no texts), whose rows meet in one task by conversation
and are streamed; a task holds one byte a turn.  The texts are streamed once more, behind their audit, into the digest, which is one sequential hash.

Nulls in role or text are one space; a null turn sorts first and bears no gap; null conversation ids are one conversation.  Rows with
equal turns are ordered by the MD5 of role and text, so repeated rows stand together.  Empty and very long texts need no care.  A conversation whose
rows are all dropped has zeros, an empty audit and the hash of the empty string.  An empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLOCK = 64
INF = 1 << 40
MUST, SHORT = 4, 8  # bits of a turn's sign beside its role: 0 system, 1 user, 2 assistant, 3 another
END = (0, INF, INF, 0)  # cost of what follows, by phase: 0 nothing yet, 1 after s, 2 after u, 3 after a
FAULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
MD5_ROLE = "unhex(md5(concat(coalesce(role, ' '), ':', coalesce(text, ' '))))"


def greedy(turns: bytes, phase: int, after: tuple, last: bool) -> int:
    """Cost of a simple repair from ``phase``: no insertion before a turn, no deletion but those required."""
    cost = 0
    for x in turns:
        if x & MUST:
            cost += DELETE
            continue
        role = x & 3
        cost += CUT if x & SHORT else 0
        if role == 0 and phase == 0:
            phase = 1
            continue
        want = 2 if phase == 2 else 1
        cost += 0 if role == want else RETYPE
        phase = 3 if phase == 2 else 2
    if last and phase in (1, 2):
        return cost + (2 * INSERT if phase == 1 else INSERT) + after[3]
    return cost + after[phase]


class Tables:
    """Costs of aligning the turns i.. to the last r signs of a target, for targets that end with u and with a."""

    def __init__(self, turns: bytes, after: tuple, last: bool, phases: tuple):
        self.turns, self.after, self.last = turns, after, last
        m = len(turns)
        room = max(greedy(turns, p, after, last) for p in phases) - min(after)
        self.low, self.high = -(room // DELETE), room // INSERT  # diagonals r - (m - i)
        self.ends = {e: self.fill(e) for e in ((3,) if last else (2, 3))}
        self.gone = [0] * (m + 1)
        for i in range(m - 1, -1, -1):
            self.gone[i] = self.gone[i + 1] + DELETE

    def fill(self, end: int) -> list[dict[int, int]]:
        turns, m = self.turns, len(self.turns)
        base, tail = self.after[end], INSERT if self.last else INF
        row = {r: min(INF, base + r * tail) for r in range(0, max(0, self.high) + 1)}
        out = [row]
        for i in range(m - 1, -1, -1):
            x, below, row = turns[i], row, {}
            keep, extra = not x & MUST, CUT if x & SHORT else 0
            left = m - i
            for r in range(max(0, left + self.low), left + self.high + 1):
                best = below.get(r, INF) + DELETE
                if r:
                    best = min(best, row.get(r - 1, INF) + INSERT)
                    if keep:
                        best = min(best, below.get(r - 1, INF) + extra + (0 if x & 3 == sign(end, r) else RETYPE))
                row[r] = best
            out.append(row)
        return out[::-1]

    def starts(self, phase: int):
        """(cost, kind, end, length) of every target that may stand at ``phase``; kind 0 without s, 1 with s, 2 nothing more."""
        m = len(self.turns)
        for end, rows in self.ends.items():
            for r, cost in rows[0].items():
                if r and (sign(end, r) == 2) == (phase == 2):
                    yield cost, 0, end, r
            if phase == end:
                yield rows[0].get(0, INF), 0, end, 0
        if phase in (0, 1):
            yield self.gone[0] + self.after[phase], 2, phase, 0
        if phase == 0:
            for end, rows in self.ends.items():
                lengths = {r for row in rows for r in row if r and sign(end, r) == 1}
                for r in lengths:
                    yield self.with_system(end, r, 0), 1, end, r
            if self.after[1] < INF:
                yield self.lone_system(0), 1, 1, 0

    def with_system(self, end: int, r: int, i: int) -> int:
        """Cost from turn i when s and r further signs are to come: deletions up to a kept system turn."""
        return min((DELETE * (k - i) + (CUT if x & SHORT else 0) + self.ends[end][k + 1].get(r, INF) for k, x in enumerate(self.turns[i:], i) if not x & MUST and x & 3 == 0), default=INF)

    def lone_system(self, i: int) -> int:
        return min((DELETE * (k - i) + (CUT if x & SHORT else 0) + self.gone[k + 1] + self.after[1] for k, x in enumerate(self.turns[i:], i) if not x & MUST and x & 3 == 0), default=INF)

    def best(self, phase: int) -> int:
        return min(x[0] for x in self.starts(phase))

    def audit(self, phase: int) -> tuple[str, int]:
        """Least audit of least cost from ``phase``, over all lengths, and the phase it ends in."""
        least = self.best(phase)
        return min((self.trace(kind, end, r), end) for cost, kind, end, r in self.starts(phase) if cost == least)

    def trace(self, kind: int, end: int, r: int) -> str:
        turns, m, out, i = self.turns, len(self.turns), [], 0
        if kind == 2:
            return "D" * m
        if kind == 1:
            cost = (lambda k: self.lone_system(k)) if end == 1 else (lambda k: self.with_system(end, r, k))
            while i + 1 < m and cost(i) == DELETE + cost(i + 1):  # a later system turn does as well, and D comes before K
                out.append("D")
                i += 1
            out.append("K")
            i += 1
            if end == 1:
                return "".join(out) + "D" * (m - i)
        rows = self.ends[end]
        while i < m or r:
            here = rows[i][r]
            if i < m and rows[i + 1].get(r, INF) + DELETE == here:
                out.append("D")
                i += 1
                continue
            if r and rows[i].get(r - 1, INF) + INSERT == here:
                out.append("I")
            else:
                out.append("K" if turns[i] & 3 == sign(end, r) else "R")
                i += 1
            r -= 1
        return "".join(out)


def sign(end: int, r: int) -> int:
    """Role of the sign with r signs left, itself included, in a target that ends with u (2) or a (3)."""
    return (2 if end == 3 else 1) if r % 2 else (1 if end == 3 else 2)


@lru_cache(maxsize=1 << 14)
def short_repair(turns: bytes) -> tuple[int, str]:
    tables = Tables(turns, END, True, (0,))
    return tables.best(0), tables.audit(0)[0]


def repair(turns: bytes, block: int = BLOCK) -> tuple[int, str]:
    """Least cost and audit of a conversation given as one sign a turn."""
    if len(turns) <= block:
        return short_repair(turns)
    cuts = range(0, len(turns), block)
    after = {cuts[-1]: END}
    for at in reversed(cuts):
        tables = Tables(turns[at:at + block], after[at], at == cuts[-1], (0, 1, 2, 3))
        before = tuple(tables.best(p) for p in range(4))
        if at:
            after[at - block] = before
    cost, phase, out = before[0], 0, []
    for at in cuts:
        part, phase = Tables(turns[at:at + block], after[at], at == cuts[-1], (phase,)).audit(phase)
        out.append(part)
    return cost, "".join(out)


# ------------------------------------------------------------------ Spark

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: the rows with the contract's damage; dropped rows stay with ``there`` false."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm").isin(0, 1), "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") != 0).alias("there"), F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def narrow(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest, there, role (first sign), blank, cut, again: what alignment needs of each row, no texts."""
    end = F.rtrim("text", F.lit(SPACES))
    return rows.select("conv_id", "turn", F.expr(MD5_ROLE).alias("digest"), "there", F.substring("role", 1, 1).alias("role"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))


def runs(batches, names: list[str]):
    """Consecutive rows of one conversation as lists of columns, a part at a time: (whether it begins, columns)."""
    current, started = None, False
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        ids = columns[0]
        at = 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            fresh = not started or ids[at] != current
            current, started = ids[at], True
            yield fresh, [c[at:end] for c in columns]
            at = end


ROLES = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}


class Found:
    """Counts and signs of one conversation, fed in order."""

    def __init__(self, conv_id):
        self.conv_id, self.signs, self.counts = conv_id, bytearray(), dict.fromkeys(FAULTS, 0)
        self.turns, self.least, self.most, self.before, self.role = 0, None, None, None, None

    def add(self, turn, there, role, blank, cut, again) -> None:
        if not there:
            return
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.before
            self.before = self.most = turn
        fault = "blank" if blank else "duplicate" if again else "truncated" if cut else None
        if fault:
            self.counts[fault] += 1
        if self.role is not None and self.role + role not in LEGAL:
            self.counts["illegal"] += 1
        self.role = role
        self.signs.append(ROLES.get(role, 3) | (MUST if fault in ("blank", "duplicate") else SHORT if fault else 0))

    def result(self) -> tuple:
        if self.least is not None:
            self.counts["gaps"] = self.most - self.least + 1 - self.turns
        self.counts["cost"], audit = repair(bytes(self.signs))
        return (self.conv_id, *self.counts.values(), audit)


def audited(batches):
    """One row per conversation from rows sorted by conversation and turn."""
    found, done, schema = None, [], None
    for fresh, (ids, *columns) in runs(batches, ["conv_id", "turn", "there", "role", "blank", "cut", "again"]):
        if fresh:
            if found:
                done.append(found.result())
            found = Found(ids[0])
        for row in zip(*columns):
            found.add(*row)
        if len(done) >= 1000:
            yield audit_batch(done)
            done = []
    if found:
        done.append(found.result())
    if done:
        yield audit_batch(done)


def audit_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), *[pa.array(c, pa.int64()) for c in columns[1:-1]], pa.array(columns[-1], pa.string())], ["conv_id", *FAULTS, "audit"])


class Digest:
    """SHA-256 of the repaired turns, fed in order behind their audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.phase, self.hash, self.first = audit, 0, 0, hashlib.sha256(), True

    def emit(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + role + ":" + text).encode())
        self.first = False
        self.phase = 1 if self.phase == 0 and role[:1] == "s" else 3 if self.phase == 2 else 2

    def wanted(self) -> str:
        return "assistant" if self.phase == 2 else "user"

    def inserted(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.emit(self.wanted(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.emit(role if edit == "K" else self.wanted(), text)

    def result(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def hashed(batches):
    """The audit rows with the digest of the turns that follow each."""
    names = ["conv_id", *FAULTS, "audit"]
    digest, head, done = None, None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.string()), pa.array(columns[8], pa.string())], [*names, "repaired_sha256"])

    for fresh, (ids, *columns) in runs(batches, [*names, "role", "text"]):
        rows = zip(*columns)
        if fresh:
            if digest:
                done.append((*head, digest.result()))
            first = next(rows)
            head, digest = (ids[0], *first[:7]), Digest(first[6])
        for row in rows:
            digest.add(row[7], row[8])
        if len(done) >= 1000:
            yield out()
            done.clear()
    if digest:
        done.append((*head, digest.result()))
    if done:
        yield out()


def repaired(conversations: DataFrame) -> DataFrame:
    """Audit of damage done to ``conversations`` (conv_id, turn, role, text): the columns of the contract, one row per conversation."""
    kind, turn_kind = conversations.schema["conv_id"].dataType.simpleString(), conversations.schema["turn"].dataType
    rows = damaged(conversations.select("conv_id", "turn", "role", "text"))
    light = narrow(rows).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "digest", "there").orderBy(F.col("turn").asc_nulls_first())) > 1
    light = light.withColumn("again", again).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "digest", "again")
    counts = ", ".join(f"{c} long" for c in FAULTS)
    audits = light.mapInArrow(audited, f"conv_id {kind}, {counts}, audit string")
    heads = audits.select("conv_id", F.lit(0).alias("behind"), F.lit(None).cast(turn_kind).alias("turn"), F.lit(None).cast("binary").alias("digest"), *FAULTS, "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    bodies = rows.where("there").select("conv_id", F.lit(1).alias("behind"), "turn", F.expr(MD5_ROLE).alias("digest"), *[F.lit(None).cast("long").alias(c) for c in FAULTS], F.lit(None).cast("string").alias("audit"), "role", "text")
    both = heads.union(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "behind", F.col("turn").asc_nulls_first(), "digest")
    return both.mapInArrow(hashed, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i::INT, 1))::BIGINT)), "
       "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")


def sql() -> str:
    """The same result by a recursion over the turns from the last one, with the least (cost, audit, repaired text) of each phase of the grammar."""
    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def way(cost: str, edit: str, of: str, line: str | None = None) -> str:
        text = f"{of}.t" if line is None else f"list_prepend({line}, {of}.t)"
        return f"struct_pack(c := {of}.c + {cost}, a := '{edit}' || {of}.a, t := {text})"

    none = "struct_pack(c := 1000000000::BIGINT, a := '', t := []::VARCHAR[])"
    row = {}
    for p, name, initial, after in ((0, "user", "u", "q2"), (1, "user", "u", "q2"), (2, "assistant", "a", "q3"), (3, "user", "u", "q2")):
        keep = f"CASE WHEN NOT must AND left(role, 1) = '{initial}' THEN {way('cut', 'K', after, chr(39) * 2 + ' || role || ' + chr(39) + ':' + chr(39) + ' || text')} ELSE {none} END"
        other = f"CASE WHEN NOT must THEN {way('cut + 3', 'R', after, chr(39) + name + ':' + chr(39) + ' || text')} ELSE {none} END"
        ways = [way("4", "D", f"q{p}"), keep, other]
        if p == 0:
            ways.append(f"CASE WHEN NOT must AND left(role, 1) = 's' THEN {way('cut', 'K', 'q1', 'role || ' + chr(39) + ':' + chr(39) + ' || text')} ELSE {none} END")
        row[p] = least(*ways)

    def closed() -> tuple[str, str, str]:
        """Insertions before what follows: at most two in a row are of use."""
        one = f"SELECT *, {least('w2', way('3', 'I', 'w3', chr(39) + 'assistant:' + chr(39)))} AS v2 FROM"
        two = ", ".join(f"{least(f'w{p}', way('3', 'I', 'v2', chr(39) + 'user:' + chr(39)))} AS v{p}" for p in (0, 1, 3))
        three = f"{least('v2', way('3', 'I', 'v3', chr(39) + 'assistant:' + chr(39)))} AS x2"
        return one, two, three

    one, two, three = closed()
    start = "struct_pack(c := {c}::BIGINT, a := '', t := []::VARCHAR[])"
    ends = ", ".join(f"{start.format(c=0 if p in (0, 3) else 1000000000)} AS w{p}" for p in range(4))
    steps = ", ".join(f"{row[p]} AS w{p}" for p in range(4))
    return f"""WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
harmed AS (SELECT *, {CRC} % 20 AS harm FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN harm = 3 THEN [1, 2] ELSE [1] END) AS copy FROM harmed WHERE harm <> 0),
ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text)) AS pos,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS trimmed FROM damaged),
faults AS (
  SELECT *, left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair,
    CASE WHEN trimmed = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM ordered),
turns AS (SELECT *, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS cut FROM faults),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate,
    count_if(fault = 't') AS truncated, count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS pos, {ends} FROM counts
  UNION ALL
  SELECT conv_id, pos, {steps} FROM (
    SELECT t.conv_id, t.pos - 1 AS pos, role, text, must, cut, v0 AS q0, v1 AS q1, x2 AS q2, v3 AS q3 FROM (
      SELECT *, {three} FROM (SELECT *, {two} FROM ({one} walk))) w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.pos = t.pos)),
best AS (SELECT conv_id, v0 FROM (SELECT *, {two} FROM ({one} walk)) WHERE pos = 0)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id"""
