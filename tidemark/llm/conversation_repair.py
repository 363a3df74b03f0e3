"""Conversation structure repair by an auction over the lattice of edits.

A conversation has the right structure if its role initials are an optional s and then one or more ua, or if it
has no turns. The lattice has a node for each row and state (0 nothing written, 1 after s, 2 after u, 3 after a),
and an arc for each edit: D deletes a row (4; blank and repeated rows must go), I inserts an empty turn (3), K keeps
a row (0) and R gives it the other role (3); truncated rows that stay cost 3 more. Costs are integers and every
cycle of inserts costs something, so the auction algorithm for shortest paths ends: a path from the entry is
extended along the arc of least cost plus price, or the price of its last node is raised and the path gives that
node up. When the path has reached the end, arcs whose cost is the difference of the prices of their ends are
tight; all cheapest repairs run on tight arcs only, and the first letter in ASCII order at each node spells the least
of them. An edit's letter decides the next state, so the letters alone tell the repaired conversation.

Rows are sorted by ranges of (conversation, turn, role, text), so a conversation of any length is spread over
partitions. Each is cut into pieces of at most 64 rows. Conversations inside one partition are settled there. Of
the others (long ones, and those at a partition's ends) every piece gets its 4 x 4 least costs by auction; these
are composed from the last piece to the first, one row at a time, which gives the prices at each piece's end;
then each piece is traced on its own from all four states, and a last pass in order picks the letters and takes the
hash, which by its nature reads the repaired texts one after the other. No step holds more than one piece's texts.

Defined cases: a null role or text is one space; null turns come first; a null conv_id is a conversation of its
own. Rows of one turn are in order of role, the text's first 64 characters and its hash. A conversation without
rows has zeros, an empty audit and the hash of the empty string. Turns need not be unique; rows that are equal count
as often as they come. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

PIECE = 64  # rows of a piece; an auction's steps grow with the square of it
WHITE = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE, STUMP = 4, 3, 3, 3  # fixed values: costs of edits, and of a truncated row that stays
NEXT = (2, 2, 3, 2)  # the state after the only turn, user or assistant, that may follow in each state
ROLE = {2: "user", 3: "assistant"}
KEEPS = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}  # (state, initial's class) -> state
CLASS = {"s": 1, "u": 2, "a": 3}
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
END = (0, 2 * INSERT, INSERT, 0)  # what is left to pay after the last row
INF = float("inf")


def row_arcs(code: int) -> list[list[tuple[str, int, int, int]]]:
    """The arcs of a row of this code in each state: letter, rows taken, next state, cost; in ASCII order."""
    cls, fault = code % 4, code // 4
    extra = STUMP * (fault == TRUNCATED)
    out = []
    for q in range(4):
        arcs = [("D", 1, q, DELETE), ("I", 0, NEXT[q], INSERT)]
        if fault not in (BLANK, DUPLICATE):
            arcs += [("K", 1, KEEPS.get((q, cls), 0), extra)] * ((q, cls) in KEEPS) + [("R", 1, NEXT[q], REROLE + extra)]
        out.append(arcs)
    return out


ARCS = [row_arcs(code) for code in range(16)]


class Piece:
    """The lattice of some rows (codes: class + 4 x fault). after: what is left to pay in each state behind them."""

    def __init__(self, codes: bytes, after: tuple[float, ...]):
        n = len(codes)
        self.sink = 4 * n + 4
        most = max(q for q in range(4) if after[q] < INF)
        most = 3 if most > 1 else most  # there is no way back from states 2 and 3 to 0 and 1, nor from 1 to 0
        self.arcs = [[(letter, 4 * (i + taken) + to, cost) for letter, taken, to, cost in ARCS[code][q] if to <= most] for i, code in enumerate(codes) for q in range(4)]
        self.arcs += [[("", self.sink, c)] if c < INF else [] for c in after]
        self.price = [0.0] * (self.sink + 1)

    def auction(self, entry: int) -> float:
        """The least cost from the entry state. Prices stay, and serve the next entry too."""
        arcs, price, sink = self.arcs, self.price, self.sink
        path = [entry]
        while (i := path[-1]) != sink:
            least, to = INF, -1
            for _, j, cost in arcs[i]:
                if cost + price[j] < least:
                    least, to = cost + price[j], j
            if price[i] < least:  # contract
                price[i] = least
                if len(path) > 1:
                    path.pop()
                elif least == INF:
                    return INF
            else:  # extend
                path.append(to)
        return price[entry]

    def trace(self, entry: int) -> tuple[str, int]:
        """The least letters on tight arcs from the entry to the end, and the state there; after auction(entry)."""
        arcs, price, sink = self.arcs, self.price, self.sink
        letters, path, lost = [], [entry], set()
        while path[-1] != sink:
            i = path[-1]
            for letter, j, cost in arcs[i]:
                if price[i] == cost + price[j] and j not in lost:
                    path.append(j)
                    letters.append(letter)
                    break
            else:  # tight arcs that lead nowhere: prices there stopped short of the true costs
                lost.add(path.pop())
                letters.pop()
        return "".join(letters), path[-2] % 4


def least_costs(codes: bytes) -> list[int]:
    """The 4 x 4 least costs from each state before the rows to each behind them; -1 where there is no way."""
    met = CLASS["s"] in {c % 4 for c in codes if c // 4 not in (BLANK, DUPLICATE)}
    out = [[-1] * 4 for _ in range(4)]
    for to in range(4):
        piece = Piece(codes, tuple(0 if q == to else INF for q in range(4)))
        for q in range(4):
            if not codes:
                out[q][to] = 0 if q == to else -1
            elif to > 1 or q == to or (q, to, met) == (0, 1, True):
                out[q][to] = int(piece.auction(q))
    return [c for row in out for c in row]


def composed(costs: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    """What is left to pay before a piece, from its least costs and what is left behind it."""
    return tuple(min(costs[4 * q + r] + after[r] for r in range(4) if costs[4 * q + r] >= 0) for q in range(4))


def traced(codes: bytes, after: tuple[int, ...]) -> list[tuple[str, int]]:
    """For each entry state the letters of the least cheapest repair and the state behind the rows."""
    piece = Piece(codes, after)
    for q in range(4):
        piece.auction(q)
    return [piece.trace(q) for q in range(4)]


def settled(codes: bytes) -> tuple[int, str]:
    """Cost and letters of a whole conversation, piece by piece from the last."""
    after: tuple[int, ...] = END
    found = []
    for a in reversed(range(0, len(codes), PIECE)):
        piece = Piece(codes[a : a + PIECE], after)
        after = tuple(int(piece.auction(q)) for q in range(4 if a else 1))
        found.append(piece)
    state, letters = 0, []
    for piece in reversed(found):
        more, state = piece.trace(state)
        letters.append(more)
    return after[0] if found else 0, "".join(letters) + "I" * (END[state] // INSERT)


def edited(letters: str, state: int, rows) -> tuple[list[str], int]:
    """The turns that the letters make of the rows (role, text), and the state behind them."""
    out, rows = [], iter(rows)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        state = KEEPS[state, CLASS[role[0]]] if letter == "K" else NEXT[state]
        out.append(f"{role if letter == 'K' else ROLE[state]}:{text}")
    return out, state


class Tally:
    """What a conversation counts of its rows, fed in order."""

    def __init__(self):
        self.turns, self.low, self.high, self.last = 0, None, None, None
        self.faults, self.illegal, self.initial = [0] * 4, 0, None

    def add(self, turns, roles, codes: bytes) -> None:
        for turn, role, code in zip(turns, roles, codes, strict=True):
            if turn is not None and turn != self.last:
                self.turns += 1
                self.last = self.high = turn
                self.low = turn if self.low is None else self.low
            self.faults[code // 4] += 1
            if self.initial is not None and (self.initial, role[:1]) not in {("s", "u"), ("u", "a"), ("a", "u")}:
                self.illegal += 1
            self.initial = role[:1]

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal}


def codes_of(roles, texts, first) -> bytes:
    """first: whether each row is the first with its role and text."""
    out = bytearray()
    for role, text, new in zip(roles, texts, first, strict=True):
        body = text.rstrip(WHITE)
        fault = BLANK if not body else DUPLICATE if not new else OK if body[-1] in ".!?" else TRUNCATED
        out.append(CLASS.get(role[:1], 0) + 4 * fault)
    return bytes(out)


def damaged(turns: DataFrame) -> DataFrame:
    """The damage that the query asks for: conv_id, turn, role, text and alive; dropped rows stay as rows not alive, so
    that no conversation is lost."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_f"))
    f = F.col("_f")
    text = F.when(f == 0, F.lit(None)).when(f == 1, "").when(f == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(f == 0, F.lit(None)).when(f == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(f == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (f != 0).alias("alive"), copies.alias("_copy")).drop("_copy")


ORDER = ["conv_id", "turn", "role", "_head", "_hash", "_row"]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows of sorted batches by equal keys; a group's rows must be read before the next group."""
    rows = (r for batch in batches for piece in range(0, batch.num_rows, 256) for r in batch.slice(piece, 256).to_pylist())
    held = next(rows, None)

    def group(k):
        nonlocal held
        while held is not None and held[key] == k:
            yield held
            held = next(rows, None)

    while held is not None:
        k = held[key]
        g = group(k)
        yield k, g
        for _ in g:
            pass


def settle(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition: a row for each conversation that lies inside it, pieces of at most so many rows of
    the others."""
    pid, seq = TaskContext.get().partitionId(), 0
    known: dict[bytes, tuple[int, str]] = {}
    out: list[dict] = []
    size = 0

    def pieces(rows: Iterator[dict]) -> Iterator[list[dict]]:
        piece, held = [], 0
        for r in rows:
            if r["alive"]:
                piece.append(r)
                held += len(r["text"])
                if len(piece) == most or held > 8 << 20:
                    yield piece
                    piece, held = [], 0
        yield piece

    def part(conv, rows: list[dict]) -> dict:
        nonlocal seq
        seq += 1
        return {"conv_id": conv, "done": False, "part": (pid << 40) + seq, "turns": [r["turn"] for r in rows], "roles": [r["role"] for r in rows], "texts": [r["text"] for r in rows]}

    def whole(conv, rows: list[dict]) -> dict:
        roles, texts, seen, first = [r["role"] for r in rows], [r["text"] for r in rows], set(), []
        for pair in zip(roles, texts, strict=True):
            first.append(pair not in seen)
            seen.add(pair)
        codes = codes_of(roles, texts, first)
        if codes not in known:
            if len(known) > 100_000:
                known.clear()
            known[codes] = settled(codes)
        cost, audit = known[codes]
        tally = Tally()
        tally.add([r["turn"] for r in rows], roles, codes)
        turns, _ = edited(audit, 0, zip(roles, texts, strict=True))
        digest = hashlib.sha256("\n".join(turns).encode()).hexdigest()
        return {"conv_id": conv, "done": True, **tally.row(), "cost": cost, "audit": audit, "repaired_sha256": digest}

    def flushed() -> pa.RecordBatch:
        nonlocal size
        table = pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", key), ("done", pa.bool_()), *zip(NAMES, TYPES, strict=True), ("part", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]))
        out.clear()
        size = 0
        return table

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal key
        for b in batches:
            key = b.schema.field("conv_id").type
            yield b

    key = pa.int64()
    start, held = True, None  # held: the last conversation's first piece, whose end is not known yet
    for conv, rows in groups(typed(), "conv_id"):
        if held is not None:  # another conversation follows, so it is whole
            out.append(whole(*held))
            held = None
        for piece in pieces(rows):
            if held is not None:
                out.append(part(*held))
                held = None
                start = True  # its other pieces are pieces as well
            if start or len(piece) == most:
                out.append(part(conv, piece))
                start = True
            else:
                held = (conv, piece)
            size += sum(len(r["text"]) for r in piece)
            if len(out) > 2000 or size > 16 << 20:
                yield flushed()
        start = False
    if held is not None:
        out.append(part(*held))
    if out:
        yield flushed()


def frame(rows: list[dict], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(columns))


def joined_parts(parts: DataFrame, key: str) -> DataFrame:
    """Pieces of conversations that no partition holds whole: composed backwards, traced, put together."""
    places = parts.select("conv_id", "part", F.posexplode(F.arrays_zip("roles", F.transform("texts", lambda t: F.sha2(t, 256)).alias("digest"))).alias("i", "x"))
    place = F.struct("part", "i")
    first = places.groupBy("conv_id", "x").agg(F.min(place).alias("at")).groupBy(F.col("at.part").alias("_part")).agg(F.collect_list("at.i").alias("first"))
    met = parts.join(first, F.col("part") == F.col("_part"), "left").drop("_part")

    def price(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                new = set(r["first"] or ())
                codes = codes_of(r["roles"], r["texts"], [i in new for i in range(len(r["roles"]))])
                rows.append({k: r[k] for k in ("conv_id", "part", "turns", "roles", "texts")} | {"codes": codes, "costs": least_costs(codes)})
            yield frame(rows, [("conv_id", batch.schema.field("conv_id").type), ("part", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("codes", pa.binary()), ("costs", pa.list_(pa.int32()))])

    priced = staged(met.mapInArrow(price, f"conv_id {key}, part long, turns array<long>, roles array<string>, texts array<string>, codes binary, costs array<int>"))

    def backwards(batches):
        for _, rows in groups(batches, "conv_id"):
            after, out = END, []
            for r in rows:
                out.append({"_part": r["part"], "after": list(after)})
                after = composed(r["costs"], after)
                if len(out) == 4096:
                    yield frame(out, [("_part", pa.int64()), ("after", pa.list_(pa.int32()))])
                    out = []
            yield frame(out, [("_part", pa.int64()), ("after", pa.list_(pa.int32()))])

    due = priced.select("conv_id", "part", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part")).mapInArrow(backwards, "_part long, after array<int>")

    def ways(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows.append({k: r[k] for k in ("conv_id", "part", "turns", "roles", "texts", "codes", "after")} | {"ways": [{"letters": a, "state": q} for a, q in traced(r["codes"], tuple(r["after"]))], "left": composed(r["costs"], tuple(r["after"]))[0]})
            yield frame(rows, [("conv_id", batch.schema.field("conv_id").type), ("part", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("codes", pa.binary()), ("after", pa.list_(pa.int32())), ("ways", pa.list_(pa.struct([("letters", pa.string()), ("state", pa.int32())]))), ("left", pa.int64())])

    known = priced.join(due, F.col("part") == F.col("_part")).drop("_part").mapInArrow(ways, f"conv_id {key}, part long, turns array<long>, roles array<string>, texts array<string>, codes binary, after array<int>, ways array<struct<letters: string, state: int>>, left long")

    def put_together(batches):
        for conv, rows in groups(batches, "conv_id"):
            tally, digest, state, audit, cost, some = Tally(), hashlib.sha256(), 0, [], None, False
            for r in rows:
                cost = r["left"] if cost is None else cost
                tally.add(r["turns"], r["roles"], r["codes"])
                way = r["ways"][state]
                turns, state = edited(way["letters"], state, zip(r["roles"], r["texts"], strict=True))
                audit.append(way["letters"])
                for t in turns:
                    digest.update(("\n" * some + t).encode())
                    some = True
            rest = "I" * (END[state] // INSERT)
            for t in edited(rest, state, ())[0]:
                digest.update(("\n" * some + t).encode())
                some = True
            row = {"conv_id": conv, **tally.row(), "cost": cost, "audit": "".join(audit) + rest, "repaired_sha256": digest.hexdigest()}
            yield frame([row], [("conv_id", KEY_TYPES.get(key, pa.int64())), *zip(NAMES, TYPES, strict=True)])

    return known.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(put_together, f"conv_id {key}, {RESULT}")


KEY_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def repair(rows: DataFrame, alive: Column | None = None, *, piece: int = PIECE) -> DataFrame:
    """conv_id and the columns of RESULT for every conversation of rows (conv_id, turn, role, text); rows that are not
    alive count only as a mention of their conversation."""
    key = rows.schema["conv_id"].dataType.simpleString()
    if key not in KEY_TYPES:
        raise ValueError("conv_id must be a whole number or a string")
    some = F.lit(True) if alive is None else alive
    space = lambda c: F.when(some, F.coalesce(c, F.lit(" ")))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), some.alias("alive"))
    rows = rows.select("*", F.substring("text", 1, 64).alias("_head"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    spread = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    found = staged(spread.mapInArrow(lambda batches: settle(batches, piece), f"conv_id {key}, done boolean, {RESULT}, part long, turns array<long>, roles array<string>, texts array<string>"))
    rest = joined_parts(found.where("not done").select("conv_id", "part", "turns", "roles", "texts"), key)
    return found.where("done").select("conv_id", *NAMES).unionByName(rest)


def op12_conversation_repair(turns: DataFrame) -> DataFrame:
    return repair(damaged(turns), F.col("alive"))


OP12_SQL = """WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS k FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: cast(ascii(substr(k, i, 1)) AS BIGINT))),
  lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, s: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS f FROM c),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n.n
  FROM h JOIN (VALUES (1), (2)) AS n(n) ON n.n = 1 OR f = 3 WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
r AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS was,
  CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (was IS NOT NULL AND was || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
ins(q, p, cost, letters, turns) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
  (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
step(p, t, letter, ini) AS (VALUES (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'), (0, 2, 'R', ''), (1, 2, 'R', ''), (3, 2, 'R', ''), (2, 3, 'R', '')),
w(conv_id, i, q, cost, audit, turns) AS (SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM g
  UNION ALL SELECT conv_id, i, q, b.cost, b.audit, b.turns FROM (SELECT w.conv_id, r.i, s.t AS q, min({'cost': w.cost + e.cost + CASE s.letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN r.fault = 3 AND s.letter <> 'D' THEN 3 ELSE 0 END,
      'audit': w.audit || e.letters || s.letter, 'turns': list_concat(w.turns, e.turns, CASE s.letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE s.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END)}) AS b
    FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN ins e ON e.q = w.q JOIN step s ON s.p = e.p AND (s.letter <> 'K' OR s.ini = r.ini) AND (s.letter = 'D' OR r.fault NOT IN (1, 2)) GROUP BY w.conv_id, r.i, s.t)),
z AS (SELECT g.conv_id, min({'cost': w.cost + e.cost, 'audit': w.audit || e.letters, 'turns': list_concat(w.turns, e.turns)}) AS b FROM g JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.i = g.n JOIN ins e ON e.q = w.q AND e.p IN (0, 3) GROUP BY g.conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cast(coalesce(z.b.cost, 0) AS bigint) AS cost, coalesce(z.b.audit, '') AS audit,
  sha256(coalesce(array_to_string(z.b.turns, chr(10)), '')) AS repaired_sha256 FROM a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""
