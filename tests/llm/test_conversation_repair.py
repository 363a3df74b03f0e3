"""Conversation repair: the auction against a plain search, pieces against whole conversations, defined cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair as cr


def plain(codes: bytes) -> tuple[int, str]:
    """Cost and least audit by row-by-row search over all edits."""
    best = {0: (0, "")}

    def inserted(at):
        out = dict(at)
        for _ in range(3):
            for q, (c, a) in list(out.items()):
                new = (c + cr.INSERT, a + "I")
                if cr.NEXT[q] not in out or new < out[cr.NEXT[q]]:
                    out[cr.NEXT[q]] = new
        return out

    for code in codes:
        after = {}
        for q, (c, a) in inserted(best).items():
            for letter, taken, to, cost in cr.ARCS[code][q]:
                if taken and (to not in after or (c + cost, a + letter) < after[to]):
                    after[to] = (c + cost, a + letter)
        best = after
    ends = inserted(best)
    return min(ends[q] for q in (0, 3) if q in ends)


@pytest.mark.parametrize("seed", range(6))
def test_auction_equals_plain_search(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        codes = bytes(rnd.choices(range(16), weights=[rnd.random() ** 3 for _ in range(16)], k=rnd.randint(0, 24)))
        cost, audit = plain(codes)
        assert cr.settled(codes) == (cost, audit)
        # pieces composed backwards and traced on their own
        cuts = sorted(rnd.choices(range(len(codes) + 1), k=rnd.randint(0, 4)))
        pieces = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        due = [cr.END]
        for p in reversed(pieces[1:]):
            due.append(cr.composed(cr.least_costs(p), due[-1]))
        assert cr.composed(cr.least_costs(pieces[0]), due[-1])[0] == cost
        state, letters = 0, ""
        for p, after in zip(pieces, reversed(due), strict=True):
            more, state = cr.traced(p, after)[state]
            letters += more
        assert letters + "I" * (cr.END[state] // 3) == audit


def expected(rows: list[tuple]) -> dict:
    """conv_id -> result of rows (conv_id, turn, role, text) that were not damaged."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv), key=lambda r: (r[0], r[1], r[3], r[4]))
        roles, texts, turns = [r[3] for r in mine], [r[4] for r in mine], [r[2] for r in mine if r[2] is not None]
        seen, first = set(), []
        for pair in zip(roles, texts, strict=True):
            first.append(pair not in seen)
            seen.add(pair)
        codes = cr.codes_of(roles, texts, first)
        cost, audit = plain(codes)
        lines, state, i = [], 0, 0
        for letter in audit:
            if letter == "I":
                state = cr.NEXT[state]
                lines.append(cr.ROLE[state] + ":")
                continue
            if letter == "K":
                state = {"s": 1, "u": 2, "a": 3}[roles[i][0]]
                lines.append(f"{roles[i]}:{texts[i]}")
            elif letter == "R":
                state = cr.NEXT[state]
                lines.append(f"{cr.ROLE[state]}:{texts[i]}")
            i += 1
        faults = [c // 4 for c in codes]
        illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_long_and_odd_conversations(spark):
    rnd = random.Random(5)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range({3: 400, 7: 150}.get(conv, rnd.randint(1, 9))):
            text = rnd.choice(["Yes.", "no", "", " \t\n", f"t{turn}!", f"t{turn}", "same?", None, "é. \x0b"])
            rows.append((conv, rnd.choice([turn, turn, turn + 2, None]), rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "sys", "U"]), text))
    rows += [(20, 5, "user", "x.")] * 40 + [(21, 2, "system", "rules.")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int")
    want = expected(rows)
    for piece in (3, cr.PIECE):
        got = {r["conv_id"]: tuple(r[1:]) for r in cr.repair(table.repartition(5), piece=piece).collect()}
        assert got == want
    assert cr.repair(table.limit(0)).count() == 0


def test_damage_and_empty_conversations(spark):
    def fault(conv, turn):
        return zlib.crc32(f"{conv}:{turn}".encode()) % 20

    gone = next(c for c in range(10_000) if fault(c, 0) == 0)
    empty = hashlib.sha256(b"").hexdigest()
    row = cr.op12_conversation_repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    rows = [(c, t, "user", "A. b? c") for c in range(40) for t in range(3)] + [(41, None, "user", "Hi.")]
    kept = {(r["conv_id"], r["turn"]): [] for r in cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for r in cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where(F.col("alive")).collect():
        kept[r["conv_id"], r["turn"]].append(r["text"])
    for (c, t), texts in kept.items():
        f = fault(c, " " if t is None else t)
        text = "Hi." if t is None else "A. b? c"
        assert texts == {0: [], 1: [""], 2: [text.replace(".", "").replace("?", "")], 3: [text] * 2}.get(f, [text])
