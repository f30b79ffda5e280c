"""Repair of conversations: letters against a search over all edits, whole results against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from strandfold.llm import turns as tt


def brute(rows):
    """Every edit of every row, with none to two Inserts before each and at the end, by (cost, letters)."""
    best = None
    choices = [[("D", 4)] + ([] if unfit else [("K", 3 * cut), ("R", 3 + 3 * cut)]) for _, unfit, cut in rows]
    for edits in itertools.product(*choices):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost = sum(c for _, c in edits) + 3 * sum(gaps)
            if best and cost > best[0]:
                continue
            letters = "".join("I" * g + e for g, (e, _) in zip(gaps, edits, strict=False)) + "I" * gaps[-1]
            shape, i = [], 0
            for x in letters:
                shape += ["?"] if x in "IR" else [rows[i][0] or "-"] if x == "K" else []
                i += x != "I"
            even = "".join(shape)
            fits = any(all(a in ("?", b) for a, b in zip(even[k:], "ua" * len(even), strict=False)) and len(even[k:]) % 2 == 0 and (len(even) > k or not k) for k in ((0, 1) if even[:1] == "s" else (0,)))
            if fits and (best is None or (cost, letters) < best):
                best = (cost, letters)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_letters_equal_a_search_over_all_edits(seed):
    draw = random.Random(seed)
    for n in (0, 1, 2, 2, 2, 3, 3, 3, 3, 4):
        rows = [(draw.choice(["u", "a", "s", "u", "a", "t", ""]), draw.random() < 0.15, draw.random() < 0.3) for _ in range(n)]
        assert tt.cheapest_repair(rows) == brute(rows), rows


def by_text(rows):
    """The same minimum over letters as text."""
    live = {("", 0): (0, "")}

    def add(out, node, value):
        out[node] = min(out.get(node, value), value)

    def insert(live):
        for _ in range(3):
            out = dict(live)
            for (g, t), (c, text) in live.items():
                for x in tt.NEXT[g] - {"s"}:
                    add(out, (x, t + 1), (c + 3, text + "I"))
            live = out
        return live

    for initial, unfit, cut in rows:
        out = {}
        for (g, t), (c, text) in insert(live).items():
            add(out, (g, t + 1), (c + 4, text + "D"))
            if not unfit:
                if initial in tt.NEXT[g]:
                    add(out, (initial, t + 1), (c + 3 * cut, text + "K"))
                for x in tt.NEXT[g] - {"s"}:
                    add(out, (x, t + 1), (c + 3 + 3 * cut, text + "R"))
        live = out
    return min(v for (g, _), v in insert(live).items() if g in tt.ENDS)


def test_long_conversations_keep_short_weights():
    draw = random.Random(8)
    rows = [(draw.choice("uaaus"), draw.random() < 0.1, draw.random() < 0.2) for _ in range(90)]
    assert tt.cheapest_repair(rows) == by_text(rows)
    many = tt.Frontier()
    for _ in range(20_000):
        many.row(draw.choice("uaaus"), draw.random() < 0.1, draw.random() < 0.2)
    cost, letters = many.answer()
    assert many.width <= 8 * tt.WIDTH and len(letters) >= 20_000 and cost > 0
    never = tt.Frontier()
    for i in range(300):
        never.row("ua"[i % 2], False, False)
    assert never.answer() == (0, "K" * 300)


def plain_result(rows):
    """The whole result for (conv_id, turn, role, text), after damage."""
    damaged = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = damaged.setdefault(conv, [])
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, own in damaged.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = by_text([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults, strict=True)])
        left, kept, after = iter(own), [], ""
        for x in audit:
            row = next(left) if x != "I" else None
            if x != "D":
                after = row[1][:1] if x == "K" else "a" if after == "u" else "u"
                kept.append(f"{row[1] if x == 'K' else tt.ROLES[after]}:{row[2] if row else ''}")
        turns = [r[0] for r in own if r[0] is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest(),
        )
    return out


def conversations(seed):
    draw, rows = random.Random(seed), []
    for conv in [None, *range(60)]:
        for i in range(draw.randrange(1, 9)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "üser"])
            rows.append((conv, draw.choice([i, i, i + draw.randrange(3), None]), role, draw.choice(["Yes.", "No!", "ok", " \t\n", "", None, f"what {i}?  ", "é. x", "a\nb."])))
    return rows + [(99, 1, "user", "Hi."), (99, 1, "user", "Hi."), *[(100, i, ("user", "assistant")[i % 2], f"Turn {i}." * 50) for i in range(400)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_results_equal_plain_python(spark, seed):
    rows = conversations(seed)
    given = tt.plain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("text", "Words"), text="Words")
    damaged = tt.damage(given)
    found = tt.diagnose(given.select("conv_id").distinct(), damaged)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in tt.digests(found, damaged).collect()}
    got = {r["conv_id"]: (*list(r)[1:], hashes[r["conv_id"]]) for r in found.collect()}
    want = plain_result(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_repaired_rows_and_empty_tables(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 2, "user", "Why?"), (1, 1, "user", " "), (2, 0, "system", "Be kind."), (2, 1, "user", "Hm?"), (2, 2, "assistant", "Well."), (3, 0, "user", "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, head string, audit int")
    got = sorted((r["conv_id"], r["position"], r["role"], r["text"], r["edit"]) for r in tt.repair(docs).collect())
    assert got == [(1, 0, "user", "", "I"), (1, 1, "assistant", "Hello.", "K"), (1, 2, "user", "Why?", "K"), (1, 3, "assistant", "", "I"), (2, 0, "system", "Be kind.", "K"), (2, 1, "user", "Hm?", "K"), (2, 2, "assistant", "Well.", "K")]
    shape = {c: "".join(r[2][0] for r in got if r[0] == c) for c in (1, 2)}
    assert all(re.fullmatch("(s?(ua)+)?", s) for s in shape.values()) and not [r for r in got if r[0] == 3]
    assert tt.repair(docs.limit(0)).count() == 0
