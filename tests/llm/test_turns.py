import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelweave.llm import turns
from labelweave.llm.turns import Repair, fault_of, repair, repaired_conversations

from .helpers import rows_of

TEXTS = st.sampled_from(["a.", "b!", "c", "", "  \n", "d?"])
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "U", " "])
ROW = st.tuples(ROLES, TEXTS)


def legal(roles):
    initials = [r[:1] for r in roles]
    if initials[:1] == ["s"]:
        initials = initials[1:]
        if not initials:
            return False
    return initials == ["u", "a"] * (len(initials) // 2)


def cheapest(rows):
    """Every way to edit ``(role, text, fault)`` rows, two inserts in a gap included."""
    ways = [(0, "", ())]

    def with_inserts(ways):
        for _ in range(3):
            yield from ways
            ways = [
                (c + 5, a + "I", (*t, (r, ""))) for c, a, t in ways for r in ("user", "assistant")
            ]

    for role, text, fault in rows:
        after = []
        for c, a, t in with_inserts(ways):
            after.append((c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            if role[:1] in set("sua"):
                after.append((c + extra, a + "K", (*t, (role, text))))
            after += [(c + 1 + extra, a + "R", (*t, (r, text))) for r in ("user", "assistant")]
        # The legal ones begin legally, which keeps the number of ways small.
        ways = [w for w in after if begins_legally([r for r, _ in w[2]])]
    return min(w for w in with_inserts(ways) if legal([r for r, _ in w[2]]))


def begins_legally(roles):
    initials = "".join(r[:1] or "?" for r in roles)
    body = initials.removeprefix("s")
    return body == ("ua" * len(body))[: len(body)]


def plain(rows):
    """Counts, cost, audit and hash of ``(turn, role, text)`` rows in order."""
    seen, faults = set(), []
    for turn, role, text in rows:
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = zip(rows, rows[1:], strict=False)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
    cost, audit, left = viterbi([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest()
    kinds = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return gaps, *kinds, illegal, cost, audit, digest


def viterbi(rows):
    """The least ``(cost, audit, turns)``, with whole audits in every state."""
    following = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def spread(best):
        found = dict(best)
        for place, (c, a, t) in best.items():
            for i in following[place]:
                if i != "s":
                    offer(found, i, (c + 5, a + "I", (*t, (name[i], ""))))
        return found

    def offer(found, place, way):
        if place not in found or way < found[place]:
            found[place] = way

    for role, text, fault in rows:
        after = {}
        for place, (c, a, t) in spread(best).items():
            offer(after, place, (c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            for i in following[place]:
                if role[:1] == i:
                    offer(after, i, (c + extra, a + "K", (*t, (role, text))))
                elif i != "s":
                    offer(after, i, (c + 1 + extra, a + "R", (*t, (name[i], text))))
        best = after
    return min(v for k, v in spread(best).items() if k in ("", "a"))


def searched(rows):
    search, edits = Repair(), []
    for row in rows:
        edits += search.add(*row)
    edits += search.finish()
    audit = "".join(e for e, _, _ in edits)
    return search.cost, audit, tuple((r, t) for _, r, t in edits if r is not None)


def marked(rows):
    seen, out = set(), []
    for role, text in rows:
        out.append((role, text, fault_of(text, (role, text) in seen)))
        seen.add((role, text))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(ROW, max_size=4))
def test_all_ways_of_editing(rows):
    assert searched(marked(rows)) == viterbi(marked(rows)) == cheapest(marked(rows))


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=40))
def test_long_conversations(rows):
    rows = [(r, f"{k}{x}" if x.strip() else x) for k, (r, x) in enumerate(rows)]
    assert searched(marked(rows)) == viterbi(marked(rows))


def test_little_is_held_while_a_conversation_passes(monkeypatch):
    monkeypatch.setattr(turns, "_SPOOL_BYTES", 1000)
    search, deepest, stored, settled = Repair(), 0, 0, 0
    for k in range(5000):
        settled += len(list(search.add("user" if k % 2 == 0 else "assistant", f"{k}" * 20 + ".", None)))
        deepest = max(deepest, max(n.depth for _, n in search.alive.values()) - search.root.depth)
        stored = max(stored, search.spool.seek(0, 2))
    assert deepest < 10 and stored < 5000 and settled > 4990
    assert len(list(search.finish())) + settled == 5000 and search.cost == 0


def test_ties_open_until_the_end():
    # All of one role: which row goes is known only with the last one.
    rows = [("user", f"{k}.", None) for k in range(301)]
    cost, audit, _ = searched(rows)
    assert (cost, audit) == viterbi(rows)[:2] and audit.startswith("DKR")
    assert searched(rows[:-1])[1].startswith("KRKR")


def odd_rows():
    rows = [
        (1, 0, "system", "S."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."),
        (2, None, None, None), (2, None, "user", "x."), (2, 5, "user", "x."), (2, 9, "assistant", "y"),
        (None, 1, "user", "no id."), (None, 2, "assistant", "no id!"), (None, None, "user", "n."),
        (3, 1, "user", "tie b."), (3, 1, "user", "tie a."), (3, 1, "assistant", "tie a."),
        (3, 1, "user", "tie a."), (4, 2**62, "user", ""), (4, -(2**62), "user", "é." * 50_000),
    ]
    rows += [(10 + c, t, ("user", "assistant", "system", "tool")[(c * t + t) % 4], f"{c % 3} {t % 5}" + ".! "[t % 3])
             for c in range(60) for t in range(c % 12)]
    return rows


def plain_damage(rows):
    by_id = {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kept = by_id.setdefault(conv, [])
        chance = zlib.crc32(name.encode()) % 20
        if chance == 1:
            text = ""
        if chance == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if chance == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if chance == 0 else 2 if chance == 3 else 1)
    return {
        c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in by_id.items()
    }


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_damaged_conversations_of_all_kinds(spark):
    rows = odd_rows()
    table = spark.createDataFrame(
        [(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, seen string"
    )
    wanted = sorted(((c, *plain(r)) for c, r in plain_damage(rows).items()), key=repr)
    assert rows_of(repaired_conversations(table), *COLUMNS) == wanted
    assert repaired_conversations(table.limit(0)).count() == 0


def test_the_query_over_its_table(spark):
    from labelweave.llm.queries import op11_turn_repair

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    wanted = sorted(((c, *plain(r)) for c, r in plain_damage(rows).items()), key=repr)
    assert rows_of(op11_turn_repair(spark, folder), *COLUMNS) == wanted


@pytest.mark.parametrize("empty", [True, False])
def test_edits_leave_a_legal_conversation(spark, empty):
    table = spark.createDataFrame(odd_rows(), "conv_id long, turn long, role string, text string")
    edits = repair(table.limit(0) if empty else table).collect()
    left = {}
    for e in sorted(edits, key=lambda e: (repr(e.conv_id), e.place)):
        left.setdefault(e.conv_id, []).append(e)
        assert (e.role is None) == (e.text is None) == (e.edit == "D")
    assert bool(left) != empty
    for found in left.values():
        assert [e.place for e in found] == list(range(len(found)))
        roles = [e.role for e in found if e.role is not None]
        assert not roles or legal(roles)
