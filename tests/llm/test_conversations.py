"""Repair of conversations against plain relaxation over the whole lattice."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest

from polybag.llm import op13_conversations as op
from polybag.llm.catalog import QUERIES
from polybag.llm.common import table

ROWS = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def plain(initials, faults):
    """Row by row, all states at once; inserts until nothing gets better."""
    step = {"0s": "s", "0u": "u", "su": "u", "ua": "a", "au": "u"}

    def relax(at, state, route):
        if state not in at or route < at[state]:
            at[state] = route
            return True
        return False

    def closed(at):
        queue = list(at)
        while queue:
            s = queue.pop()
            for t in "ua":
                n = step.get(s + t)
                if n and relax(at, n, (at[s][0] + 5, at[s][1] + "I")):
                    queue.append(n)
        return at

    at = closed({"0": (0, "")})
    for initial, fault in zip(initials, faults):
        after = {}
        for s, (cost, audit) in at.items():
            relax(after, s, (cost + 2, audit + "D"))
            if fault in "bd":
                continue
            more = 5 * (fault == "t")
            if s + initial in step:
                relax(after, step[s + initial], (cost + more, audit + "K"))
            for t in "ua":
                if s + t in step:
                    relax(after, step[s + t], (cost + more + 1, audit + "R"))
        at = closed(after)
    return min(at[s] for s in "0a" if s in at)


def test_search_against_plain_relaxation():
    for n in range(5):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product("kbt", repeat=n) if n < 4 else ["kkkk", "ktkb", "tkdt"]:
                row = "".join(initials), "".join(faults)
                assert op.cheapest(*row) == plain(*row)
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(5, 60)
        row = "".join(rng.choices("suax", [1, 4, 4, 1], k=n)), "".join(rng.choices("kbdt", [6, 1, 1, 2], k=n))
        assert op.cheapest(*row) == plain(*row)


def test_pieces_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 40)
        initials, faults = "".join(rng.choices("suax", k=n)), "".join(rng.choices("kbdt", [6, 1, 1, 2], k=n))
        cuts = [0, *sorted(rng.choices(range(n + 1), k=3)), n]
        pieces = [op.routes(initials[a:b], faults[a:b]) for a, b in itertools.pairwise(cuts)]
        assert op.joined(pieces) == plain(initials, faults)


def brute(rows):
    """Everything the digest returns, from the rows before damage."""
    out, groups = [], defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        group = groups[conv]
        if fault == 1:
            text = ""
        elif fault == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        elif fault == 4:
            role = "user"
        group += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), ""
        for _, role, text in group:
            kept = text.strip(WHITE)
            faults += "b" if not kept else "d" if (role, text) in seen else "t" if kept[-1] not in ".!?" else "k"
            seen.add((role, text))
        roles = [r[1] for r in group]
        initials = "".join(r[0] if r[:1] in ("s", "u", "a") else "x" for r in roles)
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
        cost, audit = plain(initials, faults)
        lines, rest = [], iter(group)
        for edit in audit:
            row = next(rest) if edit != "I" else None
            if edit == "K":
                lines.append(f"{row[1]}:{row[2]}")
            elif edit != "D":
                role = "assistant" if lines and lines[-1][0] == "u" else "user"
                lines.append(f"{role}:{row[2] if row else ''}")
        turns = {r[0] for r in group if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_digest_of_the_test_conversations(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversations"](spark, sf_dir)
    assert found(got) == brute(rows)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] * 2


@pytest.mark.parametrize("piece", [3, op.PIECE])
def test_awkward_conversations(spark, piece):
    rng = random.Random(8)
    texts = ["Yes.", "No!", " ", "", None, "open", "open \n", " ", "Ünï? ", "z" * 20_000 + ".", "..", "a\nb."]
    roles = ["user", "assistant", "system", None, "", "usher", "User", "tool"]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, -6]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts))
            for _ in range(150)]
    rows += rows[:20] + [(77, t, rng.choice(roles[:3]), f"Turn {t}.") for t in range(0, 120, 3)]
    rows += [(100 + i, i, "user", "Alone.") for i in range(60)]  # some of these are dropped
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS role2", "1 AS piece", "'y' AS audit", "2 AS at")
    assert found(op.repaired(op.damaged(df), piece)) == brute(rows)


def test_no_conversations_and_undamaged_ones(spark):
    none = spark.createDataFrame([], ROWS)
    assert op.repair_digest(none).count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, 0, "assistant", "Alone.")]
    got = {r.conv_id: r for r in op.repaired(op.intact(spark.createDataFrame(rows, ROWS))).collect()}
    assert (got[1].cost, got[1].audit, got[2].cost, got[2].audit) == (0, "KK", 2, "D")
    assert got[1].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Hello.").hexdigest()
