import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from llm_rows import as_tuples

from lorespan.llm import structure_repair as sr
from lorespan.llm.oracle import ORACLE

SCHEMA = "conv_id long, turn long, role string, text string, conv string, key string, place string, kind string, edits string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "k", "p", "d", "e") for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Least cost, then least audit string, by plain strings per last initial of the output."""
    best = {"": (0, "", [])}

    def offer(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = cost, audit, out

    def inserted(live):
        live = dict(live)
        for _ in range(2):
            for state, (cost, audit, out) in list(live.items()):
                role = "assistant" if state == "u" else "user"
                offer(live, role[0], cost + 3, audit + "I", [*out, (role, "")])
        return live

    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, out) in inserted(best).items():
            offer(after, state, cost + 4, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more, x = 3 * (fault == "truncated"), role[:1]
                if x == "s" and state == "" or x == "u" and state != "u" or x == "a" and state == "u":
                    offer(after, x, cost + more, audit + "K", [*out, (role, text)])
                new = "assistant" if state == "u" else "user"
                offer(after, new[0], cost + 3 + more, audit + "R", [*out, (new, text)])
        best = after
    ends = [x for state, x in inserted(best).items() if state in ("", "a")]
    return min(ends, key=lambda x: x[:2])


def brute(rows, damage=True):
    found = []
    after = damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            said = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, out = cheapest([(role, text, f) for (_, role, text), f in zip(own, faults, strict=True)])
        repaired = "\n".join(f"{r}:{x}" for r, x in out)
        found.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()))
    return sorted(found, key=repr)


ROLES = ["user", "assistant", "system", "tool", "", None, "ux", "s"]
TEXTS = ["Yes.", "No", "What? ", "", " \n\t", None, "a.b", "end!\r\n", "1 ", "é."]


def conversations(seed=5):
    rng = random.Random(seed)
    rows = []
    for c in range(-5, 60):
        roles = ROLES if c % 2 else ["user", "assistant"]
        rows += [(c, rng.choice([t, t * 2, None, 7]) if c % 5 == 0 else t, rng.choice(roles), rng.choice(TEXTS) if c % 3 else f"{rng.random()}.") for t in range(rng.randrange(1, 9))]
    rows += [(100, t, rng.choice(ROLES[:4]), rng.choice([f"{rng.random()}", f"{rng.random()}.", *TEXTS])) for t in range(400)]
    rows += [(101, 3, "user", "same."), (101, 3, "user", "same."), (101, 3, "assistant", "same."), (None, 1, "user", "a."), (None, None, "assistant", None), (102, 0, "user", "word " * 40_000)]
    return rows


@pytest.fixture(scope="module")
def wanted():
    return brute(conversations())


def test_equals_brute_force(spark, wanted):
    found = sr.repair(table(spark, conversations()))
    assert found.columns == COLUMNS
    assert as_tuples(found) == wanted


def test_segments_and_partitions_do_not_show(spark, wanted, monkeypatch):
    monkeypatch.setattr(sr, "SEGMENT_BITS", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert as_tuples(sr.repair(table(spark, conversations()).repartition(5))) == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_as_they_are(spark):
    assert as_tuples(sr.repair(table(spark, conversations(6)), damage=False)) == brute(conversations(6), damage=False)


def audits(edits):
    root = sr.Edit()
    out = []
    for text in edits:
        node = root
        for char in text:
            node = sr.Edit(node, char)
        out.append(node)
    return out


@pytest.mark.parametrize("prime", [sr.HASH_PRIME, 1, 3])
def test_audits_compare_as_strings_whatever_the_hash(monkeypatch, prime):
    monkeypatch.setattr(sr, "HASH_PRIME", prime)
    rng = random.Random(2)
    texts = ["".join(rng.choice("DK") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += [t + x for t in texts[:20] for x in "DIK"]
    nodes = audits(texts)
    for (a, x), (b, y) in itertools.product(zip(texts, nodes, strict=True), repeat=2):
        assert sr.less(x, y) == (a < b), (a, b)
        assert str(x) == a


def test_paths_equal_all_audits_tried():
    rng = random.Random(4)
    for _ in range(200):
        rows = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 7))]
        names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
        cost, audit, _ = cheapest([(x, "t", names[f]) for x, f in rows])
        live = sr._with_inserts(sr.best_paths(rows, sr.EMPTY))
        assert min((c, str(e)) for s, (c, e) in live.items() if s in (sr.EMPTY, sr.ASSISTANT)) == (cost, audit)


def tried(rows):
    """Every audit of at most two inserts a gap, by the letter of the rules."""
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(f in (1, 2) and e != "D" for (_, f), e in zip(rows, edits, strict=True)):
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""], strict=True))
            cost = sum({"K": 0, "R": 3, "D": 4}[e] + (3 if f == 3 and e != "D" else 0) for (_, f), e in zip(rows, edits, strict=True)) + 3 * sum(gaps)
            if best and (cost, audit) >= best:
                continue
            out = [x for g, e, (i, _) in zip(gaps, [*edits, "D"], [*rows, ("", 0)], strict=True) for x in ["?"] * g + ([i] if e == "K" else ["?"] if e == "R" else [])]
            if re.fullmatch("(s?([u?][a?])+)?", "".join(out)):
                best = cost, audit
    return best


def test_search_equals_enumeration():
    rng = random.Random(9)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randrange(0, 5))]
        names = {0: "", 1: "blank", 3: "truncated"}
        assert cheapest([(x, "t", names[f]) for x, f in rows])[:2] == tried(rows)


def test_empty_tables_and_dropped_rows(spark):
    assert sr.repair(table(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []
    dropped = next((c, 0, "user", "a.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert as_tuples(sr.repair(table(spark, [dropped]))) == [(dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_sql_equals_brute_force(wanted):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", conversations())
    found = connection.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op13_structure_repair']})").fetchall()
    assert sorted(found, key=repr) == wanted
