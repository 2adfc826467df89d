import hashlib
import random
import re

from llm_rows import as_tuples, documents, empty, odd_rows, sentence

from lorespan.llm import decontaminate

ITEMS = "item_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, items):
    windows = []
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        if name is not None:
            windows += [(str(name), tuple(w[k : k + size])) for k in range(len(w) - size + 1) if size]
    out = []
    for i, text, _ in rows:
        w, hit, found = words(text), set(), set()
        for name, window in windows:
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(name)
        names = ",".join(sorted(found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def planted(seed):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.choice((1, 2, 5, 9, 10, 11, 25))) for _ in range(12)]
    items = [*enumerate(texts), (20, texts[3]), (21, None), (22, "..."), (None, texts[4]), (23, "Ünï çode wörds AND more")]
    rows = [r for r in odd_rows(seed) if r[0] not in (103, 104)]
    for n in range(12):
        rows.append((300 + n, sentence(rng, 5) + ". " + rng.choice(texts).upper() + "! " + sentence(rng, 4) + " " + rng.choice(texts)[:40], "s0"))
    return [*rows, (400, "x Ünï, çode;wörds and\nMORE", "s0")], items


def test_hits_equal_brute_force(spark):
    rows, items = planted(2)
    found = decontaminate.contamination(documents(spark, rows), spark.createDataFrame(items, ITEMS))
    assert as_tuples(found) == brute(rows, items)


def test_several_blocks_of_items_find_the_same(spark):
    rows, items = planted(4)
    docs, table = documents(spark, rows), spark.createDataFrame(items, ITEMS)
    one = decontaminate.word_hits(docs, table).select("doc_id", "text", "hits.*")
    many = decontaminate.word_hits(docs, table, block_words=30).select("doc_id", "text", "hits.*")
    assert as_tuples(many) == as_tuples(one)


def test_spans_go_and_clean_rows_stay(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before it; {item.upper()}, after it and so on and on and on and on and on.", "s0"), (2, item, "s0"), (3, "clean  text\n", None), (4, None, "s1"), (5, "", "s1"), (1, "clean", "s0")]
    docs = documents(spark, rows)
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], ITEMS))
    assert found.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in found.collect()), key=repr)
    cut = "Before it; , after it and so on and on and on and on and on."
    assert got == sorted([(1, cut, len(cut)), (3, "clean  text\n", 12), (4, None, None), (5, "", 0), (1, "clean", 5)], key=repr)


def test_empty_tables(spark):
    items = spark.createDataFrame([], ITEMS)
    assert decontaminate.contamination(empty(spark), items).collect() == []
    rows = [(1, "some text", "s0")]
    assert decontaminate.contamination(documents(spark, rows), items).first().n_hit == 0


def test_long_text_is_read_to_its_end(spark):
    item = sentence(random.Random(6), 12)
    row = (1, sentence(random.Random(7), 100_000) + " " + item, "s0")
    assert decontaminate.contamination(documents(spark, [row]), spark.createDataFrame([(1, item)], ITEMS)).first().n_hit == 12
