from fixtures import TEXTS, documents, empty, search_words

from presswire.llm.decontamination import WuManber, find_contamination

ITEMS = [
    (1, "jumps over the lazy dog again and again until the end of the day"), (2, "mit license"),
    (2, "the MIT, license!"), (3, None), (4, ""), (None, "same text here of four words"), (10, "word5 the"), (11, "été"),
    (12, " ".join(f"word{i % 977} the of" for i in range(30))),
]


def brute(text, window):
    words, hit, found = search_words(text), set(), set()
    for item, body in ITEMS:
        ws = search_words(body)
        m = min(window, len(ws))
        for gram in {tuple(ws[i:i + m]) for i in range(len(ws) - m + 1)} if m else ():
            for at in range(len(words) - m + 1):
                if words[at] == gram[0] and tuple(words[at:at + m]) == gram:
                    hit |= set(range(at, at + m))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def check(spark, block_bytes):
    texts = [t if t is None or len(t) < 5000 else t[:4000] for t in TEXTS]
    docs = documents(spark, texts)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_contamination(docs, items, block_bytes=block_bytes)
    assert [c for c in got.columns if c not in ("n_hit", "spans", "items", "n_words")] == \
        [c for c in docs.columns if c != "n_words"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for row in rows:
        expected = brute(row.text, 10)
        assert (row.n_words, row.n_hit, row["items"]) == expected
        assert sum(s.end - s.start for s in row.spans) == row.n_hit


def test_matches_brute_force(spark):
    check(spark, 1 << 20)


def test_blocks_of_items_give_the_same(spark):
    check(spark, 40)


def test_shift_never_passes_a_match():
    words = "a b a b a b c a b a b".split()
    for m in range(1, 5):
        grams = {b" ".join(x.encode() for x in words[i:i + m]): {str(i)} for i in range(0, len(words) - m, 2)}
        raw = [w.encode() for w in words * 3]
        got = [at for at, _ in WuManber(m, grams).search(raw)]
        assert got == [i for i in range(len(raw) - m + 1) if b" ".join(raw[i:i + m]) in grams]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_contamination(empty(spark), items).count() == 0
    clean = find_contamination(documents(spark), items.limit(0)).collect()
    assert {(r.n_hit, len(r["items"])) for r in clean} == {(0, 0)}
