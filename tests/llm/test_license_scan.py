from fixtures import documents, empty, search_words

from presswire.llm.license_scan import BASE_TEMPLATES, Template, license_labels, license_spans


def result(docs, templates=None):
    return license_labels(docs, license_spans(docs, templates)).collect()


def test_base_places_on_awkward_rows(spark):
    docs = documents(spark)
    expected = []
    for row in docs.collect():
        words, places = search_words(row.text), []
        for t in BASE_TEMPLATES:
            phrase = t.phrase.split()
            places += [(i, t.label) for i in range(len(words)) if words[i:i + len(phrase)] == phrase]
        at = [i for i, _ in places]
        expected.append((row.doc_id, len(words), len(at), min(at, default=None), max(at, default=None),
                         ",".join(sorted({label for _, label in places}))))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in result(docs)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_gap_moves_to_a_neighbouring_diagonal(spark):
    whole = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([
        (1, "start " + whole), (2, whole.replace("five", "five extra")), (3, whole.replace(" five", "")),
        (4, "one two three"), (5, " ".join(reversed(whole.split())))], "doc_id long, text string")
    spans = {r.doc_id: r for r in license_spans(docs, [Template("x", whole)]).collect()}
    assert set(spans) == {1, 2, 3}
    assert (spans[1].start_word, spans[1].end_word, spans[1].cover) == (1, 11, 1.0)
    assert (spans[2].start_word, spans[2].end_word) == (0, 11) and spans[2].cover == 8 / 9
    assert (spans[3].start_word, spans[3].end_word) == (0, 9) and spans[3].cover == 7 / 9


def test_two_texts_of_one_id_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "cc by"), (1, "all rights reserved"), (1, "cc by")], "doc_id long, text string")
    assert sorted((r.base_labels, r.n_base) for r in result(docs)) == [("cc-by", 1), ("cc-by", 1), ("reserved", 1)]
    assert result(empty(spark)) == []


def test_variants_are_told_apart(spark):
    sentence = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    texts = {
        "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa", "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa", "licensed under cc by 4.0": "cc-by",
        sentence.format(""): "cc-by", sentence.format("-NonCommercial"): "cc-by-nc",
        sentence.format("-ShareAlike"): "cc-by-sa", sentence.format("-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser"
        " General Public License as published by the Free Software Foundation": "gpl,lgpl",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in result(docs)} == dict(enumerate(texts.values()))


def test_template_longer_than_two_bitmaps(spark):
    words = [f"w{i}" for i in range(150)]
    whole = " ".join(words)
    gap = " ".join([*words[:70], "extra", *words[70:]])
    docs = spark.createDataFrame(
        [(1, "a " + whole), (2, gap), (3, " ".join(words[:90])), (4, " ".join(words[-91:])),
         (5, " ".join([*words[75:], *words[:75]]))], "doc_id long, text string")
    spans = {r.doc_id: (r.start_word, r.end_word, r.cover) for r in license_spans(docs, [Template("x", whole)]).collect()}
    # document 3 has 89 of 149 pairs, document 5 both halves in the wrong order
    assert spans == {1: (1, 151, 1.0), 2: (0, 151, 148 / 149), 4: (0, 91, 90 / 149)}


def test_sprinkled_pairs_make_no_span(spark):
    words = [f"w{i}" for i in range(12)]
    # every pair of the template once, each so far from its place that no neighbourhood holds enough of them
    spread = " ".join(f"{a} {b} x" for a, b in zip(words, words[1:]))
    docs = spark.createDataFrame([(1, spread)], "doc_id long, text string")
    assert license_spans(docs, [Template("x", " ".join(words))]).collect() == []


def test_needs_are_words_of_the_template():
    import pytest

    with pytest.raises(ValueError):
        Template("x", "one two three", needs="two four").needed


def test_clashing_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame(
        [(None, "cc by", 1, 2, "z"), (None, "cc by", 1, 2, "z"), (7, None, None, None, None)],
        "doc_id long, text string, template int, diagonal int, label string")
    got = sorted(((r.doc_id, r.n_base, r.labels) for r in result(docs)), key=repr)
    assert got == [(7, 0, ""), (None, 1, "cc-by"), (None, 1, "cc-by")]
