"""The training-data operators: against SQL, brute force, round trips and held-out labels, and on odd tables."""

import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from archspark.llm import decontaminate, fingerprint, html_text, katz, language, licenses, line_dedup, near_dedup, packing, queries, toxicity
from archspark.llm.common import WordHashes, shingle_set
from archspark.llm.oracles import ORACLES

ODD = [(1, None, "x"), (2, "", "x"), (3, "   \n ", "x"), (4, "one two", "x"), (4, "one two", "x"), (5, "One TWO", "x"), (None, "a row without id " * 10, "x"), (6, None, None), (7, "a" * 50_000 + " b" * 30_000, "x"), (8, "12 34 !!", "x")]
ODD_SCHEMA = "doc_id long, text string, lang string, n_chars string, start int, component string, key int, _gone int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, and extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "n", 1, "c", 2, 3) for r in ODD], ODD_SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


def test_fingerprints_estimate_similarity(spark, duck):
    docs = duck.sql("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()
    rows = {r.doc_id: r for r in queries.op1_fingerprints(spark, SF).collect()}
    assert len(rows) == len(docs)
    cache, off = WordHashes(), []
    for (d, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        k = len(t) // 4
        a, b = (shingle_set(x.encode(), cache) for x in (t, t[: len(t) - k] + u[:k]))
        off.append(rows[d].near_edited - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(off)) < 0.02 and np.abs(off).mean() < 0.06


def test_fingerprints_merge_and_contain():
    cache, rng = WordHashes(), np.random.default_rng(1)
    words = [str(x) for x in rng.integers(0, 10**6, 20_000)]
    long, short = " ".join(words).encode(), " ".join(words[5000:5400]).encode()
    a, b = fingerprint.sketch(long, cache), fingerprint.sketch(short, cache)
    assert fingerprint.containment(b, a) == 1.0 and fingerprint.containment(a, b) < 0.05
    x, y = fingerprint.sketch(" ".join(words[:300]).encode(), cache), fingerprint.sketch(" ".join(words[296:700]).encode(), cache)
    assert (fingerprint.merged(x, y) == fingerprint.sketch(" ".join(words[:700]).encode(), cache)).all()
    assert (fingerprint.read(fingerprint.written(a)) == a).all()


def test_fingerprints_of_odd_tables(odd, none):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and fingerprint.fingerprints(none).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == "" and by[4].fingerprint == by[5].fingerprint


def test_toxicity_learns_words_and_beginnings(spark):
    rng = np.random.default_rng(2)
    bag = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(1200):
        words, bad = list(rng.choice(bag, 60)), i % 6 == 0
        if bad:
            words[5:5] = [("grobl" + str(rng.choice(["ig", "ung", "er", "ste"]))) if i % 4 else "vile" for _ in range(3)]
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id % 3 != 1").select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.toxicity(df, model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(got[d].predicted == y for d, _, y in held) >= 0.98 * len(held)
    assert set(model.lexicon) and model.labels.fires.shape[0] == 2


def test_toxicity_on_held_out_labels(spark, duck):
    """On sf0.1: precision and recall on the third of the labels that training never saw."""
    sf = "/root/testdata/sf0.1"
    truth = dict(duck.sql(f"select doc_id, max(toxic) from read_parquet('{sf}/labels.parquet') where toxic is not null group by doc_id").fetchall())
    rows = [r for r in queries.op2_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    toxic = [r for r in rows if truth[r.doc_id] == 1]
    # labels are noisy: 54 of the 449 texts marked toxic hold no insult at all, and nothing sets them apart from clean ones
    insult = re.compile("trash|idiot|pathetic|worthless|scum|stupid|loser|moron|disgusting|clown")
    texts = dict(duck.sql(f"select doc_id, lower(text) from read_parquet('{sf}/documents.parquet')").fetchall())
    assert np.mean([r.predicted for r in toxic if insult.search(texts[r.doc_id])]) > 0.98
    assert np.mean([r.predicted for r in toxic]) > 0.8
    assert np.mean([r.predicted for r in rows if truth[r.doc_id] == 0]) < 0.005
    for r in rows:
        assert r.predicted == (r.score >= 0.7)


def test_toxicity_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (5, None), (7, 1), (8, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert toxicity.fit(none, labels) is None and toxicity.fit(odd, labels.where("toxic = 1")) is None and toxicity.fit(odd, labels.where("false")) is None
    model = toxicity.fit(odd, labels)
    rows = toxicity.toxicity(odd, model).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows if r.doc_id in (1, 2, 3, 6)}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.toxic for r in toxicity.drawn(labels, 2).collect()}.keys() <= {1, 2, 7, 8, 9} and toxicity.drawn(labels, 1).count() == 2
    assert {r.score for r in toxicity.toxicity(odd, None).collect()} == {0.0}
    assert toxicity.toxicity(none, None).count() == 0


PAGE = '<html><body><header><a href="/">Home</a> Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="sidebar"><p>Side text</p></div>{}<div id="comments"><p>Nice post, I like it very much indeed, thanks.</p></div><form><p>Sign up</p><input></form><script>var x="</p>";</script><footer>&copy; 2020</footer></body></html>'
ARTICLE = "<h1>Title &amp; more</h1><p>First   <b>bold</b> text.<br>Next</p>\n<p>Second &lt;p&gt; <a href=x>link</a>.</p><div class='ad'>Buy</div><p>Third paragraph of the article.</p>"
TEXT = "Title & more First bold text. Next Second <p> link. Third paragraph of the article."


@pytest.mark.parametrize("html", [PAGE.format(f"<article>{ARTICLE}</article>"), PAGE.format(f"<main><div>{ARTICLE}</div></main>"), PAGE.format(f"<div class='content'>{ARTICLE}</div>")])
def test_html_text(html):
    assert html_text.main_text(html) == TEXT


LONG = "This is a sentence of the article that says something at some length. " * 4


def test_html_text_by_density_without_article_or_main():
    lead, part = "L" * 600, "p" * 300
    wrap = f"<body><div class=wrap><p>{lead}</p><div class=text>{f'<p>{part}</p>' * 10}</div></div><div class=nav><a href=x>one</a> <a href=y>two</a></div></body>"
    assert html_text.main_text(wrap) == " ".join([lead, *[part] * 10])
    links = "".join(f"<li><a href=/{i}>a linked headline number {i}</a></li>" for i in range(30))
    assert html_text.main_text(f"<body><ul>{links}</ul><div><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></div><p>tiny</p></body>") == " ".join(["A title", LONG.strip(), LONG.strip()])
    assert html_text.main_text(f"<body><div><p>{LONG}</p></div><div><a href=x>x</a></div></body>") == LONG.strip()
    assert html_text.main_text(f"<body>{LONG}<div><p>tiny</p></div></body>").startswith(LONG.strip())


@pytest.mark.parametrize("name", ["content has-sidebar", "post-with-comments", "related-work", "no-sidebar"])
def test_html_text_keeps_what_only_mentions_another_part(name):
    assert html_text.main_text(f"<body><div class='{name}'><h1>A title</h1><p>{LONG}</p><p>{LONG}</p></div></body>") == " ".join(["A title", LONG.strip(), LONG.strip()])


@pytest.mark.parametrize("name", ["comment-list", "cookie-banner", "sidebar", "site-footer", "ad-slot-2", "related-posts"])
def test_html_text_leaves_out_what_names_itself_another_part(name):
    inside = f"<h1>A title</h1><div class='article-header'><p>{LONG}</p></div><section id='related-work'><p>{LONG}</p></section>"
    assert html_text.main_text(f"<body><div>{inside}<div class='{name}'><p>{LONG} other</p></div></div></body>") == " ".join(["A title", LONG.strip(), LONG.strip()])


def test_html_text_of_comments_and_forms():
    comments = "".join(f"<article class='comment'><p>{LONG} by reader {i}</p></article>" for i in range(5))
    assert html_text.main_text(f"<body><article><h1>A title</h1><p>{LONG}</p><div>{comments}</div></article></body>") == f"A title {LONG.strip()}"
    assert html_text.main_text(f"<body><form action='.'><div><h1>A title</h1><p>{LONG}</p><p>{LONG}</p><input></div></form></body>") == " ".join(["A title", LONG.strip(), LONG.strip()])
    assert html_text.main_text(f"<body><div class='widget'><main><p>{LONG}</p></main></div></body>") == LONG.strip()


def test_html_text_of_deep_pages_takes_time_in_proportion():
    import time

    took = []
    for n in (4000, 16_000):
        page = "<body>" + "<div><b>" * n + "deep" + "</i></p></span>" * n + "</div>" * n
        began = time.perf_counter()
        assert html_text.main_text(page) == "deep"
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_html_text_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "u", PAGE.format(ARTICLE), "a"), (1, "u", PAGE.format(ARTICLE), "a"), (None, None, None, "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(r.n_chars for r in got.collect()) == [0, len(TEXT), len(TEXT)]
    assert html_text.extract(df.where("false")).count() == 0


def test_html_text_of_the_pages(spark, duck):
    import html

    rows = {r.page_id: r for r in queries.op3_html_text(spark, SF).collect()}
    for page, raw in duck.sql("select page_id, html from pages").fetchall():
        inner = re.sub(r"</?b>", "", re.sub(r"</?(h1|p|br)[^>]*>", " ", re.search(r"<article>(.*)</article>", raw, re.S)[1]))
        assert rows[page].text == " ".join(html.unescape(inner).split()) and rows[page].n_chars == len(rows[page].text)


def test_html_text_of_odd_pages(spark):
    odd = ["", None, "plain text", "<", "<p>", "</div></p>", "<body></body>", "<div>" * 3000 + "deep" + "</div>" * 3000, "&#0; &bogus; &amp", "<!-- x", "<p>a<p>b"]
    df = spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").selectExpr("page_id", "'u' as url", "html")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert len(got) == len(odd) and got[0] == got[1] == "" and got[2] == "plain text" and got[7] == "deep" and got[10] == "a b"


def test_language_on_held_out_documents(spark, duck):
    truth = dict(duck.sql("select doc_id, lang from documents").fetchall())
    rows = [r for r in queries.op4_language(spark, SF).collect() if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_tables(spark, odd, none):
    texts = [("the cat sat on the mat and it was good " * 5, "en"), ("der hund und die katze sind nicht gut " * 5, "de")]
    model = language.train([(w, lang, seed % 8 == 7) for seed in range(20) for t, lang in texts for w in language.windows(t, seed)])
    fitted = language.fit(odd)
    assert fitted.languages == ["x"] and len(language.identify(odd, fitted).collect()) == len(ODD)
    got = [tuple(r) for r in language.identify(odd, model).collect()]
    assert len(got) == len(ODD) and {r[1] for r in got if r[0] in (1, 2, 3, 6, 8)} == {"und"}
    assert language.accepted(odd, model).columns == odd.columns and language.accepted(none, None).count() == 0 and language.fit(none) is None


def test_language_rejects_gibberish(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    junk = spark.createDataFrame([(1, "zxqj kkvw pqzzt xxjq wvvk qqpz jjxk vvzq " * 5)], "doc_id long, text string")
    assert not language.identify(junk, model).first().accepted
    assert language.accepted(docs, model).count() >= 0.97 * docs.count()


def test_language_rejects_unknown_languages_whatever_the_input_size(spark):
    """Trained on sf0.1, texts of gibberish, Greek and Russian go, and hardly one of the table's own does."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language.fit(docs)
    strange = ["zxqj kkvw pqzzt xxjq wvvk qqpz jjxk vvzq " * 5, "η γάτα κάθισε στο χαλί και ήταν πολύ καλή μέρα για όλους μας " * 3, "кошка сидела на коврике и это был очень хороший день для всех нас " * 3]
    df = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    assert not any(r.accepted for r in language.identify(df, model).collect())
    assert language.accepted(docs, model).count() >= 0.995 * docs.where("text is not null").count()


def test_language_rejects_a_language_left_out_and_few_rows_not_looked_at(spark):
    """Trained on the rows of three languages that crc32 gives to training: of the fourth language most long texts go; of the three, hardly one of the rows that training never saw."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and text is not null")
    left_out = docs.selectExpr("min(lang)").first()[0]
    own = docs.where(docs.lang != left_out)
    model = language.fit(own.where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"))
    seen = language.identify(own.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), model).where("lang_pred != 'und'").selectExpr("avg(cast(not accepted as int))").first()[0]
    strange = language.identify(docs.where((docs.lang == left_out) & (docs.n_chars > 400)), model).selectExpr("avg(cast(not accepted as int))").first()[0]
    assert seen < 0.005 and strange > 0.9, (seen, strange)


def test_packing_round_trip(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces, sequences = {}, {}
    for r in packing.pack(docs).collect():
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts, total in [*((p, len(ids[d])) for d, p in pieces.items()), *((p, None) for p in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total else at <= packing.LENGTH
    assert len(pieces) == len(ids)
    lengths = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n & (n - 1) == 0 for n in lengths)
    assert {r.doc_id for r in packing.pack(odd).collect()} == {r[0] for r in ODD} and packing.pack(none).count() == 0


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    tok = Tokenizer.from_file(path)
    texts = ["Hello, World! it's <|endoftext|> x", "A B c　d É é don't 123abc", "", "ǅ İstanbul. ẞ\x1c y\x85z  w", "İ. É, é. 中文, ﬁ. Å, ª² a., ,. ß. ŉ. ΐ, 가."]
    assert [a.tolist() for a in packing.Encoder(path).encode([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_hilbert_neighbours_are_adjacent():
    side = np.array(np.meshgrid(*[np.arange(4)] * 3)).reshape(3, -1).T
    order = side[np.argsort(packing.hilbert_keys(side, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_decontamination_of_odd_tables(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "b b b b b b b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()}
    assert got == {(4, 3), (5, 3), (7, 4)}
    assert decontaminate.contaminated(none, items).count() == 0 and decontaminate.contaminated(odd, items.where("false")).count() == 0


def test_decontamination_finds_every_short_item_and_rows_without_ids(spark, tmp_path):
    """Items of two to twelve words, each in the middle of 150 texts of its own; a null doc_id and a null item_id count."""
    import corpus_pipeline

    rng = np.random.default_rng(3)
    made = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 10**9, n))
    items = [(i, made(2 + i % 11)) for i in range(1650)] + [(None, made(6))]
    docs = [(i, f"{made(int(rng.integers(0, 30)))} {t} {made(int(rng.integers(0, 30)))}") for i, t in items[:-1]]
    docs += [(None, f"{made(20)} {items[0][1]}"), (None, made(40)), (5000, f"{items[-1][1]} {made(9)}")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == {(i, i) for i in range(1650)} | {(None, 0), (5000, None)}
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.text for r in corpus_pipeline.drop_contaminated(spark, df, str(tmp_path)).collect()] == [docs[-2][1]]


def test_licences(spark, odd, none):
    lines = [(i, f"Some words before.\n{t}\nwords after", f) for i, (f, t) in enumerate((f, ts[0]) for f, ts in licenses.TEMPLATES.items())]
    clean = [(100 + i, t, None) for i, t in enumerate(licenses.OTHER)]
    model = licenses.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    df = spark.createDataFrame([(i, t) for i, t, _ in lines + clean], "doc_id long, text string")
    got = {r.doc_id: r.family for r in licenses.licences(df, model).collect()}
    assert got == {i: f for i, _, f in lines}
    assert licenses.scan(odd, model).where("confirmed").count() == 0 and licenses.scan(none, licenses.fit(none)).count() == 0


#: Notices that TEMPLATES doesn't have, wrapped as source files wrap them.
UNSEEN = [
    ("MIT", "/*\n * This package is free to use under the terms of\n * the MIT License; see the file LICENSE.\n */"),
    ("Apache-2.0", "# Licensed to the Foundation under one or more agreements, under the Apache\n# License, Version 2.0; you may not use this file\n# except in compliance with it."),
    ("GPL-3.0", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appears in all copies."),
    ("EPL-2.0", "Contributed under the Eclipse Public License\nversion 2.0, which is available at the foundation."),
    ("CC-BY-4.0", "Text and figures: Creative Commons\nAttribution 4.0 International License."),
]


def test_licences_inside_long_lines(spark, duck):
    """Every template amid one long line of the corpus; many notices in one paragraph take linear time."""
    texts = [t for (t,) in duck.sql("select text from documents where len(text) > 400 order by doc_id").fetchall()]
    model, rng = licenses.fit(spark.read.parquet(f"{SF}/documents.parquet")), np.random.default_rng(3)
    corpus = [w for t in texts for w in t.split() if not re.search(r"(?i)licen[sc]e|copyright|rights reserved|public domain|CC", t)]
    rows, wanted = [], {}
    for family, ts in licenses.TEMPLATES.items():
        for t in ts:
            for _ in range(4):
                a, b = rng.integers(20, 200, 2)
                at = int(rng.integers(0, len(corpus) - 500))
                wanted[len(rows)] = family
                rows.append((len(rows), " ".join([*corpus[at : at + a], t, *corpus[at + 200 : at + 200 + b]])))
    found = {(r.doc_id, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).where("confirmed").collect()}
    by = {f: [(d, f) in found for d, g in wanted.items() if g == f] for f in licenses.TEMPLATES}
    assert all(np.mean(x) >= 0.9 for x in by.values()), {f: np.mean(x) for f, x in by.items()}
    words = (corpus * (300_000 // len(corpus) + 1))[:300_000]
    for k in range(12_000):
        words[k * 25 : k * 25 + 5] = ["released", "under", "the", "isc", "license"]
    began = time.perf_counter()
    assert len(model.notices(licenses.hashes(words, {}), np.array([0]))) >= 12_000
    assert time.perf_counter() - began < 20


def test_licences_wrapped_unseen_and_several_in_one_paragraph(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = licenses.fit(docs)
    two = "Released under the MIT License. " + "and then a good many other words about the weather stand in between here today " * 4 + "Licensed under the Apache License, Version 2.0."
    df = spark.createDataFrame([*((i, "Some words before.\n\n" + t + "\n\nwords after") for i, (_, t) in enumerate(UNSEEN)), (50, two)], "doc_id long, text string")
    found = {}
    for r in licenses.scan(df, model).collect():
        found.setdefault(r.doc_id, set()).add(r.family)
    assert sum(f in found.get(i, ()) for i, (f, _) in enumerate(UNSEEN)) >= len(UNSEEN) - 1, found
    assert found[50] == {"MIT", "Apache-2.0"}
    lines = duck.sql("select doc_id, unnest(string_split(text, chr(10))) as l from documents").fetchall()
    marked = {d for d, t in lines if re.search(r"(?i)licen[sc]e|all rights reserved|public domain|creative commons|CC BY", t)}
    rows = licenses.scan(docs, model).where("confirmed").collect()
    assert {r.doc_id for r in rows} <= marked and len({r.doc_id for r in rows}) >= 0.9 * len(marked), (len(rows), len(marked))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id][r.start : r.start + r.length].strip() == texts[r.doc_id][r.start : r.start + r.length] for r in rows)


def test_katz_equals_a_plain_model_that_sums_to_one(spark, odd, none):
    from collections import Counter

    texts = ["a b a b c", "a b d", "c a b", "a c", "d d a b", "b a", "x y z a b"]
    train = [["^", *t.split(), "$"] for t in texts]
    uni, bi = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:]))
    hist = Counter(h for t in train for h in t[:-1])
    d1, d2 = (katz.discounts([0, *(sum(c == r for c in counts.values()) for r in range(1, 7))]) for counts in (uni, bi))
    total, d = sum(uni.values()), lambda d, c: d[min(c, 6)] * c
    unknown = 1 - sum(d(d1, c) for c in uni.values()) / total
    p1 = lambda w: d(d1, uni[w]) / total if w in uni else unknown

    def p2(h, w):
        if h not in hist:
            return p1(w)
        seen = {x: c for (g, x), c in bi.items() if g == h}
        left = sum(c - d(d2, c) for c in seen.values())
        below, left = (hist[h], left) if left > 0 else (hist[h] + 1, 1)
        return d(d2, seen[w]) / below if w in seen else left / below / (1 - sum(map(p1, seen))) * p1(w)

    for h in [*hist, "never"]:
        assert sum(p2(h, w) for w in [*uni, "unknown"]) == pytest.approx(1)
    held = ["a b c", "c q a", "", "q"]
    df = spark.createDataFrame(list(enumerate(texts + held)), "doc_id long, text string")
    got = {r.doc_id: r for r in katz.katz_scores(df, f"doc_id >= {len(texts)}").collect()}
    for i, t in enumerate(texts + held):
        words = ["^", *t.split(), "$"]
        assert got[i].score == pytest.approx(sum(np.log10(p2(*x)) for x in zip(words, words[1:]))) and got[i].n_tokens == len(words) - 1
    assert len(katz.katz_scores(odd, "false").collect()) == len(ODD) and katz.katz_scores(none, "false").count() == 0
    untrained = katz.katz_scores(odd, "true").collect()
    assert len(untrained) == len(ODD) and all(r.n_known == 0 and r.score == 0 for r in untrained)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_good_turing_is_what_discounts(duck, sf):
    """The fall of the counts of counts is steep enough for both orders, so the absolute discount isn't used."""
    docs = f"read_parquet('/root/testdata/{sf}/documents.parquet')"
    words = f"select unnest(string_split(lower(text), ' ')) as w, doc_id from {docs}"
    pairs = f"select w || ' ' || lead(w) over (partition by doc_id) as w from ({words})"
    for of in (words, pairs):
        counts = dict(duck.sql(f"select c, count(*) from (select count(*) as c from ({of}) group by w) where c <= {katz.K + 1} group by c").fetchall())
        n = [0, *(counts.get(r, 0) for r in range(1, katz.K + 2))]
        d, less = katz.discounts(n), n[1] / (n[1] + 2 * n[2])
        assert (0 < d[1 : katz.K + 1]).all() and (d[1 : katz.K + 1] < 1).all() and (np.diff(d[1:]) > 0).all()
        assert abs(d[1] - (1 - less)) > 1e-3 and abs(d[2] - (2 - less) / 2) > 1e-3
        slope = np.polyfit(np.log(range(1, katz.K + 2)), np.log(n[1:]), 1)[0]
        stars = [(r + 1) * (1 + 1 / r) ** slope for r in range(1, katz.K + 1)]
        rest = (katz.K + 1) ** (slope + 1)
        assert d[1 : katz.K + 1] == pytest.approx([(x / r - rest) / (1 - rest) for r, x in enumerate(stars, 1)])


def test_sketch_coordinates_agree_as_sets_do():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    hits = []
    for share in (0.5, 0.9):
        b = np.concatenate([a[: int(400 * share)], rng.integers(0, 2**63, 400 - int(400 * share)).astype(np.uint64)])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        hits.append(abs((near_dedup.fast_sketch(a) == near_dedup.fast_sketch(b)).mean() - j))
    assert max(hits) < 0.15 and len(np.unique(near_dedup.fast_sketch(a[:3]))) <= near_dedup.COORDINATES


def linked_by_brute_force(rows):
    """rows of (doc_id, text) -> doc_id -> smallest doc_id reachable."""
    sets = [(d, set(zip(*(t.lower().split()[k:] for k in range(5))))) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, r in sets[:i]:
            if 100 * len(s & r) >= 75 * len(s | r) > 0:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: top(d) for d, _ in sets}


def test_near_duplicates_in_small_blocks_and_of_ids_with_several_texts(spark, monkeypatch):
    """Families at 0.6 to 0.9 of their templates, blocks of 8 members: blocks of both kinds meet. Ids 3 and 40 have texts in two families."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = np.random.default_rng(8)
    rows = []
    for family in range(3):
        words = [f"f{family}_{i}" for i in range(150)]
        for _ in range(60):
            own = list(words)
            for _ in range(int(rng.integers(1, 6))):
                own[int(rng.integers(0, 150))] = f"x{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(3, rows[70][1]), (40, rows[130][1] + " and more")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked_by_brute_force(rows)


def test_near_duplicates_finds_pairs_at_the_threshold(spark):
    """400 pairs whose similarity is 0.75 to 0.80: no link is lost."""
    rng = np.random.default_rng(9)
    rows = []
    while len(rows) < 800:
        words = [f"p{len(rows)}_{i}" for i in range(204)]
        other = list(words)
        for at in rng.choice(np.arange(2, 202), int(rng.integers(5, 7)), replace=False):
            other[at] = "edit"
        s, r = (set(zip(*(w[k:] for k in range(5)))) for w in (words, other))
        if 0.75 <= len(s & r) / len(s | r) <= 0.80:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_components_with_a_hub(spark, monkeypatch):
    from archspark.llm import components as c

    monkeypatch.setattr(c, "HUB", 50)
    links = [(0, i) for i in range(10, 400)] + [(i, i + 1) for i in range(500, 560)] + [(399, 500), (700, 701)]
    got = {r.id: r.component for r in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for a, b in links[:-1] for i in (a, b)}, 700: 700, 701: 700}


def test_near_duplicates_of_a_family_without_a_centre(spark, odd, none):
    """Chains of copies, each edited from the one before: links between neighbours only, all in one component."""
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in rng.integers(0, 10**6, 200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        at = int(rng.integers(0, 185))
        words[at : at + 9] = [f"n{i}_{k}" for k in range(9)]
    rows += [(500 + i, " ".join(f"z{i}_{k}" for k in range(50))) for i in range(20)] + [(700, rows[0][1].upper()), (701, rows[0][1])]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: r.component_id for d, r in got.items()} == linked_by_brute_force(rows)
    rest = near_dedup.near_duplicates(odd).collect()
    assert len(rest) == len(ODD) and {r.component_id for r in rest if r.doc_id in (4, 5)} == {4} and all(r.n_shingles == 0 and r.kept for r in rest if r.doc_id in (1, 2, 3, 6))
    assert near_dedup.near_duplicates(none).count() == 0


def test_repeated_lines(spark, odd, none):
    long = " ".join(f"p{i}" for i in range(25))
    short = [" ".join(f"q{k}_{i}" for i in range(12)) for k in range(3)]
    texts = [(1, f"start\n{long}\nend one"), (2, f"other\n{long.upper()}!\nend two"), (3, "\n".join(["x", *short, "tail"])), (4, "\n".join(["y", *short, "other tail"])), (5, long), (6, "clean text")]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in texts], "doc_id long, text string, n_chars long")
    removed = line_dedup.repeated_lines(df)
    left = {r.doc_id: r.text for r in line_dedup.without_lines(df, removed).collect()}
    assert left == {1: texts[0][1], 2: "other\nend two", 3: texts[2][1], 4: "y\nother tail", 6: "clean text"}
    for r in removed.collect():
        assert len(line_dedup.normalised(dict(texts)[r.doc_id][r.start : r.start + r.length])) == r.n_words
    kept = line_dedup.without_lines(odd, line_dedup.repeated_lines(odd))
    assert kept.columns == odd.columns and kept.count() == len(ODD) and line_dedup.repeated_lines(none).count() == 0


def test_repeated_passages_equal_a_brute_force_search(spark):
    """Every run of 50 words that occurred before lies in a span; every span's words occurred before; rows that share an id keep their own spans."""
    rng = np.random.default_rng(5)
    made = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    passages = [made(n) for n in (50, 60, 90, 200, 49)]
    texts = [(i, ", ".join([*made(int(rng.integers(0, 80))), *passages[i % 5], *made(int(rng.integers(0, 80)))])) for i in range(15)]
    texts += [(None, " ".join(made(70))), (None, " ".join([*made(5), *passages[2]]) + " İ end")]
    texts += [(20, " ".join([*passages[1], *made(30)])), (20, " ".join(made(100)))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found: dict[tuple, list] = {}
    keys = {(r.doc_id, r.h): r.text for r in df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
    for r in line_dedup.repeated_passages(df).collect():
        found.setdefault(keys[r.doc_id, r.text_hash], []).append((r.start, r.start + r.length))
    before, whole = set(), " "
    for _, text in sorted(texts, key=lambda t: (t[0] is None, t[0] or 0)):
        places = [m.span() for m in line_dedup._WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in places]
        for a, b in found.get(text, []):
            assert " " + " ".join(w.lower() for w in line_dedup._WORD.findall(text[a:b])) + " " in whole
        runs = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        for i, run in enumerate(runs):
            if run in before:
                assert any(a <= places[i][0] and places[i + 49][1] <= b for a, b in found[text])
            covered = [w for w, (a, b) in zip(words, places) if any(x <= a and b <= y for x, y in found.get(text, []))]
        before |= set(runs)
        whole += " ".join(words) + " | "
        own = next((p for p in passages if " ".join(p) in " ".join(words)), None)
        if own and found.get(text) and len(own) >= 50:
            assert covered == own  # the whole passage, nothing else
    assert found
    left = {r.text for r in line_dedup.without_lines(df, line_dedup.repeated_passages(df)).collect()}
    assert texts[15][1] in left and texts[18][1] in left and texts[16][1] not in left


def test_what_operators_write_is_removed(spark):
    from pathlib import Path

    from archspark.llm import common

    before = common.written()
    kept = common.stored(spark.range(3), "kept")
    common.stored(spark.range(4), "gone")
    common.bucketed(spark.range(5), "coded", "id")
    gone, table = common._WRITTEN[-2:]
    common.discard(spark, before, kept)
    assert kept.count() == 3 and not Path(gone.removeprefix("file://")).exists() and not spark.catalog.tableExists(table)


def _plain_kept(texts: dict[int, str]) -> set[int]:
    """The smallest id of each group of texts linked by their five-word shingles, all pairs compared."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in texts}
    linked = [(x, y) for x in sets for y in sets if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])]
    while any(least[x] != least[y] for x, y in linked):
        for x, y in linked:
            least[x] = least[y] = min(least[x], least[y])
    return {d for d in texts if least[d] == d}


def _plain_contaminated(texts: dict[int, str], items: list[str]) -> set[int]:
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = set()
    for item in map(words, items):
        n = min(5, len(item))
        own = runs(item, n) if n else set()
        out |= {d for d, t in texts.items() if own and 100 * len(own & runs(words(t), n)) >= 75 * len(own)}
    return out


def test_pipeline(spark, duck):
    """Stage by stage against plain versions: all pairs of documents, all items in all documents, all runs of 50 and 20 words."""
    import corpus_pipeline as p

    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        after = p.stored(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        a, b = ({r.doc_id: r.text for r in df.collect()} for df in (before, after))
        assert set(b) <= set(a)
        if name == "language":  # texts of the corpus' own languages stay, those without a letter go
            assert {d for d, t in a.items() if len(re.findall(r"[^\W\d_]{2,}", t or "")) >= 20} <= set(b) and not any(t is None or not any(map(str.isalpha, t)) for t in b.values())
        if name == "near_duplicates":
            assert set(b) == _plain_kept(a)
        if name == "decontamination":
            assert set(a) - set(b) == _plain_contaminated(a, [t for (t,) in duck.sql("select text from benchmark").fetchall()])
        if name == "repeated_passages":
            words = lambda t: re.findall(r"\w+", (t or "").lower())
            runs = lambda texts, n: [tuple(w[i : i + n]) for w in map(words, texts) for i in range(len(w) - n + 1)]
            left = runs(b.values(), 50)
            assert len(left) == len(set(left))  # no passage of 50 words is there twice
            count = Counter(runs(a.values(), 20))
            assert all(b.get(d) == t for d, t in a.items() if len(words(t)) >= 20 and all(count[r] == 1 for r in runs([t], 20)))  # what doesn't repeat stays
            assert {w for t in a.values() for w in words(t)} == {w for t in b.values() for w in words(t)}  # of what repeats, one stays
        else:
            assert all(b[d] == a[d] for d in b)
        before = after
    pieces = p.STAGES[-1][1](spark, before, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()} and all(r.n == r.all for r in pieces)


def test_marks_after_a_word_cost_no_entry_of_their_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    encoder, tok = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["ab ab, ab. ab!! ab$$$ ab.%%%", " ab's ab'. ÄB. äb. İ. i̇. é, ab<| ab<|endoftext|>. ª. 1. a1. ﬁ, ", "", "\t"]
    assert [a.tolist() for a in encoder.encode([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = packing.Encoder(path)
    encoder.encode([texts[0].encode()])
    assert encoder.cache.keys() - {b""} == {b"ab"}


def test_texts_are_cut_by_one_python_worker_a_task(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b\nc")], "doc_id long, text string")
    plan = line_dedup.without_lines(df, spark.createDataFrame([(2, 0, 3)], "doc_id long, start long, length long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
