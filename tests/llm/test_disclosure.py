"""Personal data: the contract's patterns against plain regular expressions, and disclosing terms against a plain count."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from conftest import SF

from archspark.llm import disclosure, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def plain_terms(texts):
    """term -> largest ratio, as the module's docstring defines it."""
    of_term, of_entity, both, about, total = Counter(), defaultdict(set), Counter(), defaultdict(set), 0
    for text in filter(None, texts):
        spans = base(text)
        hidden = {i for _, a, b in spans for i in range(a, b)}
        words = [(m.group().lower(), m.start()) for m in re.finditer(r"[^\W_]+", "".join("\n" if i in hidden else c for i, c in enumerate(text)))]
        total += len(words)
        of_term.update(w for w, _ in words)
        for kind, a, b in spans:
            e = kind, text[a:b].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            here = sum(s < a for _, s in words)
            near = tuple(w for w, _ in words[max(0, here - 3) : here + 3])
            of_entity[e].add(near)
            for w in {w for w, _ in words[max(0, here - 16) : here + 16]}:
                both[e, w] += 1
                about[e, w].add(near)
    out = {}
    for (e, w), n in both.items():
        if len(about[e, w]) >= 3 and len(of_entity[e]) < total:
            ratio = 1 + math.log(len(about[e, w]) / (max(0, of_term[w] - n) + len(about[e, w]))) / math.log(total / len(of_entity[e]))
            if ratio >= disclosure.GENERALISED:
                out[w] = max(ratio, out.get(w, 0))
    return out


def expected(rows):
    found, out = plain_terms([t for _, t in rows]), []
    for doc, text in rows:
        text = text or ""
        spans = base(text)
        hidden = {i for _, a, b in spans for i in range(a, b)}
        clear = "".join("\n" if i in hidden else c for i, c in enumerate(text))
        added = [("term", *m.span()) for m in re.finditer(r"[^\W_]+", clear) if m.group().lower() in found]
        n, shown = Counter(k for k, _, _ in spans), lambda x: ",".join(f"{k}:{a}:{b}" for k, a, b in x)
        out.append((doc, *(n[k] for k in PATTERNS), hashlib.sha256(shown(spans).encode()).hexdigest(), shown(spans + added), len(added)))
    return out, found


def corpus(seed=3, n=900):
    """Words at random; one name that stands near one address only, one near it half of the time, copies, and odd rows."""
    r = random.Random(seed)
    vocabulary = [f"w{k}x" for k in range(300)]
    rows = []
    for k in range(n):
        words = r.choices(vocabulary, k=r.randint(5, 80))
        if k % 30 == 0:
            at = r.randrange(len(words))
            words[at:at] = ["Quillon", "writes", "from", "q.uillon@mail.example.com", "daily"] if k % 60 else ["q.uillon@Mail.example.com", "Halfway"]
        if k % 97 == 0:
            words.insert(0, "Halfway")
        if k % 11 == 0:
            words.insert(r.randrange(len(words)), r.choice(["4111 1111 1111 1111", "+1 (383) 555-0142", "10.20.30.40", "999.1.1.1", "4111111111111112", f"u{k}@x.org"]))
        rows.append((k, " ".join(words)))
    return rows + [(2000 + k, rows[60][1]) for k in range(200)] + [(None, None), (None, ""), (3, "Quillon"), (3, "Quillon"), (4, "x" * 2000 + "@"), (5, "1" * 2000), (6, "é Quillon ß a@b.c"), (7, "1." * 1000), (8, "@a.b@c.d x@y.z@w.v a@b")]


def test_patterns_equal_the_contract():
    r = random.Random(1)
    for alphabet in ("a@.-", "1.2 -+()", "a1@.+ -(9)"):
        for _ in range(20_000):
            t = "".join(r.choices(alphabet, k=r.randint(0, 30)))
            assert disclosure.identifiers(t) == base(t), t
    assert disclosure.identifiers("4111-1111 1111 1111 +49 (30) 1234-567") == [("card", 0, 19), ("phone", 20, 37)]


def test_long_texts_take_linear_time():
    for text, n in (("x" * 2_000_000 + "@", 0), ("1" * 2_000_000, 0), ("1." * 1_000_000, 250_000), ("+1" + " 2" * 1_000_000, 0), ("a@b.c " * 200_000, 200_000), ("@" * 2_000_000, 0)):
        assert len(disclosure.identifiers(text)) == n


def test_equals_a_plain_version(spark):
    rows = corpus()
    given = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, term string, row int").repartition(5)
    want, found = expected(rows)
    assert set(found) == {"quillon", "writes", "from", "daily", "halfway"}
    assert sorted(map(str, map(tuple, disclosure.personal_data(given).collect()))) == sorted(map(str, want))


def test_documents_equal_a_plain_version(spark, duck):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    assert sorted(map(tuple, queries.op11_personal_data(spark, SF).collect())) == sorted(expected(rows)[0])


def test_sanitised_texts(spark):
    rows = corpus()
    given = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, _key string")
    clean = disclosure.sanitised(given)
    assert clean.columns == given.columns
    got = clean.collect()
    assert len(got) == len(rows) and not any(re.search("quillon|@mail", r.text or "", re.I) for r in got)
    untouched = {t for _, t in rows if t and not base(t) and not re.search("quillon|halfway", t, re.I)}
    assert untouched <= {r.text for r in got}
    assert disclosure.replaced("Ann 1.2.3.4 Bob x9", "ip:4:11,removed:0:3,general:12:15,general:16:18") == " [ip] [name] [number]"


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "no data here")]])
def test_nothing_to_find(spark, rows):
    got = disclosure.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.spans, r.n_terms, r.base_sha256) for r in got] == [(d, "", 0, hashlib.sha256(b"").hexdigest()) for d, _ in rows]
